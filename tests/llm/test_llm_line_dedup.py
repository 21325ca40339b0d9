"""Line dedup: nothing unique goes, repeated passages go."""

import random

from invented import prose
from seriesframe.llm import line_dedup


def run(docs):
    return {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}


def test_repeated_passages_go_but_for_the_first(spark):
    rng = random.Random(6)
    passage = prose(rng, 120)
    rows = [(k, "\n".join([prose(rng, 40), passage, prose(rng, 30)])) for k in range(12)] + [(20 + k, prose(rng, 60)) for k in range(10)]
    out = run(spark.createDataFrame(rows, "doc_id long, text string"))
    own = passage.split("\n")
    assert out[0].text == rows[0][1] and out[0].removed == []
    for k, text in rows[1:]:
        lines = text.split("\n")
        assert [lines[j] for j in range(len(lines)) if j not in out[k].removed] == out[k].text.split("\n")
        if k < 20:
            at = lines.index(own[0])
            assert out[k].removed == list(range(at, at + len(own)))
        else:
            assert out[k].removed == []


def test_only_lines_that_repeat_with_a_neighbour_go(spark, odd_docs, odd_rows):
    pairs = {}
    for n, r in enumerate(odd_rows):
        lines = (r[1] or "").split("\n")
        for p in zip(lines, lines[1:]):
            pairs.setdefault(p, set()).add((r[0], n))
    texts = {(r[0], len((r[1] or "").split("\n")) if r[1] else 0): r[1] for r in odd_rows}
    rows = line_dedup.without_repeated_lines(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        lines = (texts[r.doc_id, r.n_lines] or "").split("\n")
        for k in r.removed:
            around = [(lines[j], lines[j + 1]) for j in (k - 1, k) if 0 <= j < len(lines) - 1]
            assert any(len(pairs[p]) > 1 for p in around)
    by = {r.doc_id: r for r in rows}
    assert by[201].text is None and by[201].n_lines == 0 and by[200].text == "" and by[100].removed == []
    assert len(by[104].removed) > 0 and by[206].removed == []


def test_same_hash_with_other_bytes_stays(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "chunk_hash", lambda x: 7)
    rng = random.Random(8)
    rows = [(k, prose(rng, 100)) for k in range(6)]
    out = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(out[k].text == t for k, t in rows)


def test_cuts_move_with_the_lines():
    rng = random.Random(9)
    lines = [prose(rng, 9).encode() for _ in range(60)]
    whole = {h: n for h, _, n in line_dedup.chunks(lines)}
    moved = {h: n for h, _, n in line_dedup.chunks([b"new line here"] * 3 + lines)}
    assert len(whole.keys() & moved.keys()) >= len(whole) - 2 * line_dedup.LAYERS


def brute(rows):
    """Lines that lie in a passage of at least two lines and ten words that an earlier place holds, too; places are ordered by
    id (none last), mark of the text, and line."""
    documents = sorted({(i, t) for i, t in rows if t}, key=lambda d: (d[0] is None, d[0] or 0, MARKS[d[1]]))
    first, gone = {}, {}
    for at, (i, text) in enumerate(documents):
        lines = text.split("\n")
        for s in range(len(lines)):
            for n in range(2, len(lines) - s + 1):
                run = tuple(lines[s : s + n])
                if len(" ".join(run).split()) >= 10:
                    if first.setdefault(run, (at, s)) != (at, s):
                        gone.setdefault((i, text), set()).update(range(s, s + n))
    return gone


MARKS = {}


def compared(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    MARKS.update({r.text: r.mark for r in line_dedup._marked(docs).collect()})
    want = brute(rows)
    out = line_dedup.without_repeated_lines(docs).collect()
    texts = sorted(((i, t) for i, t in rows), key=str)
    left = lambda i, t: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get((i, t), ()))
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(((i, left(i, t)) for i, t in texts), key=str)
    return want


def test_short_passages_in_any_surroundings(spark):
    """Each passage of 2, 3, 4 or 7 lines stands in two otherwise different texts: the later copy goes, whatever is around it."""
    rng = random.Random(10)
    rows, counts = [], []
    for k in range(120):
        n = (2, 3, 4, 7)[k % 4]
        passage = [" ".join(prose(rng, 8).split()) for _ in range(n)]
        for copy in (0, 1):
            around = [prose(rng, rng.randint(1, 9)).replace("\n", " ") for _ in range(rng.randint(0, 9))]
            cut = rng.randint(0, len(around))
            rows.append((2 * k + copy, "\n".join(around[:cut] + passage + around[cut:])))
        counts.append(n)
    want = compared(spark, rows)
    assert sum(map(len, want.values())) >= sum(counts)


def test_ids_with_several_texts_and_without(spark):
    rng = random.Random(11)
    passage = prose(rng, 45)
    unique = [prose(rng, 81) for _ in range(3)]
    rows = [(1, passage), (7, passage), (7, unique[0]), (7, unique[1] + "\n" + passage), (None, unique[2]), (None, unique[2] + "\n" + passage)]
    rows += [(None, None), (3, ""), (3, passage), (3, passage)]
    want = compared(spark, rows)
    assert (7, unique[0]) not in want and (None, unique[2]) not in want | {(None, unique[2] + "x"): 0}


def test_long_matches_go_on_beyond_the_lines_around(spark):
    rng = random.Random(12)
    passage = [" ".join(prose(rng, 6).split()) + f" {k}" for k in range(90)]
    rows = [(k, "\n".join([prose(rng, 20), *passage[k : 80 + k], prose(rng, 20)])) for k in range(4)]
    out = run(spark.createDataFrame(rows, "doc_id long, text string"))
    for k, text in rows[1:]:
        lines = text.split("\n")
        stays = {x for x in lines if x not in passage[: 80 + k - 1]}
        assert {x for j, x in enumerate(lines) if j not in out[k].removed} == stays


def test_empty_table(no_docs):
    assert line_dedup.without_repeated_lines(no_docs).collect() == []
