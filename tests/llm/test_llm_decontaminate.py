"""Decontamination against brute force over all passages and items."""

import random

import numpy as np

from invented import item_rows
from seriesframe.llm import decontaminate
from seriesframe.llm.words import WordHash, hashes_of, shingles, words_of


def brute(docs, items, size=5, share=80):
    memo = WordHash()
    texts = [(i, words_of(t.encode())) for i, t in items if t and words_of(t.encode())]
    longest = max(len(w) for _, w in texts)
    out = []
    for doc_id, text in docs:
        words = words_of(text.encode()) if text else []
        for item_id, item in texts:
            q, a = [set(shingles(hashes_of(p, memo), size).tolist()) for p in decontaminate.split_item(item)]
            best = None
            for at in range(0, len(words), longest):
                own = hashes_of(words[at : at + 2 * longest], memo)
                have = set(shingles(own, size).tolist())
                for part in (q, a):
                    if len(part) == 1:
                        have |= {h for s in range(1, size + 1) for h in shingles(own, s).tolist()}
                found = len(q & have), len(a & have)
                if 100 * sum(found) >= share * (len(q) + len(a)) and 2 * found[0] >= len(q) and 2 * found[1] >= len(a):
                    best = max(best or (0, 0), found, key=sum)
            if best:
                out.append((doc_id, item_id, len(q), len(a), *best))
    return sorted(out, key=str)


def planted(odd_rows):
    rng = random.Random(2)
    items = item_rows(rng)
    docs = [(r[0], r[1]) for r in odd_rows]
    filler = [t for _, t in docs if t and 20 < len(t.split()) < 100]
    for k, (_, text) in enumerate(items[:12]):
        words = text.split() if text else []
        if k % 3 == 1 and words:
            words[len(words) // 2] = "changed"
        if k % 3 == 2:
            words = words[: len(words) // 2]  # the question alone
        docs.append((1_000 + k, filler[k] + "\n" + " ".join(words).upper() + " " + filler[k + 1]))
    return docs, items


def test_equal_to_brute_force(spark, odd_rows):
    docs, items = planted(odd_rows)
    got = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    want = brute(docs, items)
    assert len(want) >= 8
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == want


def test_several_indexes_find_the_same(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 3_000)
    docs, items = planted(odd_rows)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    whole = {(r[0], r[1]) for r in brute(docs, items)}
    assert whole == {(r.doc_id, r.item_id) for r in got.collect()}


def test_rows_without_items_stay_as_they_are(spark, odd_docs, odd_rows):
    docs, items = planted(odd_rows)
    bench = spark.createDataFrame([*items, (9_999, odd_rows[5][1] + " " + odd_rows[6][1])], "item_id long, text string")
    clean = decontaminate.decontaminated(odd_docs, bench)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    bench = spark.createDataFrame([(1, odd_rows[5][1])], "item_id long, text string")
    left = [r.doc_id for r in decontaminate.decontaminated(odd_docs, bench).collect()]
    assert 5 not in left and len(left) == odd_docs.count() - 1


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert decontaminate.contaminated(odd_docs, none).count() == 0
    assert decontaminate.contaminated(no_docs, some).count() == 0
    assert decontaminate.decontaminated(odd_docs, none).count() == odd_docs.count()


def test_threshold_is_under_every_accepted_passage():
    rng = random.Random(3)
    items = [(i, t.encode()) for i, t in item_rows(rng) if t]
    df, texts = {}, [words_of(t) for _, t in items]
    for words in texts:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.Index(items, df, len(items), float(np.mean([len(w) for w in texts])), 5, 80)
    memo = WordHash()
    for k, words in enumerate(texts):
        whole = np.unique(shingles(hashes_of(words, memo), 5))
        for _ in range(40):
            have = list(words)
            for at in rng.sample(range(len(have)), min(len(have), rng.randint(0, 4))):
                have[at] = b"-"
            found = np.isin(whole, shingles(hashes_of(have, memo), 5)).sum()
            if 100 * found >= 80 * len(whole):
                assert any(item == k for _, _, item, _ in index.search([have]))
