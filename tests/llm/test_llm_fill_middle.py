"""Fill-in-the-middle against plain splitting of the texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from seriesframe.llm import fill_middle
from invented import prose

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "character": r"(?s:.)"}


def brute(doc_id, text, unit="line", percent=100, suffix_first=50, seed=7):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if h[3] % 100 < suffix_first:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def key(row):
    return tuple((v is None, str(v)) for v in row)


def rows_with_signs(odd_rows):
    more = ["a <P> b\nc", "<M>", "x\n<", "S>\n<P", "\n", "\n\n\n", "a\n\nb", "é\n中\n😀", "a\r\nb\x0bc", "<S\n>M<"]
    return [(r[0], r[1]) for r in odd_rows] + [(900 + k, t) for k, t in enumerate(more * 6)]


@pytest.mark.parametrize("block", [5, 1024])
@pytest.mark.parametrize("unit", ["line", "word", "character"])
def test_equal_to_plain_splitting(spark, odd_rows, monkeypatch, block, unit):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    rows = rows_with_signs(odd_rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as form", "'y' as output").repartition(3)
    out = fill_middle.fill_in_middle(docs, unit).withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted((brute(i, t, unit) for i, t in rows), key=key)
    assert sorted((str(r.doc_id), r.back) for r in out) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_shares_and_seed(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, 40)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in fill_middle.fill_in_middle(docs, "word", percent=30, suffix_first=10, seed=3).collect()]
    assert sorted(out) == sorted(brute(i, t, "word", 30, 10, 3) for i, t in rows)
    forms = [r[2] for r in out]
    assert 200 < forms.count("plain") < 340 and forms.count("spm") < forms.count("psm")


def test_cut_by_tree_in_any_block(monkeypatch):
    rng = random.Random(6)
    for block in (1, 2, 3, 8, 1024):
        monkeypatch.setattr(fill_middle, "BLOCK", block)
        for _ in range(60):
            text = "".join(rng.choices("ab\n é中\t", k=rng.randint(0, 70)))
            for unit, pattern in UNIT.items():
                units = re.findall(pattern, text)
                blocks = fill_middle.Blocks(text.encode(), unit)
                assert blocks.units == len(units) and blocks.points == len(text)
                for k in range(len(units) + 1):
                    head = "".join(units[:k])
                    assert blocks.cut(k) == (len(head.encode()), len(head))


def test_empty_and_unfit_markers(no_docs, odd_docs):
    assert fill_middle.fill_in_middle(no_docs).collect() == []
    for bad in (("<P>", "<P>", "P>"), ("", "b", "c"), ("aa", "b", "c"), ("<a", "a<", "c")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(odd_docs, markers=bad)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(odd_docs, unit="page")
