"""The pipeline's stages against what each must do with its own input, and the registered queries."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from seriesframe.llm.queries import QUERIES, SQL
from seriesframe.llm.words import words_of
from invented import prose
from test_llm_near_dup import brute


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 10 != 7), 0) for k in range(40)] + [(None, 1, 0), (5, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    columns = docs.columns
    for name, stage in p.STAGES:
        out = stage(spark, docs, folder)
        if name != "sharding":
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert {"doc_id", "text", "shard", "slot"} <= set(docs.columns)


def test_near_dedup_keeps_one_of_each_group(spark, odd_docs, odd_rows, folder):
    got = sorted(((r.doc_id, r.text) for r in p.near_dedup(spark, odd_docs, folder).collect()), key=str)
    assert got == one_each(odd_rows)


def one_each(rows):
    """Documents are ids with texts; those whose id or text is not enough are numbered behind all others."""
    documents = sorted({(r[0], r[1]) for r in rows if r[0] is not None or words_of((r[1] or "").encode())}, key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    texts = {}
    for i, t in documents:
        texts.setdefault(i, []).append(t)
    nodes = {d: d[0] if d[0] is not None and len(texts[d[0]]) == 1 else 10_000 + k for k, d in enumerate(documents)}
    kept = {r[0] for r in brute([(n, t) for (_, t), n in nodes.items()], 5) if r[3]}
    out = [d for d, n in nodes.items() if n in kept]
    return sorted(out + [(None, r[1]) for r in rows if r[0] is None and not words_of((r[1] or "").encode())], key=str)


def test_near_dedup_tells_rows_of_one_id_apart(spark, folder):
    rng = random.Random(5)
    a, b, c, d = (prose(rng, 90) for _ in range(4))
    rows = [(5, a), (5, b), (7, b + " end"), (None, c), (None, c), (None, c + " end"), (None, None), (None, " "), (None, " "), (8, None), (8, ""), (9, d), (9, d)]
    docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = p.near_dedup(spark, docs.repartition(3), folder).collect()
    texts = sorted(((r.doc_id, r.text) for r in got), key=str)
    assert len(texts) == 9 and texts.count((None, " ")) == 2 and (5, a) in texts and (9, d) in texts
    assert (7, b + " end") in texts and (5, b) not in texts  # (7, ...) has an id of its own, so it comes first
    assert sum(r.text in (c, c + " end") for r in got if r.text) == 1 and {(8, None), (8, ""), (None, None)} <= set(texts)
    assert [r.source for r in got if r.doc_id == 9] == ["s11"]


def test_stages_with_names_of_their_own_columns(spark, odd_docs, folder):
    """Columns named like those inside the stages come through with their values."""
    names = ("kept_place", "kept_id", "carried_0", "carried_1", "row_key", "_row_key", "own_id", "own_mark", "own_node", "OWN_PLACE", "mark", "copies", "first")
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(n).alias(n) for n in names])
    for name, stage in p.STAGES[1:]:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names)


def test_run(spark, folder):
    out = p.run(spark, folder).collect()
    assert out and all(words_of(r.text.encode()) for r in out)
    counts = [sum(r.shard == s for r in out) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and p.ORACLE_SQL is None


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)
