"""Shards hold every record once, evenly and without gaps."""

import zlib
from collections import Counter

from seriesframe.llm import sharding


def check(rows, want, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def record(doc_id, text):
    raw = text.encode() if text is not None else b""
    return doc_id, len(raw) + 8, zlib.crc32(raw) if text is not None else None


def test_odd_rows(odd_docs, odd_rows, monkeypatch):
    want = Counter(record(r[0], r[1]) for r in odd_rows)
    for bucket_rows, copies in ((20_000, 1_000_000), (5, 1)):
        monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
        monkeypatch.setattr(sharding, "SPREAD_COPIES", copies)
        check(sharding.shuffled_slots(odd_docs).collect(), want, 24)


def test_many_copies_of_one_row_spread_evenly(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    docs = spark.range(3_000).selectExpr("if(id % 3 = 0, 1, id) as doc_id", "'x' as text")
    rows = sharding.shuffled_slots(docs, 7).collect()
    check(rows, Counter(record(1 if k % 3 == 0 else k, "x") for k in range(3_000)), 7)
    hot = Counter(r.shard for r in rows if r.doc_id == 1)
    assert min(hot.values()) > 90


def test_same_on_rerun_and_another_seed_differs(odd_docs):
    one, two, other = (sorted(map(tuple, sharding.shuffled_slots(odd_docs, seed=s).collect()), key=str) for s in (8, 8, 9))
    assert one == two and one != other


def test_order_is_shuffled(spark):
    rows = sharding.shuffled_slots(spark.range(5_000).selectExpr("id as doc_id", "'x' as text"), 1).collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.slot)]
    rising = sum(a < b for a, b in zip(order, order[1:])) / len(order)
    assert 0.45 < rising < 0.55


def test_records_and_files(spark, odd_docs, odd_rows, tmp_path, no_docs):
    out = sharding.sharded_documents(odd_docs, 3)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r[0], r[1]) for r in odd_rows)
    sharding.write_shards(odd_docs.select("doc_id", "text", "size"), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_rows) and sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    assert sharding.shuffled_slots(no_docs).collect() == [] and sharding.sharded_documents(no_docs).collect() == []


def test_rows_that_share_id_size_and_checksum_stay_apart(spark):
    """Equal texts with other sources, and two texts of equal size and checksum, with null ids and with one id."""
    seen = {}
    for k in range(2_000_000):
        text = f"{k * 2_654_435_761 % 2**32:08x}{k:08x}"
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            break
    assert other != text and zlib.crc32(other.encode()) == zlib.crc32(text.encode())
    rows = [(i, t, s, x) for i in (None, 7) for t, s, x in ((text, "a", 0.5), (text, "b", 0.5), (text, None, None), (other, "a", 0.5), (other, "a", 0.5), (None, "a", -0.0), (None, "a", 0.0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, x double").selectExpr("*", "array(source, null) as more", "map('k', x) as m")
    out = sharding.sharded_documents(docs, 3)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert Counter((r.doc_id, r.text, r.source, str(r.x)) for r in out.collect()) == Counter((i, t, s, str(x)) for i, t, s, x in rows)
