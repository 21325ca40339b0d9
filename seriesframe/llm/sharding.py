"""Two-pass external shuffle into shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesframe.llm.sharing import unused
from seriesframe.sources.files import settle

#: Records of one bucket, so that its shuffle fits into a task's memory.
BUCKET_ROWS = 20_000
#: Equal rows beyond this number are spread over the tasks before they are unfolded.
SPREAD_COPIES = 1_000_000


def shuffled_slots(docs: DataFrame, shards: int = 24, seed: int = 8) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``text_crc32``, ``law`` ('rows'), ``shard``, ``slot``, ``grown_shard``.

    First pass: seeded hashes scatter the records into buckets of about BUCKET_ROWS records. Second pass: each bucket
    goes through ``shuffle``, which is a Fisher-Yates shuffle with a seed. A record's global position is its bucket's
    offset plus its place in it; position modulo ``shards`` is the shard and the quotient the slot. So the shards' counts
    differ by one at most (law 'rows') and slots run from 0 without gaps. ``grown_shard`` is null under this law.

    ``size`` is the number of UTF-8 bytes of the whole text (null: 0) plus 8; ``text_crc32`` is null for a null text.
    Rows that are equal in id, size and checksum are counted and unfolded with a running number that enters the hash, so
    any number of copies scatters evenly. Only these few values move, never texts. Null ids are ids like any other.
    An empty table gives no rows. Buckets lie in partitions of a fixed number and order: reruns agree.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode("text", "utf-8")).alias("text_crc32"),
    )
    return _placed(rows, ["doc_id", "size", "text_crc32"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _placed(rows: DataFrame, keys: list[str], shards: int, seed: int) -> DataFrame:
    """One row per row of ``rows``: its ``keys``, ``shard`` and ``slot``."""
    kinds = settle(rows.groupBy(*keys).agg(F.count("*").alias("copies")), "kinds")
    total, most = kinds.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    if most > SPREAD_COPIES:
        part = F.col("part") * F.lit(SPREAD_COPIES)
        kinds = (
            kinds.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / SPREAD_COPIES))))
            .withColumn("first", part + 1)
            .withColumn("last", F.least("copies", part + SPREAD_COPIES))
            .repartition(F.xxhash64(*keys, "part"))
        )
    else:
        kinds = kinds.select("*", F.lit(1).cast("long").alias("first"), F.col("copies").alias("last"))
    buckets = max(1, -(-total // BUCKET_ROWS))
    records = kinds.select(*keys, F.explode(F.sequence("first", "last")).alias("copy"))
    records = records.withColumn("h", F.xxhash64(F.lit(seed), *keys, "copy"))
    records = settle(records.select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), "h", *keys), "scattered")
    counts = records.groupBy("bucket").agg(F.count("*").alias("rows"))
    offsets = counts.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("offset"))
    gathered = (
        records.repartition(buckets, "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("h", *keys))).alias("records"))
        .sortWithinPartitions("bucket")
    )
    placed = gathered.select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "record"))
    position = F.col("offset") + F.col("place")
    return placed.join(offsets, "bucket").select(
        *[f"record.{k}" for k in keys],
        F.pmod(position, F.lit(shards)).cast("int").alias("shard"),
        F.floor(position / shards).cast("long").alias("slot"),
    )


def _row_key(docs: DataFrame) -> Column:
    """256-bit hash of all columns. Strings enter by the hash of their bytes, the rest as JSON in full precision."""
    values = []
    for k, f in enumerate(docs.schema.fields):
        c = docs[f"`{f.name}`"]
        kind = f.dataType.typeName()
        if kind in ("string", "varchar", "char", "binary"):
            c = F.sha2(c.cast("binary"), 256)
        values.append(c.alias(f"c{k}"))
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.unhex(F.sha2(F.to_json(F.struct(*values), options).cast("binary"), 256))


def sharded_documents(docs: DataFrame, shards: int = 24, seed: int = 8) -> DataFrame:
    """The records themselves with ``shard`` and ``slot``, placed as in the plan above by a hash of all columns, so only rows
    that are equal in every column stand for each other.

    Columns of ``docs`` named ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop("shard", "slot")
    key = unused([*docs.columns, "bucket", "copy", "copies", "first", "last", "part", "h"], "row_key")
    keyed = docs.select("*", _row_key(docs).alias(key))
    placed = _placed(keyed.select(key), [key], shards, seed)
    return placed.join(keyed.dropDuplicates([key]), key).select(*[f"`{c}`" for c in docs.columns], "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = 24, seed: int = 8) -> None:
    """Write each shard as a folder of Parquet, its records in slot order."""
    out = sharded_documents(docs, shards, seed)
    out.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
