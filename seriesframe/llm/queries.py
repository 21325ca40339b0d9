"""The operators of this package as registered queries, and the same questions as SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesframe.llm import bpe, decontaminate, fill_middle, html_text, language_model, licenses, line_dedup, mixing, near_dup, neighbours, quality, sharding, vector_codes
from seriesframe.llm.sql import SQL as SQL
from seriesframe.operators.relate import attach
from seriesframe.sources.files import settle


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, folder, "documents"), size=4, share=80)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("score")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"), "vec_id % 50 = 0", k=5)


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    queue = mixing.fair_queue(_table(spark, folder, "documents"))
    return queue.select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.without_repeated_lines(_table(spark, folder, "documents"))
    return out.select(
        "doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.crc32(F.encode("text", "utf-8")).alias("text_crc32")
    )


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_matches(_table(spark, folder, "documents"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shuffled_slots(_table(spark, folder, "documents"))


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_texts(_table(spark, folder, "pages"))


def op10_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.scores(_table(spark, folder, "documents"))


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_table(spark, folder, "documents"), unit="line", percent=100, suffix_first=50, seed=7)
    back = fill_middle.restored(F.col("form"), F.col("output"))
    return out.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(back, 256)}).drop("output")


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, folder, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    coded = settle(coded, "codes")
    most = F.lit(vector_codes.LARGEST).cast("decimal(38,0)")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = coded.groupBy("label").agg(F.least(total, most).cast("long").alias("label_error"))
    # One text for each length of the vectors.
    digests = [F.when(F.col("d") == d, books.digest(d)) for d in books]
    digest = F.coalesce(*digests) if digests else F.lit(None).cast("string")
    out = attach(coded, by_label, ["label"]).withColumn("codebooks_sha256", digest)
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers  # the driver's; tasks get the vocabulary itself

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.decode(bpe.encode(_table(spark, folder, "documents"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_decontamination, op3_quality, op4_neighbours, op5_mixing, op6_line_dedup, op7_licenses, op8_sharding, op9_html_text, op10_language_model, op11_fill_middle, op12_vector_codes, op13_bpe)}
