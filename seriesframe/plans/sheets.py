"""The star-schema test tables in the roles of the survey sheets.

``orders`` are sampling events, ``lineitem`` the specimens of an event, ``customer`` the
environment, ``events`` the time series (``event_type`` is the series).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesframe.operators.grid import densify
from seriesframe.operators.relate import join_keep_left
from seriesframe.sources.files import settle

IDS = ["l_partkey", "l_linenumber"]
STEP_S = 600
HALF_HOUR_SLOTS = 3
DAY_SLOTS = 144


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_base(spark: SparkSession, folder: str) -> DataFrame:
    o, key = table(spark, folder, "orders"), F.col("o_orderkey")
    gear = F.when(F.col("o_orderstatus") == "F", "RST").when(F.col("o_orderstatus") == "O", "Vertical").otherwise("IPT")
    return o.select(
        key.alias("event"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("bay"),
        gear.alias("gear"),
        (key % 4).alias("released"),
        (600 + 60 * (key % 13)).alias("run_s"),
        (key % 3 * 6).alias("depth_ft"),
    )


def specimen_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Specimens with their category; several labels collapse as two of the categories do."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("event"),
        F.col("l_returnflag").alias("category"),
        *IDS,
        F.col("l_quantity").alias("length"),
        F.col("l_discount").alias("velocity"),
        "l_linestatus",
    )


def category_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Specimens, distinct specimens and velocity sums per event and category.

    This is the one pass over the specimens; events and categories are both read from it.
    """
    sums = specimen_sheet(spark, folder).groupBy("event", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("velocity").alias("velocity_sum"),
        F.count("velocity").alias("velocity_n"),
        F.countDistinct(*IDS).alias("n_cat"),
    )
    return settle(sums, "category_sums")


def event_sheet(spark: SparkSession, folder: str, sums: DataFrame | None = None) -> DataFrame:
    """One row per event: total (specimens plus released) and mean velocity."""
    sums = category_sums(spark, folder) if sums is None else sums
    per_event = sums.groupBy("event").agg(
        F.sum("n").alias("_n"), F.try_divide(F.sum("velocity_sum"), F.sum("velocity_n")).alias("velocity")
    )
    out = join_keep_left(event_base(spark, folder), per_event, ["event"])
    return out.withColumn("total", F.coalesce(F.col("_n"), F.lit(0)) + F.col("released")).drop("_n")


def discharge(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean of the environment value."""
    o = table(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return join_keep_left(o, c, ["o_custkey"]).groupBy("date").agg(
        F.avg(F.abs("c_acctbal")).alias("mean_discharge")
    )


def series_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("series"), "value", "props"
    )


def grid_series(spark: SparkSession, folder: str, step_s: int = STEP_S) -> DataFrame:
    """Mean value per series and slot over the whole season; slots without events are null."""
    e = series_events(spark, folder)
    return densify(e, "ts", step_s, ["series"], [F.avg("value").alias("value")])


def daily_series(spark: SparkSession, folder: str) -> DataFrame:
    e = series_events(spark, folder)
    return densify(e, "ts", 86400, ["series"], [F.avg("value").alias("value"), F.sum("value").alias("total")])
