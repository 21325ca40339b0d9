"""Typed CSV scan, CSV and parquet sinks, and write-then-read stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from seriesframe.session import new_stage_path

# Fixed value: full-precision text form of a timestamp, so a CSV round trip loses nothing.
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_survey_csv(spark: SparkSession, path: str, schema: StructType | str, null: str = "NA") -> DataFrame:
    """CSV with a header row and a declared schema; ``null`` marks missing cells."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", null)
        .option("timestampNTZFormat", TIMESTAMP_TEXT)
        .option("escape", '"')
        .csv(path)
    )


def write_survey_csv(df: DataFrame, path: str, null: str = "NA", mode: str = "overwrite") -> None:
    """CSV with a header row, missing cells written as ``null``."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("nullValue", null)
        .option("emptyValue", '""')
        .option("timestampNTZFormat", TIMESTAMP_TEXT)
        .option("escape", '"')
        .csv(path)
    )


def stage(df: DataFrame, path: str) -> DataFrame:
    """Materialise as parquet and read back with the same schema."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tee(df: DataFrame, path: str) -> DataFrame:
    """Write CSV for people and carry on with a parquet copy: the input is computed once."""
    copy = settle(df, "tee")
    write_survey_csv(copy, path)
    return copy


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table that several branches of a plan read.

    Without it every branch would scan and aggregate the source again. The files lie in the
    shared folder, so a lost executor costs a re-read, never a recomputation.
    """
    return stage(df, new_stage_path(df.sparkSession, name))
