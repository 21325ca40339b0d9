"""Objects of this package for all tasks of a job."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def sent(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast that carries the classes of this package with it, so workers need no installed copy.

    Callers share objects of a proven size only: each says where its bound comes from.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> Any:
    return pickle.loads(shared.value)


def unused(columns: list[str], stem: str) -> str:
    """A column name that a table with these columns does not have; names differ in more than case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
