"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "rootscope", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Event time is wall time in UTC; epoch conversions rely on it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder below the warehouse, which executors have to share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


#: Where stored tables go at the moment, if not directly below the root.
_FOLDER: ContextVar[str | None] = ContextVar("scratch_folder", default=None)


@contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """Tables stored inside go below one new folder; its path is given.

    ``discard`` of that path deletes them together, once all that reads them is written.
    """
    path = scratch_path(spark, label)
    token = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(token)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{(_FOLDER.get() or scratch_root(spark)).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write once to the shared folder and read it back.

    Survives lost executors, and gives the next plan exact size statistics.
    """
    return materialise_at(df, scratch_path(df.sparkSession, label))


def materialise_at(df: DataFrame, path: str) -> DataFrame:
    """As ``materialise``, at a path that the caller can hand to ``discard``."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no later step reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
