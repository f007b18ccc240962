"""Writers for features, cubes and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootscope.operators.cube import cube_metadata

UNKNOWN_DATE = "unknown_date"


def path_date(path: Column | str) -> Column:
    """The first ``YYYY-MM-DD`` in a path, else ``unknown_date``."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit(UNKNOWN_DATE))


def write_features(features: DataFrame, root: str, fmt: str = "parquet", date: str = "date") -> None:
    """One folder per date and instance, written by one job.

    Only folders of the given dates and instances are replaced; others stay.  Spark deals the
    rows out by folder and splits by size, so a busy instance is written by many tasks.
    """
    writer = features.hint("rebalance", date, "instance_id").write.mode("overwrite").partitionBy(date, "instance_id")
    writer = writer.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(root)


def save_processed(table: DataFrame, path: str, fmt: str = "parquet") -> None:
    table.write.mode("overwrite").format(fmt).save(path)


def load_processed(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_cube(cube: DataFrame, nodes: DataFrame, path: str, source: str = "generated") -> DataFrame:
    """Cube as Parquet sorted by time, and its one-row description, which is returned."""
    cube.repartitionByRange("ts", "node_id").sortWithinPartitions("ts", "node_id").write.mode("overwrite").parquet(
        f"{path.rstrip('/')}/cube"
    )
    stored = cube.sparkSession.read.schema(cube.schema).parquet(f"{path.rstrip('/')}/cube")
    about = cube_metadata(stored, nodes, source)
    about.write.mode("overwrite").json(f"{path.rstrip('/')}/service_mapping")
    return about


def write_results(ranked: DataFrame, cases: DataFrame, metrics: DataFrame, path: str) -> None:
    """All ranks of all cases as CSV, one row per case and rank, and the evaluation as JSON.

    A case without a ranking has one row without a rank.
    """
    long = cases.join(ranked.select("case_id", "rank", "node", "score"), "case_id", "left")
    long.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/ranked")
    metrics.write.mode("overwrite").json(f"{path.rstrip('/')}/res")
