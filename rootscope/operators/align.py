"""Bringing instances onto one time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.session import materialise


def align_intersection(table: DataFrame, scope: Column | None = None) -> DataFrame:
    """Rows at times every instance has.

    ``scope`` is an expression of ``instance_id``; instances are then only compared within
    their scope.  The kept times are one row each; how they are joined is left to
    their size.
    """
    if scope is None:
        total = table.agg(F.count_distinct("instance_id")).scalar()
        pairs = table.select("timestamp", "instance_id").distinct()
        seen = pairs.groupBy("timestamp").agg(F.count(F.lit(1)).alias("_n"))
        return table.join(seen.where(F.col("_n") == total).select("timestamp"), "timestamp", "left_semi")
    placed = table.withColumn("_scope", scope)
    pairs = placed.select("_scope", "timestamp", "instance_id").distinct()
    totals = placed.groupBy("_scope").agg(F.count_distinct("instance_id").alias("_all"))
    seen = pairs.groupBy("_scope", "timestamp").agg(F.count(F.lit(1)).alias("_n")).join(totals, "_scope")
    shared = seen.where(F.col("_n") == F.col("_all")).select("_scope", "timestamp")
    return placed.join(shared, ["_scope", "timestamp"], "left_semi").drop("_scope")


def align_union(dense: DataFrame) -> DataFrame:
    """Every instance at all times; cells that did not exist are NULL.

    Only the missing (time, instance) pairs are made, from the list of instances.
    """
    own = dense.groupBy("instance_id").agg(F.collect_set("feature").alias("_own"))
    everyone = dense.agg(F.collect_set("instance_id")).scalar()
    missing = (
        dense.groupBy("timestamp")
        .agg(F.collect_set("instance_id").alias("_have"))
        .select("timestamp", F.explode(F.array_except(everyone, "_have")).alias("instance_id"))
    )
    empty = missing.join(own, "instance_id").select(
        "instance_id", "timestamp", F.explode("_own").alias("feature"), F.lit(None).cast("double").alias("value")
    )
    return dense.select("instance_id", "timestamp", "feature", "value").unionByName(empty)


def align_ranges(dense: DataFrame, scope: Column | None = None) -> DataFrame:
    """Intersection for gap-free tables: from the latest first to the earliest last time."""
    keys = [] if scope is None else ["_scope"]
    placed = dense if scope is None else dense.withColumn("_scope", scope)
    ends = placed.groupBy(*keys, "instance_id").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    if scope is None:
        start, stop = ends.agg(F.max("_first")).scalar(), ends.agg(F.min("_last")).scalar()
        return dense.where((F.col("timestamp") >= start) & (F.col("timestamp") <= stop))
    common = ends.groupBy("_scope").agg(F.max("_first").alias("_start"), F.min("_last").alias("_stop"))
    return (
        placed.join(materialise(common, "ranges"), "_scope")
        .where((F.col("timestamp") >= F.col("_start")) & (F.col("timestamp") <= F.col("_stop")))
        .drop("_scope", "_start", "_stop")
    )


def concat_files(tables: list[DataFrame]) -> DataFrame:
    """Rows of the same instance from several files."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def at_time(table: DataFrame, ts: str | None = None) -> DataFrame:
    """Rows at one time, or all, as one vector per instance and time.

    Features are ordered by name.
    """
    if ts is not None:
        table = table.where(F.col("timestamp") == F.lit(ts).cast("timestamp_ntz"))
    cells = F.array_sort(F.collect_list(F.struct("feature", "value")))
    return (
        table.groupBy("instance_id", "timestamp")
        .agg(cells.alias("_cells"))
        .select("instance_id", "timestamp", F.transform("_cells", lambda c: c.getField("value")).alias("vec"))
    )
