"""Metric series: pivot, schema alignment, cleaning, resampling, statistics.

Long form throughout: ``(instance_id, timestamp, feature, value)`` with one row per
cell.  A *dense* table also has the empty cells, as NULL values, because filling and
outlier rules look at them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.functions.scalars import epoch_micros, epoch_seconds, seconds_to_ts, time_floor
from rootscope.operators.spread import DAY, grouped_quantiles, known_neighbours, time_chunk
from rootscope.session import materialise

SERIES = ["instance_id", "feature"]
CELL = ["instance_id", "timestamp", "feature"]


def average_cells(metrics: DataFrame, name: str = "metric_name", keep_empty: bool = False) -> DataFrame:
    """Mean per instance, time and metric.

    Cells without any value do not exist, as in a pivot of long rows; with ``keep_empty``
    they stay as NULL, as in wide files, whose empty rows and columns are filled later.
    """
    keyed = metrics.select("instance_id", "timestamp", F.col(name).alias("feature"), "value")
    keyed = keyed if keep_empty else keyed.where(F.col("value").isNotNull())
    return keyed.dropna(subset=CELL).groupBy(*CELL).agg(F.avg("value").alias("value"))


def _rows_as_maps(cells: DataFrame) -> DataFrame:
    # one entry per metric of the instance, so the map is as wide as the schema
    entries = F.collect_list(F.struct("feature", "value"))
    return cells.groupBy("instance_id", "timestamp").agg(F.map_from_entries(entries).alias("_cells"))


def pivot_wide(cells: DataFrame, features: list[str]) -> DataFrame:
    """One column per feature, for sinks; features are named by the caller."""
    return _rows_as_maps(cells).select(
        "instance_id", "timestamp", *[F.try_element_at("_cells", F.lit(f)).alias(f) for f in features]
    )


def instance_features(cells: DataFrame) -> DataFrame:
    """``(instance_id, own)``: the metric names of every instance."""
    return cells.groupBy("instance_id").agg(F.collect_set("feature").alias("own"))


def common_features(cells: DataFrame, scope: Column | None = None) -> DataFrame:
    """``(_scope, feature)``: features every instance (of a scope) has."""
    pairs = cells.select(*SERIES).distinct().withColumn("_scope", F.lit("") if scope is None else scope)
    seen = pairs.groupBy("_scope", "feature").agg(F.count(F.lit(1)).alias("_n"))
    if scope is None:
        total = cells.agg(F.count_distinct("instance_id")).scalar()
        return seen.where(F.col("_n") == total).select("_scope", "feature")
    totals = pairs.groupBy("_scope").agg(F.count_distinct("instance_id").alias("_all"))
    return seen.join(totals, "_scope").where(F.col("_n") == F.col("_all")).select("_scope", "feature")


def absent_cells(names: Column, cells: Column, value: Column) -> Column:
    """Cells with ``value`` for the names that no entry of ``cells`` has; linear in both."""
    have = F.transform(cells, lambda c: c.getField("feature"))
    return F.transform(F.array_except(names, have), lambda n: F.struct(n.alias("feature"), value.alias("value")))


def dense_cells(cells: DataFrame, schema: str = "own", fill: float = 0.0, scope: Column | None = None) -> DataFrame:
    """All cells of the wide tables, empty ones as NULL.

    ``schema``: ``own`` keeps every instance's metrics, ``intersection`` the metrics all
    instances have, ``union`` all metrics, with ``fill`` where an instance lacks one.
    ``scope``, an expression of ``instance_id``, bounds what "all instances" means.  One
    shuffle by (instance, time); the names come as an array, and only absent cells are
    made anew: no join with a grid, no look-up per cell.
    """
    here = F.lit("") if scope is None else scope
    within = [] if scope is None else ["_scope"]
    cell = F.struct("feature", "value")
    none, filled = F.lit(None).cast(cells.schema["value"].dataType), F.lit(float(fill))
    if schema == "intersection":
        names = common_features(cells, scope)
        marked = names.select(*within, "feature", F.lit(True).alias("_kept"))
        kept = cells.withColumn("_scope", here).join(marked, [*within, "feature"], "left")
        rows = kept.groupBy(*within, "instance_id", "timestamp").agg(F.collect_list(F.when(F.col("_kept"), cell)).alias("_cells"))
        rows = _with_names(rows, names, within).withColumn("_absent", absent_cells(F.col("_names"), F.col("_cells"), none))
    else:
        rows = cells.groupBy("instance_id", "timestamp").agg(F.collect_list(cell).alias("_cells"))
        own = instance_features(cells)
        if schema == "union":
            every = cells.select(here.alias("_scope"), "feature").distinct()
            own = _with_names(own.withColumn("_scope", here), every, within)
            own = own.select("instance_id", "own", F.array_except("_names", "own").alias("_others"))
        rows = rows.join(own, "instance_id").withColumn("_absent", absent_cells(F.col("own"), F.col("_cells"), none))
        if schema == "union":
            others = F.transform("_others", lambda n: F.struct(n.alias("feature"), filled.alias("value")))
            rows = rows.withColumn("_absent", F.concat("_absent", others))
    return rows.select("instance_id", "timestamp", F.explode(F.concat("_cells", "_absent")).alias("_c")).select(
        "instance_id", "timestamp", "_c.feature", "_c.value"
    )


def _with_names(rows: DataFrame, names: DataFrame, within: list[str]) -> DataFrame:
    """Adds ``_names``, the features of the row's scope, if there are scopes: as long as the schema is wide."""
    none = F.array().cast("array<string>")
    if not within:
        return rows.withColumn("_names", F.coalesce(names.agg(F.collect_set("feature")).scalar(), none))
    listed = materialise(names.groupBy(*within).agg(F.collect_set("feature").alias("_names")), "names")
    return rows.join(listed, within, "left").withColumn("_names", F.coalesce("_names", none))


# --- cleaning --------------------------------------------------------------------


def outlier_mask(dense: DataFrame, threshold: float = 3.0, skip_null: bool = False) -> DataFrame:
    """Adds ``is_outlier``: more than ``threshold`` population deviations off the mean.

    A series with an empty cell has no outliers unless ``skip_null`` is set.
    """
    marked = dense.join(_spread(dense), SERIES).withColumn("is_outlier", _far(threshold, skip_null))
    return marked.select(*CELL, "value", "is_outlier")


def _spread(dense: DataFrame) -> DataFrame:
    """One row per series."""
    return dense.groupBy(*SERIES).agg(
        F.avg("value").alias("_mean"),
        F.stddev_pop("value").alias("_std"),
        F.count("value").alias("_known"),
        F.count(F.lit(1)).alias("_all"),
    )


def _far(threshold: float, skip_null: bool) -> Column:
    far = F.try_divide(F.abs(F.col("value") - F.col("_mean")), F.col("_std")) > threshold
    if not skip_null:
        far = far & (F.col("_known") == F.col("_all"))
    return F.coalesce(far, F.lit(False))


def series_median(dense: DataFrame) -> DataFrame:
    return grouped_quantiles(dense.select(*SERIES, "value"), SERIES, "value", {"median": 0.5}, levels=2)


def outlier_replace(dense: DataFrame, threshold: float = 3.0, skip_null: bool = False) -> DataFrame:
    """Outliers become the median of their series (the outliers count in it)."""
    # the two rows of a series meet first, so the cells are joined once
    known = _spread(dense).join(series_median(dense), SERIES, "left")
    value = F.when(_far(threshold, skip_null), F.col("median")).otherwise(F.col("value"))
    return dense.join(known, SERIES).select(*CELL, value.alias("value"))


def fill_missing(dense: DataFrame, method: str = "forward", fill: float = 0.0, chunk_seconds: int = DAY) -> DataFrame:
    """``forward``, ``backward``, ``interpolate`` (linear by row position) or ``constant``.

    What stays empty gets ``fill``.
    """
    constant = F.lit(float(fill))
    if method == "constant":
        return dense.withColumn("value", F.coalesce("value", constant))
    if method not in ("forward", "backward", "interpolate"):
        raise ValueError(f"unknown fill method {method!r}")
    near = known_neighbours(
        dense.select(*CELL, "value"), SERIES, "timestamp", "value", time_chunk("timestamp", chunk_seconds)
    )
    before, after = F.col("_prev.v"), F.col("_next.v")
    if method == "forward":
        value = F.coalesce("value", before, constant)
    elif method == "backward":
        value = F.coalesce("value", after, constant)
    else:
        share = F.try_divide(F.col("_row") - F.col("_prev.pos"), F.col("_next.pos") - F.col("_prev.pos"))
        value = F.coalesce("value", before + (after - before) * share, before, constant)
    return near.select(*CELL, value.alias("value"))


def clean(dense: DataFrame, threshold: float | None = 3.0, skip_null: bool = False, fill: float = 0.0) -> DataFrame:
    """Outliers to the median, then forward fill, then the constant."""
    if threshold:
        dense = outlier_replace(dense, threshold, skip_null)
    return fill_missing(dense, "forward", fill)


def zscore(dense: DataFrame, eps: float = 1e-8) -> DataFrame:
    """``(x - mean) / max(population deviation, eps)`` with the statistics used."""
    stats = dense.groupBy(*SERIES).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    stats = stats.withColumn("std", F.greatest("std", F.lit(eps)))
    return dense.join(stats, SERIES).select(
        *CELL, ((F.col("value") - F.col("mean")) / F.col("std")).alias("value"), "mean", "std"
    )


# --- resampling ------------------------------------------------------------------


def bins_between(bounds: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Rows ``(*keys, timestamp)`` for every bin from ``_first`` to ``_last``.

    Days are made first and spread over the cluster, bins within each day after that.
    """
    first, last = epoch_seconds("_first"), epoch_seconds("_last")
    span = max(DAY // seconds, 1) * seconds
    starts = bounds.withColumn("_start", F.explode(F.sequence(first, last, F.lit(span))))
    stop = F.least(F.col("_start") + (span - seconds), last)
    return (
        starts.repartition(*keys, "_start")
        .withColumn("_at", F.explode(F.sequence(F.col("_start"), stop, F.lit(seconds))))
        .withColumn("timestamp", seconds_to_ts("_at"))
        .drop("_first", "_last", "_start", "_at")
    )


def resample(cells: DataFrame, seconds: int = 60) -> DataFrame:
    """Mean per bin, with every bin from the instance's first to its last (empty: NULL)."""
    binned = (
        cells.withColumn("timestamp", time_floor("timestamp", seconds)).groupBy(*CELL).agg(F.avg("value").alias("value"))
    )
    bounds = binned.groupBy("instance_id").agg(
        F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"), F.collect_set("feature").alias("_own")
    )
    grid = bins_between(bounds, ["instance_id"], seconds).withColumn("feature", F.explode("_own")).select(*CELL)
    return grid.join(binned, CELL, "left")


def tumbling_windows(df: DataFrame, seconds: int = 60, ts: str = "timestamp") -> DataFrame:
    """Windows from the first time on while they start before the last time."""
    kind = df.schema[ts].dataType
    first, last = df.agg(F.min(epoch_micros(ts)), F.max(epoch_micros(ts))).first()
    step = int(seconds) * 1_000_000
    count = 0 if first is None else -(-(last - first) // step)
    at = lambda shift: F.timestamp_micros(F.lit(first) + (F.col("id") + shift) * step).cast(kind)
    return df.sparkSession.range(count).select(at(0).alias("window_start"), at(1).alias("window_end"))


def sort_by_time(df: DataFrame) -> DataFrame:
    """Range-partitioned sort by instance and time."""
    return df.orderBy("instance_id", "timestamp", *[c for c in ("feature",) if c in df.columns])


def metric_statistics(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*SERIES).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("count"),
    )
