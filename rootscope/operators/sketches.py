"""Span features that are stored per window and rolled up to longer windows without the raw spans.

Percentiles and distinct counts of a long window don't follow from those of short ones, but their
sketches merge: a KLL sketch holds ranks within a bound that its size ``k`` sets, a HyperLogLog
sketch a distinct count within one that ``lg`` sets.  Counts and sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.functions.scalars import time_floor
from rootscope.operators.traces import PERCENTILES

KEY = ["instance_id", "timestamp"]
#: Size of a KLL sketch: ranks are off by 1.33 % at most, with 99 % confidence.
KLL_SIZE = 200
#: log2 of the registers of a HyperLogLog sketch: a relative standard error of 1.6 %.
HLL_LOG2 = 12


def span_sketches(parsed: DataFrame, seconds: int = 60, k: int = KLL_SIZE, lg: int = HLL_LOG2) -> DataFrame:
    """One row per instance and window: counts, sums and sketches, to be stored."""
    size, log2 = F.lit(k), F.lit(lg)
    return parsed.withColumn("timestamp", time_floor("timestamp", seconds)).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if("is_error").alias("error_count"),
        F.sum("duration").alias("duration_sum"),
        F.count("duration").alias("duration_count"),
        F.kll_sketch_agg_double(F.col("duration").cast("double"), size).alias("durations"),
        F.hll_sketch_agg("trace_id", log2).alias("traces"),
        F.hll_sketch_agg("service_name", log2).alias("services"),
    )


def roll_up(sketches: DataFrame, seconds: int) -> DataFrame:
    """Sketches of longer windows; ``seconds`` is a multiple of the windows that are stored.

    Rolling up in steps gives the same counts, and sketches of the same bounds.
    """
    sums = [F.sum(c).alias(c) for c in ("request_count", "error_count", "duration_sum", "duration_count")]
    return sketches.withColumn("timestamp", time_floor("timestamp", seconds)).groupBy(*KEY).agg(
        *sums,
        F.kll_merge_agg_double("durations").alias("durations"),
        F.hll_union_agg("traces").alias("traces"),
        F.hll_union_agg("services").alias("services"),
    )


def _quantile(p: int) -> Column:
    """NULL of a window whose spans have no duration."""
    asked = F.when(F.col("duration_count") > 0, F.col("durations"))
    return F.kll_sketch_get_quantile_double(asked, F.lit(p / 100)).alias(f"p{p}_latency")


def sketched_features(sketches: DataFrame) -> DataFrame:
    """Counts, mean, percentiles and distinct counts of every row of sketches."""
    return sketches.select(
        *KEY,
        "request_count",
        "error_count",
        F.try_divide("duration_sum", "duration_count").alias("avg_latency"),
        *[_quantile(p) for p in PERCENTILES],
        F.hll_sketch_estimate("traces").alias("unique_trace_count"),
        F.hll_sketch_estimate("services").alias("unique_service_count"),
    )
