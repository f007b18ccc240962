"""Fault cases from ground-truth rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_cases(truth: DataFrame, tz: str = "UTC", **keep: str) -> DataFrame:
    """``(timestamp, level, cmdb_id, failure_type)``; fractions of a second are dropped.

    ``tz`` is the zone the times were written in.  ``keep`` maps extra output names to
    columns, for example an order column.
    """
    whole = F.to_timestamp(F.substring_index("st_time", ".", 1), "yyyy-MM-dd HH:mm:ss")
    return truth.select(
        F.unix_seconds(F.to_utc_timestamp(whole, tz)).alias("timestamp"),
        F.lit("WARNING").alias("level"),
        F.col("instance").alias("cmdb_id"),
        F.col("anomaly_type").alias("failure_type"),
        *[F.col(c).alias(name) for name, c in keep.items()],
    )
