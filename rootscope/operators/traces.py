"""Call-trace spans to window features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootscope.functions import scalars as S
from rootscope.operators.spread import grouped_quantiles

# What is counted per window.
STATUS_CODES = ["200", "404", "500", "503"]
REQUEST_TYPES = ["http", "rpc", "db"]
PERCENTILES = [50, 90, 95, 99]

KEYS = ["instance_id", "timestamp"]
RED = ["request_count", "error_count", "error_rate", "avg_latency", "max_latency", "min_latency"]
FEATURES = (
    RED
    + [f"p{p}_latency" for p in PERCENTILES]
    + [f"status_{c}_count" for c in STATUS_CODES]
    + [f"{t}_request_count" for t in REQUEST_TYPES]
    + ["unique_trace_count", "unique_service_count"]
)


def parse_spans(spans: DataFrame, tz: str = "UTC", use_direct_fields: bool = False) -> DataFrame:
    """Normalised spans (``sources.spans``) to the eleven parsed columns.

    ``use_direct_fields`` lets ``instance_id``, ``host`` and ``hostname`` columns of the
    span decide the instance.
    """
    tags, process = F.col("tags"), F.col("process")
    process_tags = process.getField("tags")
    start, end = S.ts_normalise("start_time", tz), S.ts_normalise("end_time", tz)
    service = S.span_service(F.col("service_name"), process.getField("serviceName"), process_tags, tags)
    direct = [F.col(c) for c in ("instance_id", "host", "hostname") if c in spans.columns]
    status = S.span_status(F.col("status_code"), tags)
    return spans.select(
        start.alias("timestamp"),
        "trace_id",
        "span_id",
        "parent_span_id",
        service.alias("service_name"),
        S.span_instance(service, process_tags, tags, direct if use_direct_fields else None).alias("instance_id"),
        F.coalesce("operation_name", F.lit("unknown")).alias("operation_name"),
        S.span_duration(F.col("duration"), start, end).alias("duration"),
        status.alias("status_code"),
        S.span_is_error(status, tags).alias("is_error"),
        S.span_request_type(F.col("operation_name"), tags).alias("request_type"),
    ).where(F.col("timestamp").isNotNull())


def windowed(parsed: DataFrame, seconds: int = 60) -> DataFrame:
    return parsed.withColumn("timestamp", S.time_floor("timestamp", seconds))


def _count(condition) -> F.Column:
    return F.count_if(condition).cast("bigint")


def red_columns() -> list:
    n, errors = F.count(F.lit(1)), F.count_if(F.col("is_error"))
    return [
        n.alias("request_count"),
        errors.alias("error_count"),
        S.error_rate(errors, n).alias("error_rate"),
        F.avg("duration").alias("avg_latency"),
        F.max("duration").alias("max_latency"),
        F.min("duration").alias("min_latency"),
    ]


def status_columns() -> list:
    return [_count(F.col("status_code") == c).alias(f"status_{c}_count") for c in STATUS_CODES]


def type_columns() -> list:
    return [_count(F.col("request_type") == t).alias(f"{t}_request_count") for t in REQUEST_TYPES]


def trace_red(parsed: DataFrame, seconds: int = 60) -> DataFrame:
    return windowed(parsed, seconds).groupBy(*KEYS).agg(*red_columns())


def trace_status_counts(parsed: DataFrame, seconds: int = 60) -> DataFrame:
    return windowed(parsed, seconds).groupBy(*KEYS).agg(*status_columns())


def trace_type_counts(parsed: DataFrame, seconds: int = 60) -> DataFrame:
    return windowed(parsed, seconds).groupBy(*KEYS).agg(*type_columns())


def trace_percentiles(parsed: DataFrame, seconds: int = 60, accuracy: str = "exact") -> DataFrame:
    """Latency percentiles; ``accuracy='approx'`` trades exactness for one light pass."""
    names = {f"p{p}_latency": p / 100 for p in PERCENTILES}
    rows = windowed(parsed, seconds).select(*KEYS, "duration")
    if accuracy == "approx":
        found = rows.groupBy(*KEYS).agg(F.percentile_approx("duration", list(names.values())).alias("_p"))
        return found.select(*KEYS, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])
    return grouped_quantiles(rows, KEYS, "duration", names)


def trace_distinct(parsed: DataFrame, seconds: int = 60, accuracy: str = "exact") -> DataFrame:
    count = F.approx_count_distinct if accuracy == "approx" else F.count_distinct
    return (
        windowed(parsed, seconds)
        .groupBy(*KEYS)
        .agg(count("trace_id").alias("unique_trace_count"), count("service_name").alias("unique_service_count"))
    )


def trace_features(parsed: DataFrame, seconds: int = 60, accuracy: str = "exact") -> DataFrame:
    """All nineteen features per instance and observed window.

    The counting aggregate shrinks on the map side; distinct counts spread a hot
    window over its trace ids; percentiles are ordered per value range.
    """
    count = F.approx_count_distinct if accuracy == "approx" else F.count_distinct
    # services are few: a set per window, so that only one distinct count splits the rows
    counted = (
        windowed(parsed, seconds)
        .groupBy(*KEYS)
        .agg(
            *red_columns(),
            *status_columns(),
            *type_columns(),
            count("trace_id").alias("unique_trace_count"),
            F.size(F.collect_set("service_name")).cast("bigint").alias("unique_service_count"),
        )
    )
    percentiles = trace_percentiles(parsed, seconds, accuracy)
    return counted.join(percentiles, KEYS, "left").select(*KEYS, *FEATURES)


def trace_statistics(features: DataFrame) -> DataFrame:
    """Per instance and feature: mean, sample deviation, max, min, sum."""
    long = to_long(features, FEATURES)
    return long.groupBy("instance_id", "feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.max("value").alias("max"),
        F.min("value").alias("min"),
        F.sum("value").alias("sum"),
    )


def to_long(wide: DataFrame, features: list[str]) -> DataFrame:
    """Wide feature columns to ``(instance_id, timestamp, feature, value)``."""
    doubled = wide.select(*KEYS, *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    return doubled.unpivot(KEYS, features, "feature", "value")
