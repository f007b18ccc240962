"""Span queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootscope.operators import sketches as K
from rootscope.operators import traces as T
from rootscope.queries.adapters import MONTH, SIX_HOURS, rounded, spans_bulk, spans_flat, with_sql
from rootscope.session import materialise

_BIN = """instance_id, time_bucket(INTERVAL '6 hours', "timestamp", TIMESTAMP '1970-01-01') AS "timestamp" """
_BIN30 = """instance_id, time_bucket(INTERVAL '30 days', "timestamp", TIMESTAMP '1970-01-01') AS "timestamp" """
_RED = """count(*) AS request_count, count(*) FILTER (is_error) AS error_count,
    round(count(*) FILTER (is_error) / count(*), 6) AS error_rate, round(avg(duration), 6) AS avg_latency,
    round(max(duration), 6) AS max_latency, round(min(duration), 6) AS min_latency"""
_PCT = ", ".join(f"round(quantile_cont(duration, {p / 100}), 6) AS p{p}_latency" for p in T.PERCENTILES)
_STATUS = ", ".join(f"count(*) FILTER (status_code = '{c}') AS status_{c}_count" for c in T.STATUS_CODES)
_TYPE = ", ".join(f"count(*) FILTER (request_type = '{t}') AS {t}_request_count" for t in T.REQUEST_TYPES)
_DISTINCT = "count(DISTINCT trace_id) AS unique_trace_count, count(DISTINCT service_name) AS unique_service_count"
_ALL = ", ".join([_RED, _PCT, _STATUS, _TYPE, _DISTINCT])


def _sql(columns: str, bins: str = _BIN, source: str = "spans") -> str:
    return with_sql(source, f"SELECT {bins}, {columns} FROM {source} GROUP BY 1, 2")


def _stats_sql() -> str:
    wide = f"SELECT {_BIN}, {_ALL.replace('round(', '(').replace(', 6)', ')')} FROM spans GROUP BY 1, 2"
    long = " UNION ALL ".join(
        f"SELECT instance_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM wide" for f in T.FEATURES
    )
    return with_sql(
        "spans",
        """SELECT instance_id, feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
        round(max(value), 6) AS max, round(min(value), 6) AS min, round(sum(value), 6) AS sum FROM long GROUP BY 1, 2""",
        {"wide": wide, "long": long},
    )


RANK_OFF, COUNT_OFF = 0.02, 0.06


def _rollup(s, d):
    """Months from stored sketches of six hours; ``within`` says that ranks and distinct counts keep their bounds."""
    spans = spans_flat(s, d)
    stored = materialise(K.span_sketches(spans, SIX_HOURS), "sketches")
    rolled = K.sketched_features(K.roll_up(stored, MONTH))
    names = [f"p{p}_latency" for p in T.PERCENTILES]
    raw = T.windowed(spans, MONTH).join(rolled, T.KEYS)
    ranks = [F.avg((F.col("duration") <= F.col(n)).cast("int")).alias(f"upto_{n}") for n in names]
    ranks += [F.avg((F.col("duration") < F.col(n)).cast("int")).alias(f"below_{n}") for n in names]
    exact = raw.groupBy(*T.KEYS).agg(
        *ranks, F.count_distinct("trace_id").alias("n_traces"), F.count_distinct("service_name").alias("n_services")
    )
    within = F.abs(F.col("unique_trace_count") - F.col("n_traces")) <= COUNT_OFF * F.col("n_traces")
    within &= F.abs(F.col("unique_service_count") - F.col("n_services")) <= COUNT_OFF * F.col("n_services")
    for p, n in zip(T.PERCENTILES, names):
        within &= (F.col(f"upto_{n}") >= p / 100 - RANK_OFF) & (F.col(f"below_{n}") <= p / 100 + RANK_OFF)
    # a mean of sums and one of rows may differ in the last place: compared as floats
    mean = F.col("avg_latency").cast("float").cast("double").alias("avg_latency")
    found = rolled.join(exact, T.KEYS)
    return found.select(*T.KEYS, "request_count", "error_count", mean, "n_traces", "n_services", within.alias("within"))


QUERIES = {
    "trace_features": lambda s, d: rounded(T.trace_features(spans_flat(s, d), SIX_HOURS)),
    "trace_features_bulk": lambda s, d: rounded(T.trace_features(spans_bulk(s, d), MONTH)),
    "trace_red": lambda s, d: rounded(T.trace_red(spans_flat(s, d), SIX_HOURS)),
    "trace_percentiles": lambda s, d: rounded(T.trace_percentiles(spans_flat(s, d), SIX_HOURS)),
    "trace_status_counts": lambda s, d: T.trace_status_counts(spans_flat(s, d), SIX_HOURS),
    "trace_type_counts": lambda s, d: T.trace_type_counts(spans_flat(s, d), SIX_HOURS),
    "trace_distinct": lambda s, d: T.trace_distinct(spans_flat(s, d), SIX_HOURS),
    "trace_rollup": _rollup,
    "trace_stats": lambda s, d: rounded(T.trace_statistics(T.trace_features(spans_flat(s, d), SIX_HOURS))),
}

ORACLE = {
    "trace_features": _sql(_ALL),
    "trace_features_bulk": _sql(_ALL, _BIN30, "spans_bulk"),
    "trace_red": _sql(_RED),
    "trace_percentiles": _sql(_PCT),
    "trace_status_counts": _sql(_STATUS),
    "trace_type_counts": _sql(_TYPE),
    "trace_distinct": _sql(_DISTINCT),
    "trace_rollup": _sql(
        """count(*) AS request_count, count(*) FILTER (is_error) AS error_count, CAST(CAST(avg(duration) AS FLOAT) AS DOUBLE) AS avg_latency,
        count(DISTINCT trace_id) AS n_traces, count(DISTINCT service_name) AS n_services, true AS within""",
        _BIN30,
    ),
    "trace_stats": _stats_sql(),
}
