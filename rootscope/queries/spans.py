"""Span field queries: raw fields are derived from ``events`` so that every rule and
precedence occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootscope.functions import scalars as S
from rootscope.operators.traces import parse_spans
from rootscope.queries.adapters import rounded, table


def _map(*pairs):
    """A map of the entries whose condition holds."""
    entries = F.array(*[F.when(cond, F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, cond, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def _raw(s, d):
    id_ = F.col("event_id")
    ev = table(s, d, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = (
        F.when(id_ % 6 == 0, F.floor(micros / 1_000_000).cast("string"))
        .when(id_ % 6 == 1, F.floor(micros / 1000).cast("string"))
        .when(id_ % 6 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(id_ % 6 == 3, F.lit("0"))
        .when(id_ % 6 == 4, F.lit(""))
        .otherwise(F.lit("not a time"))
    )
    seconds = F.floor(micros / 1_000_000)
    op = F.element_at(F.array(*[F.lit(x) for x in OPERATIONS]), (id_ % len(OPERATIONS) + 1).cast("int"))
    return ev.select(
        "event_id",
        start.alias("start_time"),
        F.when(id_ % 2 == 0, (seconds + id_ % 9).cast("string")).alias("end_time"),
        F.when(id_ % 3 == 0, F.col("value").cast("string")).alias("duration"),
        F.when(id_ % 2 == 0, F.lit("direct")).when(id_ % 4 == 1, F.lit("")).alias("service_name"),
        F.struct(
            F.when(id_ % 3 == 0, F.lit("process")).alias("serviceName"),
            _map(("service.name", id_ % 5 == 0, F.lit("ptag")), ("host.name", id_ % 4 == 0, F.lit("phost"))).alias("tags"),
        ).alias("process"),
        _map(
            ("service", id_ % 7 == 0, F.lit("stag")),
            ("component", id_ % 11 == 0, F.lit("java-grpc")),
            ("hostname", id_ % 3 == 0, F.lit("thost")),
            ("pod.name", id_ % 5 == 0, F.lit("tpod")),
            ("http.status_code", id_ % 7 < 2, F.lit("404.0")),
            ("error", id_ % 9 < 2, F.when(id_ % 9 == 0, F.lit("true")).otherwise(F.lit("false"))),
        ).alias("tags"),
        F.when(id_ % 13 < 4, F.element_at(F.array(F.lit("200"), F.lit("500.0"), F.lit("302"), F.lit("abc")), (id_ % 13 % 4 + 1).cast("int"))).alias("status_code"),
        F.when(id_ % 17 != 0, op).alias("operation_name"),
        F.lit(None).cast("string").alias("trace_id"),
        id_.cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
    )


OPERATIONS = ["GET /a", "budget.refresh", "Grpc.Call", "SELECT sql", "db.find", "cron", "HTTP rpc", "rpc db"]
KINDS = ["http", "http", "rpc", "db", "db", None, "http", "rpc"]

_SERVICE = """CASE WHEN event_id % 2 = 0 THEN 'direct' WHEN event_id % 3 = 0 THEN 'process' WHEN event_id % 5 = 0 THEN 'ptag'
    WHEN event_id % 7 = 0 THEN 'stag' WHEN event_id % 11 = 0 THEN 'java-grpc' ELSE 'unknown' END"""
_INSTANCE = f"""CASE WHEN event_id % 4 = 0 THEN 'phost' WHEN event_id % 3 = 0 THEN 'thost' WHEN event_id % 5 = 0 THEN 'tpod'
    ELSE ({_SERVICE}) || '_instance' END"""
_STATUS = """CASE WHEN event_id % 13 < 4 THEN (['200', '500', '302', 'abc'])[event_id % 13 % 4 + 1]
    WHEN event_id % 7 < 2 THEN '404' ELSE '200' END"""
_ERROR = f"(left({_STATUS}, 1) IN ('4', '5') OR event_id % 9 = 0)"
_KIND = f"""coalesce(CASE WHEN event_id % 17 <> 0 THEN ([{', '.join('NULL' if k is None else f"'{k}'" for k in KINDS)}])[event_id % {len(KINDS)} + 1] END,
    CASE WHEN event_id % 11 = 0 THEN 'rpc' END, 'unknown')"""
_START = """CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('milliseconds', ts)
    WHEN 2 THEN date_trunc('second', ts) END"""
_END = "CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) + to_seconds(event_id % 9) END"
_DURATION = f"coalesce(CASE WHEN event_id % 3 = 0 THEN value END, (epoch_us({_END}) - epoch_us({_START})) / 1000.0, 0)"
_OP = f"([{', '.join(repr(o) for o in OPERATIONS)}])[event_id % {len(OPERATIONS)} + 1]"


def _cols():
    process, tags = F.col("process"), F.col("tags")
    service = S.span_service(F.col("service_name"), process.getField("serviceName"), process.getField("tags"), tags)
    status = S.span_status(F.col("status_code"), tags)
    start, end = S.ts_normalise("start_time"), S.ts_normalise("end_time")
    return {
        "ts": start,
        "service": service,
        "instance": S.span_instance(service, process.getField("tags"), tags),
        "status": status,
        "is_error": S.span_is_error(status, tags),
        "kind": S.span_request_type(F.col("operation_name"), tags),
        "duration": S.span_duration(F.col("duration"), start, end),
    }


def _one(name):
    return lambda s, d: rounded(_raw(s, d).select("event_id", _cols()[name].alias(name)))


def _parsed(s, d):
    return rounded(parse_spans(_raw(s, d)).drop("trace_id", "parent_span_id"))


QUERIES = {
    "ts_normalise": _one("ts"),
    "span_service": _one("service"),
    "span_instance": _one("instance"),
    "span_status": _one("status"),
    "span_is_error": _one("is_error"),
    "span_request_type": _one("kind"),
    "span_duration": _one("duration"),
    "span_filter": lambda s, d: parse_spans(_raw(s, d)).select("span_id", "timestamp"),
    "span_normalise": _parsed,
    "time_floor": lambda s, d: table(s, d, "events").select("event_id", S.time_floor("ts", 60).alias("bin")),
    "error_rate": lambda s, d: rounded(
        table(s, d, "events").groupBy("user_id").agg(
            F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") != "view").alias("requests")
        ).select("user_id", "errors", "requests", S.error_rate("errors", "requests").alias("error_rate"))
    ),
}


def _sql(expr: str, name: str) -> str:
    return f"SELECT event_id, {expr} AS {name} FROM events"


ORACLE = {
    "ts_normalise": _sql(_START, "ts"),
    "span_service": _sql(_SERVICE, "service"),
    "span_instance": _sql(_INSTANCE, "instance"),
    "span_status": _sql(_STATUS, "status"),
    "span_is_error": _sql(_ERROR, "is_error"),
    "span_request_type": _sql(_KIND, "kind"),
    "span_duration": _sql(f"round({_DURATION}, 6)", "duration"),
    "span_filter": f'SELECT CAST(event_id AS VARCHAR) AS span_id, {_START} AS "timestamp" FROM events WHERE ({_START}) IS NOT NULL',
    "span_normalise": f"""SELECT {_START} AS "timestamp", CAST(event_id AS VARCHAR) AS span_id, {_SERVICE} AS service_name,
        {_INSTANCE} AS instance_id, coalesce(CASE WHEN event_id % 17 <> 0 THEN {_OP} END, 'unknown') AS operation_name,
        round({_DURATION}, 6) AS duration, {_STATUS} AS status_code, {_ERROR} AS is_error, {_KIND} AS request_type
        FROM events WHERE ({_START}) IS NOT NULL""",
    "time_floor": "SELECT event_id, time_bucket(INTERVAL '60 seconds', ts, TIMESTAMP '1970-01-01') AS bin FROM events",
    "error_rate": """SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type <> 'view') AS requests,
        round(coalesce(count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type <> 'view'), 0), 0), 6) AS error_rate
        FROM events GROUP BY 1""",
}
