"""The driver's tables in the shape of telemetry, for Spark and as SQL.

Each adapter is a projection stated twice: a DataFrame function and a common table
expression with the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootscope.functions.scalars import epoch_seconds, time_floor
from rootscope.operators.spread import previous_in_group, time_chunk

SIX_HOURS = 21_600
MONTH = 2_592_000
CUBE_START = 1_651_334_400
CUBE_STEP = 300


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _svc(c: str, n: int) -> F.Column:
    return F.concat(F.lit("svc"), (F.col(c) % n).cast("string"))


def metrics_long(spark, sf):
    return table(spark, sf, "events").select(
        _svc("user_id", 5).alias("instance_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("metric_name"),
        "value",
    )


def metrics_binned(spark, sf):
    return (
        metrics_long(spark, sf)
        .groupBy("instance_id", time_floor("timestamp", SIX_HOURS).alias("timestamp"), F.col("metric_name").alias("feature"))
        .agg(F.avg("value").alias("value"))
    )


def metrics_uneven(spark, sf):
    return metrics_binned(spark, sf).where("NOT (instance_id = 'svc4' AND feature = 'signup')")


def logs_short(spark, sf):
    used = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"]
    li = table(spark, sf, "lineitem").select(*used)
    body = F.concat(
        F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" line "), F.col("l_linenumber").cast("string"),
        F.lit(" status "), "l_returnflag", "l_linestatus",
    )
    ip = F.concat(F.lit("| 10.0.0."), (F.col("l_suppkey") % 4).cast("string"), F.lit(" | "))
    return li.select(
        _svc("l_suppkey", 5).alias("service"),
        F.col("l_shipdate").alias("timestamp"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat(ip, body)).otherwise(body).alias("message"),
        # a total order that needs no shuffle
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
        (F.col("l_suppkey") % 5).cast("string").alias("file"),
    )


def logs_long(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "message"))
    minutes = F.expr("make_dt_interval(0, 0, cast(doc_id AS INT), 0)")
    return lines.select(
        F.col("source").alias("service"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes).alias("timestamp"),
        "message",
        (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("pos"),
    )


def spans(spark, sf):
    """Parsed spans: eleven columns."""
    ev = table(spark, sf, "events")
    trace = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    r = F.col("event_id") % 20
    op = F.col("event_id") % 4
    status = F.when(r == 0, "500").when(r == 1, "404").when(r == 2, "503").when(r == 3, "302").otherwise("200")
    operation = F.when(op == 0, "GET /x").when(op == 1, "grpc.call").when(op == 2, "db.select").otherwise("cron")
    kind = F.when(op == 0, "http").when(op == 1, "rpc").when(op == 2, "db").otherwise("unknown")
    plain = ev.select(
        F.col("ts").alias("timestamp"),
        trace.alias("trace_id"),
        "event_id",
        F.col("event_id").cast("string").alias("span_id"),
        F.col("event_type").alias("service_name"),
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 2).cast("string")).alias("instance_id"),
        operation.alias("operation_name"),
        F.col("value").alias("duration"),
        status.alias("status_code"),
        status.rlike("^[45]").alias("is_error"),
        kind.alias("request_type"),
    )
    # the parent is the span before in the trace, one user's day
    order = ["timestamp", "event_id"]
    return previous_in_group(plain, ["trace_id"], order, "span_id", time_chunk("timestamp", 3600), "parent_span_id").drop(
        "event_id"
    )


def spans_flat(spark, sf):
    """Spans without parents: no window needed."""
    ev = table(spark, sf, "events")
    r = F.col("event_id") % 20
    op = F.col("event_id") % 4
    status = F.when(r == 0, "500").when(r == 1, "404").when(r == 2, "503").when(r == 3, "302").otherwise("200")
    kind = F.when(op == 0, "http").when(op == 1, "rpc").when(op == 2, "db").otherwise("unknown")
    return ev.select(
        F.col("ts").alias("timestamp"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"),
        F.col("event_type").alias("service_name"),
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 2).cast("string")).alias("instance_id"),
        F.col("value").alias("duration"),
        status.alias("status_code"),
        status.rlike("^[45]").alias("is_error"),
        kind.alias("request_type"),
    )


def spans_bulk(spark, sf):
    li = table(spark, sf, "lineitem")
    code = F.col("l_orderkey") % 4
    status = F.when(code == 0, "500").when(code == 1, "404").otherwise("200")
    kind = F.when(F.col("l_returnflag") == "A", "http").when(F.col("l_returnflag") == "N", "rpc").otherwise("db")
    return li.select(
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_orderkey").cast("string").alias("trace_id"),
        F.col("l_returnflag").alias("service_name"),
        _svc("l_suppkey", 20).alias("instance_id"),
        F.col("l_extendedprice").alias("duration"),
        status.alias("status_code"),
        status.rlike("^[45]").alias("is_error"),
        kind.alias("request_type"),
    )


def vectors(spark, sf):
    em = table(spark, sf, "embeddings")
    full = F.col("embedding").cast("array<double>")
    t = F.floor(F.col("vec_id") / 10).cast("bigint")
    return em.select(
        "vec_id",
        t.alias("t_idx"),
        (t * CUBE_STEP + CUBE_START).alias("ts"),
        (F.col("vec_id") % 10).cast("int").alias("node_id"),
        F.slice(full, 1, 40).alias("metric"),
        F.slice(full, 41, 14).alias("log"),
        F.slice(full, 55, 10).alias("trace"),
        full.alias("vec"),
    )


def vectors_sparse(spark, sf):
    return vectors(spark, sf).where("vec_id % 7 <> 0")


def groundtruth(spark, sf):
    return (
        table(spark, sf, "orders")
        .select(
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00:00.123")).alias("st_time"),
            _svc("o_custkey", 10).alias("instance"),
            F.col("o_orderpriority").alias("anomaly_type"),
            "o_orderkey",
        )
    )


def cases(spark, sf):
    return (
        table(spark, sf, "events")
        .where("event_type = 'error'")
        .select(
            F.col("event_id").alias("case_id"),
            epoch_seconds("ts").alias("timestamp"),
            _svc("user_id", 5).alias("cmdb_id"),
        )
    )


def loss_long(spark, sf):
    return table(spark, sf, "events").select(
        epoch_seconds("ts").alias("ts"), _svc("user_id", 5).alias("node"), F.col("value").alias("loss")
    )


def nodes(spark, sf):
    """The five service nodes, numbered by the residue that names them."""
    return (
        table(spark, sf, "events")
        .select(_svc("user_id", 5).alias("node"), (F.col("user_id") % 5).cast("int").alias("node_id"))
        .distinct()
    )


def edges(spark, sf):
    """Ring over the nodes, and one chord."""
    ids = nodes(spark, sf).select(F.col("node_id").alias("src"))
    nxt = F.when(F.col("src") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array((F.col("src") + 1) % 5))
    return ids.select("src", F.explode(nxt).alias("dst"))


SQL = {
    "metrics_long": """SELECT 'svc' || (user_id % 5) AS instance_id, ts AS "timestamp",
        event_type AS metric_name, value FROM events""",
    "metrics_binned": """SELECT instance_id, time_bucket(INTERVAL '6 hours', "timestamp", TIMESTAMP '1970-01-01') AS "timestamp",
        metric_name AS feature, avg(value) AS value FROM metrics_long GROUP BY 1, 2, 3""",
    "metrics_uneven": """SELECT * FROM metrics_binned WHERE NOT (instance_id = 'svc4' AND feature = 'signup')""",
    "logs_short": """SELECT 'svc' || (l_suppkey % 5) AS service, l_shipdate AS "timestamp",
        (CASE WHEN l_partkey % 3 <> 0 THEN '| 10.0.0.' || (l_suppkey % 4) || ' | ' ELSE '' END)
        || 'order ' || l_orderkey || ' line ' || l_linenumber || ' status ' || l_returnflag || l_linestatus AS message,
        l_orderkey * 8 + l_linenumber AS pos, CAST(l_suppkey % 5 AS VARCHAR) AS file FROM lineitem""",
    "spans": """SELECT ts AS "timestamp", user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id,
        CAST(event_id AS VARCHAR) AS span_id,
        lag(CAST(event_id AS VARCHAR)) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS parent_span_id,
        event_type AS service_name, event_type || '-' || (user_id % 2) AS instance_id,
        CASE event_id % 4 WHEN 0 THEN 'GET /x' WHEN 1 THEN 'grpc.call' WHEN 2 THEN 'db.select' ELSE 'cron' END AS operation_name,
        value AS duration,
        CASE event_id % 20 WHEN 0 THEN '500' WHEN 1 THEN '404' WHEN 2 THEN '503' WHEN 3 THEN '302' ELSE '200' END AS status_code,
        event_id % 20 < 3 AS is_error,
        CASE event_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'rpc' WHEN 2 THEN 'db' ELSE 'unknown' END AS request_type FROM events""",
    "spans_bulk": """SELECT l_shipdate AS "timestamp", CAST(l_orderkey AS VARCHAR) AS trace_id, l_returnflag AS service_name,
        'svc' || (l_suppkey % 20) AS instance_id, l_extendedprice AS duration,
        CASE l_orderkey % 4 WHEN 0 THEN '500' WHEN 1 THEN '404' ELSE '200' END AS status_code,
        l_orderkey % 4 < 2 AS is_error,
        CASE l_returnflag WHEN 'A' THEN 'http' WHEN 'N' THEN 'rpc' ELSE 'db' END AS request_type FROM lineitem""",
    "vectors": """SELECT vec_id, vec_id // 10 AS t_idx, (vec_id // 10) * 300 + 1651334400 AS ts,
        CAST(vec_id % 10 AS INTEGER) AS node_id, v[1:40] AS metric, v[41:54] AS log, v[55:64] AS trace, v AS vec
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
    "vectors_sparse": "SELECT * FROM vectors WHERE vec_id % 7 <> 0",
    "groundtruth": """SELECT strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00.123' AS st_time, 'svc' || (o_custkey % 10) AS instance,
        o_orderpriority AS anomaly_type, o_orderkey FROM orders""",
    "cases": """SELECT event_id AS case_id, CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp", 'svc' || (user_id % 5) AS cmdb_id
        FROM events WHERE event_type = 'error'""",
    "loss_long": """SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, 'svc' || (user_id % 5) AS node, value AS loss FROM events""",
    "nodes": """SELECT DISTINCT 'svc' || (user_id % 5) AS node, CAST(user_id % 5 AS INTEGER) AS node_id FROM events""",
    "edges": """SELECT node_id AS src, CAST((node_id + 1) % 5 AS INTEGER) AS dst FROM nodes
        UNION ALL SELECT node_id, 2 FROM nodes WHERE node_id = 0""",
}

# what each expression reads
NEEDS = {
    "metrics_binned": ["metrics_long"],
    "metrics_uneven": ["metrics_binned"],
    "vectors_sparse": ["vectors"],
    "edges": ["nodes"],
}


def with_sql(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the common table expressions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({SQL[n]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six places, other columns as they are."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c, 6) + F.lit(0.0)).alias(name) if kind == "double" and name not in keep else c)
    return df.select(*out)
