"""Source and sink queries: the tables are written as files in the shared scratch
folder, then read through the readers under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootscope.functions import scalars as S
from rootscope.operators import cube as C
from rootscope.operators import evaluate as E
from rootscope.operators import logs as L
from rootscope.operators import metrics as M
from rootscope.operators.traces import parse_spans
from rootscope.queries import scoring as Q
from rootscope.queries.metrics import ORACLE as METRICS
from rootscope.queries.adapters import (
    cases, groundtruth, logs_short, metrics_binned, metrics_long, rounded, spans, vectors, with_sql,
)
from rootscope.session import scratch_path
from rootscope.sources import files as R
from rootscope.sources import sinks as W
from rootscope.sources.cases import project_cases


def _csv(df, spark, label):
    path = scratch_path(spark, label)
    df.write.option("header", True).csv(path)
    return path


def _read_metrics(s, d):
    rows = metrics_long(s, d).withColumn("timestamp", F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6)
    table = _csv(rows.where("metric_name < 'p'"), s, "metric-csv")
    lines, columns = scratch_path(s, "metric-json"), scratch_path(s, "metric-parquet")
    rows.where("metric_name = 'purchase'").write.json(lines)
    metrics_long(s, d).where("metric_name > 'q'").write.parquet(columns)
    parts = [
        R.read_metrics(s, table, kind="csv"),
        R.read_metrics(s, lines, kind="json", json_lines=True),
        R.read_metrics(s, columns, kind="parquet"),
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _read_logs(s, d):
    rows = logs_short(s, d).select(F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("timestamp"), "service", "message")
    logs = R.read_logs(s, _csv(rows, s, "logs"), kind="csv")
    return L.with_instance(logs).select("timestamp", "instance_id", "message", "ts_ok")


def _raw_spans(s, d):
    """Spans as a collector would send them: camelCase, epoch milliseconds, tags."""
    return spans(s, d).select(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"),
        F.col("operation_name").alias("operationName"), F.col("service_name").alias("serviceName"),
        F.unix_millis(F.col("timestamp").cast("timestamp")).alias("startTime"), "duration",
        F.create_map(F.lit("http.status_code"), F.col("status_code"), F.lit("hostname"), F.col("instance_id")).alias("tags"),
    )


def _read_spans(s, d):
    path = scratch_path(s, "spans")
    _raw_spans(s, d).write.json(path)
    parsed = parse_spans(R.read_spans(s, path, json_lines=True, kind="json"))
    return rounded(parsed.withColumn("timestamp", F.date_trunc("second", "timestamp").cast("timestamp_ntz")))


def _read_groundtruth(s, d):
    path = scratch_path(s, "truth")
    # folders service=…/date=…, as a reader meets them
    rows = groundtruth(s, d).withColumns({"service": F.col("instance"), "day": F.substring("st_time", 1, 4)})
    rows.select("st_time", "instance", "anomaly_type", "service", "day").write.partitionBy("service", "day").option("header", True).csv(path)
    return project_cases(R.read_groundtruth(s, path, "*/*/*.csv"))


def _discover(s, d):
    root = scratch_path(s, "tree")
    days = metrics_binned(s, d).withColumns(
        {"date": F.date_format("timestamp", "yyyy-MM-dd"), "modality": F.element_at(F.array(F.lit("metric"), F.lit("log"), F.lit("trace")), F.col("timestamp").cast("timestamp").cast("long").cast("int") % 3 + 1)}
    )
    days.repartition("date").write.partitionBy("date", "modality").json(root)
    return R.discover_files(s, root).select("modality", "date").distinct()


#: Steps of time in one JSON document: a history is many documents, each of bounded size.
PER_DOCUMENT = 64


def _in_order(key, value):
    return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda r: r.getField(value))


def _blocks(s, d):
    """Vectors with the first step of their document; steps are numbered without gaps."""
    return vectors(s, d).withColumn("block", (F.floor(F.col("t_idx") / PER_DOCUMENT) * PER_DOCUMENT).cast("bigint"))


def _vector_file(s, d):
    """Vectors as JSON documents, one per node and block of time, made by Spark."""
    path = scratch_path(s, "vectors")
    docs = _blocks(s, d).groupBy("node_id", "block").agg(F.to_json(F.struct(_in_order("t_idx", "vec").alias("X"))).alias("value"))
    docs.write.partitionBy("block", "node_id").text(path)
    return path


def _first_step():
    return F.regexp_extract("_path", r"block=(\d+)/", 1).cast("bigint")


def _window_vectors(s, d):
    read = R.read_window_vectors(s, f"{_vector_file(s, d)}/*/*/*.txt", r"node_id=(\d+)/[^/]+$", _first_step())
    return rounded(
        read.select(F.col("instance").cast("int").alias("node_id"), F.col("t_idx").cast("bigint").alias("t_idx"), F.posexplode("vec").alias("i", "value"))
    )


def _metric_cube(s, d, instances=None):
    path = scratch_path(s, "cube")
    steps = _blocks(s, d).groupBy("block", "t_idx").agg(_in_order("node_id", "vec").alias("_nodes"))
    docs = steps.groupBy("block").agg(F.to_json(F.struct(_in_order("t_idx", "_nodes").alias("X"))).alias("value"))
    docs.write.partitionBy("block").text(path)
    return _points(R.read_metric_cube(s, f"{path}/*/*.txt", instances, _first_step()), "t_idx")


def _feature_documents(s, d):
    path = scratch_path(s, "feature")
    steps = _blocks(s, d).groupBy("block", "ts").agg(_in_order("node_id", "vec").alias("_nodes"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("ts").cast("string"), "_nodes")))
    steps.groupBy("block").agg(F.to_json(entries).alias("value")).select("value").write.text(path)
    return f"{path}/*.txt"


def _points(df, key):
    return rounded(df.select(key, "node_id", F.posexplode("vec").alias("i", "value")))


def _vector_csv(s, d):
    rows = vectors(s, d).select(F.col("ts").alias("timestamp"), F.col("vec").cast("string").alias("value"), "node_id")
    path = scratch_path(s, "vector-csv")
    rows.write.partitionBy("node_id").option("header", True).csv(path)
    read = R.read_vector_csv(s, f"{path}/*/*.csv", r"node_id=(\d+)/[^/]+$")
    return _points(read.withColumn("node_id", F.col("instance").cast("int")), "ts")


def _write_features(s, d):
    path = scratch_path(s, "features")
    W.write_features(metrics_binned(s, d).withColumn("date", F.date_format("timestamp", "yyyy-MM-dd")), path)
    back = s.read.parquet(path)
    return rounded(back.groupBy(F.col("date").cast("string").alias("date"), "instance_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


def _save_load(s, d):
    path = scratch_path(s, "saved")
    table = metrics_binned(s, d)
    W.save_processed(table, path, "json")
    return rounded(W.load_processed(s, path, "json", table.schema))


def _node_names(s, d):
    return vectors(s, d).select("node_id", F.concat(F.lit("n"), F.col("node_id").cast("string")).alias("node")).distinct()


def _write_results(s, d):
    path = scratch_path(s, "results")
    W.write_results(Q._ranked(s, d), cases(s, d), E.topk_accuracy(Q._ranked(s, d), cases(s, d)), path)
    back = R.load_features_table(s, path, "ranked")
    return back.select(F.col("case_id").cast("bigint").alias("case_id"), "cmdb_id", F.col("rank").cast("int").alias("rank"), "node")


def _trace_by_service(s, d):
    path = scratch_path(s, "by-service")
    rows = spans(s, d).select(
        "span_id", F.col("parent_span_id").alias("parent_id"), "service_name",
        F.col("service_name").alias("service"), F.date_format("timestamp", "yyyy-MM").alias("month"),
    )
    rows.write.partitionBy("service", "month").option("header", True).csv(path)
    read = R.read_trace_by_service(s, path, "*/*/*.csv")
    return read.select("folder_service", "date", "span_id", "parent_span_id", "service_name")


def _features_table(s, d):
    path = scratch_path(s, "tables")
    M.metric_statistics(metrics_binned(s, d)).write.option("header", True).csv(f"{path}/stats.csv")
    return rounded(R.load_features_table(s, path, "stats.csv").withColumn("count", F.col("count").cast("bigint")))


QUERIES = {
    "discover_trace_by_service": _trace_by_service,
    "load_features_table": _features_table,
    "read_metrics": _read_metrics,
    "read_logs": _read_logs,
    "read_spans": _read_spans,
    "discover_files": _discover,
    "read_groundtruth": _read_groundtruth,
    "read_window_vectors": _window_vectors,
    "read_metric_cube": lambda s, d: _metric_cube(s, d),
    "read_metric_cube_first": lambda s, d: _metric_cube(s, d, 7),
    "read_feature_json": lambda s, d: _points(R.read_feature_json(s, _feature_documents(s, d)), "ts"),
    "read_timestamp_axis": lambda s, d: C.timestamp_axis(vectors(s, d)),
    "read_vector_csv": _vector_csv,
    "write_features": _write_features,
    "save_load": _save_load,
    "write_cube": lambda s, d: W.write_cube(vectors(s, d).select("ts", "node_id", "vec"), _node_names(s, d), scratch_path(s, "cube")),
    "write_results": _write_results,
}

_POINTS = "CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS i, unnest(vec) AS value FROM vectors"

ORACLE = {
    "discover_trace_by_service": with_sql(
        "spans",
        """SELECT service_name AS folder_service, strftime("timestamp", '%Y-%m') AS date, span_id, parent_span_id, service_name FROM spans""",
    ),
    "load_features_table": METRICS["metric_stats"],
    "read_metrics": with_sql("metrics_long", 'SELECT instance_id, "timestamp", metric_name, round(value, 6) AS value FROM metrics_long'),
    "read_logs": with_sql(
        "logs_short",
        r"""SELECT "timestamp", service || '_' || coalesce(nullif(regexp_extract(message, '\|\s*([\d\.]+)\s*\|', 1), ''), 'NA') AS instance_id,
        message, true AS ts_ok FROM logs_short""",
    ),
    "read_spans": with_sql(
        "spans",
        """SELECT date_trunc('second', "timestamp")::TIMESTAMP AS "timestamp", trace_id, span_id, parent_span_id, service_name, instance_id, operation_name,
        round(duration, 6) AS duration, status_code, is_error, request_type FROM spans""",
    ),
    "discover_files": with_sql(
        "metrics_binned",
        """SELECT DISTINCT CASE CAST(epoch("timestamp") AS BIGINT) % 3 WHEN 0 THEN 'metric' WHEN 1 THEN 'log' ELSE 'trace' END AS modality,
        strftime("timestamp", '%Y-%m-%d') AS date FROM metrics_binned""",
    ),
    "read_groundtruth": Q.ORACLE["case_project"],
    "read_window_vectors": with_sql("vectors", f"SELECT node_id, t_idx, i, round(value, 6) AS value FROM (SELECT node_id, t_idx, {_POINTS})"),
    "read_metric_cube": with_sql("vectors", f"SELECT t_idx, node_id, i, round(value, 6) AS value FROM (SELECT node_id, t_idx, {_POINTS})"),
    "read_metric_cube_first": with_sql("vectors", f"SELECT t_idx, node_id, i, round(value, 6) AS value FROM (SELECT node_id, t_idx, {_POINTS}) WHERE node_id < 7"),
    "read_feature_json": with_sql("vectors", f"SELECT ts, node_id, i, round(value, 6) AS value FROM (SELECT node_id, ts, {_POINTS})"),
    "read_timestamp_axis": with_sql("vectors", "SELECT row_number() OVER (ORDER BY ts) - 1 AS t_idx, ts FROM (SELECT DISTINCT ts FROM vectors)"),
    "read_vector_csv": with_sql("vectors", f"SELECT ts, node_id, i, round(value, 6) AS value FROM (SELECT node_id, ts, {_POINTS})"),
    "write_features": with_sql(
        "metrics_binned",
        """SELECT strftime("timestamp", '%Y-%m-%d') AS date, instance_id, count(*) AS n, round(sum(value), 6) AS total FROM metrics_binned GROUP BY 1, 2""",
    ),
    "save_load": with_sql("metrics_binned", 'SELECT instance_id, "timestamp", feature, round(value, 6) AS value FROM metrics_binned'),
    "write_cube": with_sql(
        "vectors",
        """SELECT (SELECT string_agg('n' || node_id, ',' ORDER BY node_id) FROM (SELECT DISTINCT node_id FROM vectors)) AS service_order,
        count(DISTINCT ts) AS total_timestamps, min(ts) AS first_timestamp, max(ts) AS last_timestamp, 'generated' AS source FROM vectors""",
    ),
    "write_results": with_sql(
        "cases loss_long edges",
        "SELECT c.case_id, c.cmdb_id, CAST(r.rank AS INTEGER) AS rank, r.node FROM cases c LEFT JOIN ranked r ON r.case_id = c.case_id",
        Q._RANKED,
    ),
}
