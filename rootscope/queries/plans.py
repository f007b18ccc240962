"""Whole chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootscope.operators import traces as T
from rootscope.operators.logs import with_instance
from rootscope.plans import diagnose as D
from rootscope.plans import features as P
from rootscope.queries.adapters import (
    MONTH, SIX_HOURS, cases, edges, logs_short, metrics_binned, nodes, rounded, spans_flat, table, with_sql,
)
from rootscope.queries.logs import RARE_BELOW, _WITH
from rootscope.queries.traces import _ALL, _BIN

DAY = 86_400


def _log_features(s, d):
    return P.log_features(with_instance(logs_short(s, d)), MONTH, minimum=RARE_BELOW)[0]


def _by_service(rows):
    """Each of the five fixture files as a batch of its own."""
    return P.by_file(rows.withColumn("file", F.concat(F.lit("f"), F.col("file"))))


def _date_batches(s, d):
    features, _ = P.log_features(_by_service(with_instance(logs_short(s, d))), MONTH, minimum=RARE_BELOW, scope="file")
    return P.split_scope(features).select("file", "instance_id", "timestamp", "feature", "value")


def _event_spans(s, d):
    return spans_flat(s, d).drop("instance_id").join(_svc_of_trace(s, d), "trace_id")


def _svc_of_trace(s, d):
    trace = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    svc = F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))
    return table(s, d, "events").select(trace.alias("trace_id"), svc.alias("instance_id")).distinct()


def _event_logs(s, d):
    ev = table(s, d, "events")
    svc = F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))
    return ev.select(
        svc.alias("instance_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type", F.lit(" on "), "props").alias("message"),
        F.col("event_id").alias("pos"),
    )


def _diagnose(s, d):
    metric = P.metric_features(metrics_binned(s, d), SIX_HOURS)
    log, _ = P.log_features(_event_logs(s, d), SIX_HOURS)
    trace = T.to_long(P.trace_features(_event_spans(s, d), SIX_HOURS), T.FEATURES)
    cube = D.build_cube(metric, log, trace, nodes(s, d))
    return D.diagnose(cube, cases(s, d), nodes(s, d), edges(s, d), 4, 1440)


QUERIES = {
    "log_features": _log_features,
    "trace_features_aligned": lambda s, d: rounded(P.trace_features(spans_flat(s, d), DAY)),
    "date_batches": _date_batches,
    "diagnose": lambda s, d: rounded(_diagnose(s, d)),
    "judge": lambda s, d: D.judge(_diagnose(s, d), cases(s, d)),
}

def _log_sql(by_file: bool) -> str:
    key = "file, " if by_file else ""
    on = "USING (file, n)" if by_file else "USING (n)"
    part = "PARTITION BY file " if by_file else ""
    texts = _WITH["texts"].replace("AS instance_id,", "AS instance_id, 'f' || file AS file,", 1)
    parts = {
        "flags": _WITH["flags"],
        "files": _WITH["files"],
        "texts": texts,
        "mined": f"""SELECT {key}n, row_number() OVER ({part}ORDER BY pos, text) - 1 AS template_id FROM (
            SELECT {key}len(string_split(text, ' ')) AS n, min(pos) AS pos, arg_min(text, (pos, text)) AS text FROM texts GROUP BY ALL)""",
        "assigned": f"SELECT t.*, template_id FROM (SELECT *, len(string_split(text, ' ')) AS n FROM texts) t JOIN mined {on}",
        "counts": f"""SELECT {key}instance_id, time_bucket(INTERVAL '30 days', "timestamp", TIMESTAMP '1970-01-01') AS "timestamp",
            'template_' || template_id AS feature, count(*) AS value FROM assigned GROUP BY ALL""",
        "dense": f"""SELECT * FROM (SELECT DISTINCT {key}instance_id, "timestamp" FROM counts)
            JOIN (SELECT DISTINCT {key}instance_id, feature FROM counts) USING ({key}instance_id)
            LEFT JOIN counts USING ({key}instance_id, "timestamp", feature)""",
        "merged": f"""SELECT {key}instance_id, "timestamp", CASE WHEN total < {RARE_BELOW} THEN 'RARE_TEMPLATES' ELSE feature END AS feature,
            CAST(sum(coalesce(value, 0)) AS BIGINT) AS value FROM dense
            JOIN (SELECT {key}instance_id, feature, sum(value) AS total FROM dense GROUP BY ALL) USING ({key}instance_id, feature) GROUP BY ALL""",
        "totals": f"SELECT {key}count(DISTINCT instance_id) AS total FROM merged {'GROUP BY file' if by_file else ''}",
        "seen": f"""SELECT {key}"timestamp", count(DISTINCT instance_id) AS n FROM merged GROUP BY ALL""",
        "shared": f"""SELECT {key}"timestamp" FROM seen JOIN totals {'USING (file)' if by_file else 'ON true'} WHERE n = total""",
    }
    keep = f"""SELECT {key}instance_id, "timestamp", feature, value FROM merged SEMI JOIN shared USING ({key}"timestamp")"""
    return with_sql("logs_short", keep, parts)


ORACLE = {
    "log_features": _log_sql(False),
    "date_batches": _log_sql(True),
    "trace_features_aligned": with_sql(
        "spans",
        """SELECT * FROM wide WHERE "timestamp" IN (SELECT "timestamp" FROM wide GROUP BY 1
        HAVING count(DISTINCT instance_id) = (SELECT count(DISTINCT instance_id) FROM wide))""",
        {"wide": f"SELECT {_BIN.replace('6 hours', '1 day')}, {_ALL} FROM spans GROUP BY 1, 2"},
    ),
}
