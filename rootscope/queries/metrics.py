"""Metric and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootscope.operators import align as A
from rootscope.operators import metrics as M
from rootscope.plans.features import metric_features
from rootscope.queries.adapters import (
    SIX_HOURS,
    metrics_binned,
    metrics_long,
    metrics_uneven,
    rounded,
    with_sql,
)

KINDS = ["click", "error", "purchase", "signup", "view"]

DENSE = {
    "own": "SELECT DISTINCT instance_id, feature FROM metrics_binned",
    "axis": 'SELECT DISTINCT instance_id, "timestamp" FROM metrics_binned',
    "dense": """SELECT own.instance_id, axis."timestamp", own.feature, m.value FROM own
        JOIN axis ON own.instance_id = axis.instance_id
        LEFT JOIN metrics_binned m ON m.instance_id = own.instance_id AND m.feature = own.feature AND m."timestamp" = axis."timestamp" """,
}


def _dense(s, d):
    return M.dense_cells(metrics_binned(s, d))


def _dense_sql(body: str, extra: dict | None = None) -> str:
    return with_sql("metrics_binned", body, {**DENSE, **(extra or {})})


_OUT = 'instance_id, "timestamp", feature'
_SERIES_W = "PARTITION BY instance_id, feature"
_STATS = {
    "stats": """SELECT instance_id, feature, avg(value) AS mu, stddev_pop(value) AS sd, median(value) AS med,
        count(value) AS known, count(*) AS cells FROM dense GROUP BY 1, 2"""
}


def _outlier(parity: bool) -> str:
    gap = " AND known = cells" if parity else ""
    return f"coalesce(sd > 0 AND abs(value - mu) / nullif(sd, 0) > 3{gap}, false)"


_INTERPOLATED = {
    "numbered": f'SELECT *, row_number() OVER ({_SERIES_W} ORDER BY "timestamp") AS rn FROM dense',
    "near": f"""SELECT *, last_value(value IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS pr,
        first_value(value IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER n AS nr
        FROM numbered WINDOW p AS ({_SERIES_W} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        n AS ({_SERIES_W} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
}

_RESAMPLE = {
    "bounds": """SELECT instance_id, min("timestamp") AS lo, max("timestamp") AS hi FROM metrics_binned GROUP BY 1""",
    "grid": """SELECT instance_id, unnest(generate_series(lo, hi, INTERVAL '6 hours')) AS "timestamp" FROM bounds""",
    "own": DENSE["own"],
}

# the whole chain on the uneven fixture, gaps of outlier statistics skipped
_CHAIN = {
    "common": """SELECT feature FROM metrics_uneven GROUP BY feature
        HAVING count(DISTINCT instance_id) = (SELECT count(DISTINCT instance_id) FROM metrics_uneven)""",
    "axis": 'SELECT DISTINCT instance_id, "timestamp" FROM metrics_uneven',
    "dense": """SELECT axis.instance_id, axis."timestamp", common.feature, m.value FROM axis CROSS JOIN common
        LEFT JOIN metrics_uneven m ON m.instance_id = axis.instance_id AND m.feature = common.feature AND m."timestamp" = axis."timestamp" """,
    **_STATS,
    "fixed": f"""SELECT {_OUT}, CASE WHEN {_outlier(False)} THEN med ELSE value END AS value
        FROM dense JOIN stats USING (instance_id, feature)""",
    "filled": f"""SELECT {_OUT}, coalesce(last_value(value IGNORE NULLS) OVER ({_SERIES_W} ORDER BY "timestamp"
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS value FROM fixed""",
    "bounds": 'SELECT instance_id, min("timestamp") AS lo, max("timestamp") AS hi FROM filled GROUP BY 1',
    "grid": """SELECT instance_id, unnest(generate_series(lo, hi, INTERVAL '6 hours')) AS "timestamp" FROM bounds""",
    "sampled": """SELECT grid.instance_id, grid."timestamp", common.feature, filled.value FROM grid CROSS JOIN common
        LEFT JOIN filled ON filled.instance_id = grid.instance_id AND filled."timestamp" = grid."timestamp" AND filled.feature = common.feature""",
    "shared": """SELECT "timestamp" FROM sampled GROUP BY 1
        HAVING count(DISTINCT instance_id) = (SELECT count(DISTINCT instance_id) FROM sampled)""",
}

QUERIES = {
    "metric_pivot": lambda s, d: rounded(M.pivot_wide(M.average_cells(metrics_long(s, d)), KINDS)),
    "metric_resample": lambda s, d: rounded(
        M.resample(metrics_long(s, d).withColumnRenamed("metric_name", "feature"), SIX_HOURS)
    ),
    "schema_intersection": lambda s, d: rounded(M.dense_cells(metrics_uneven(s, d), "intersection")),
    "schema_union": lambda s, d: rounded(M.dense_cells(metrics_uneven(s, d), "union")),
    "align_intersection": lambda s, d: rounded(A.align_intersection(metrics_binned(s, d))),
    "align_union": lambda s, d: rounded(A.align_union(metrics_binned(s, d))),
    "ffill": lambda s, d: rounded(M.fill_missing(_dense(s, d), "forward")),
    "bfill": lambda s, d: rounded(M.fill_missing(_dense(s, d), "backward")),
    "interpolate": lambda s, d: rounded(M.fill_missing(_dense(s, d), "interpolate")),
    "const_fill": lambda s, d: rounded(M.fill_missing(_dense(s, d), "constant", -1.0)),
    "outlier_mask": lambda s, d: rounded(M.outlier_mask(_dense(s, d), skip_null=True)),
    "outlier_mask_parity": lambda s, d: rounded(M.outlier_mask(_dense(s, d))),
    "outlier_replace": lambda s, d: rounded(M.outlier_replace(_dense(s, d), skip_null=True)),
    "zscore": lambda s, d: rounded(M.zscore(metrics_binned(s, d))),
    "tumbling_windows": lambda s, d: M.tumbling_windows(metrics_long(s, d), SIX_HOURS),
    "sort_ts": lambda s, d: rounded(M.sort_by_time(metrics_binned(s, d))),
    "metric_stats": lambda s, d: rounded(M.metric_statistics(metrics_binned(s, d))),
    "ts_lookup": lambda s, d: rounded(
        A.at_time(metrics_binned(s, d), "2024-01-10 12:00:00").select(
            "instance_id", "timestamp", F.posexplode("vec").alias("i", "value")
        )
    ),
    "concat_by_instance": lambda s, d: rounded(
        A.concat_files([metrics_binned(s, d).where("feature < 'f'"), metrics_binned(s, d).where("feature >= 'f'")])
        .groupBy("instance_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))
    ),
    "metric_features": lambda s, d: rounded(metric_features(metrics_uneven(s, d), SIX_HOURS, skip_null=True)),
}

ORACLE = {
    "metric_pivot": with_sql(
        "metrics_long",
        'SELECT instance_id, "timestamp", '
        + ", ".join(f"round(avg(value) FILTER (metric_name = '{k}'), 6) AS {k}" for k in KINDS)
        + " FROM metrics_long GROUP BY 1, 2",
    ),
    "metric_resample": with_sql(
        "metrics_binned",
        """SELECT g.instance_id, g."timestamp", o.feature, round(m.value, 6) AS value FROM grid g
        JOIN own o ON g.instance_id = o.instance_id LEFT JOIN metrics_binned m
        ON m.instance_id = g.instance_id AND m."timestamp" = g."timestamp" AND m.feature = o.feature""",
        _RESAMPLE,
    ),
    "schema_intersection": with_sql(
        "metrics_uneven", f"SELECT {_OUT}, round(value, 6) AS value FROM dense", {k: _CHAIN[k] for k in ("common", "axis", "dense")}
    ),
    "schema_union": with_sql(
        "metrics_uneven",
        """SELECT axis.instance_id, axis."timestamp", n.feature,
        CASE WHEN o.feature IS NULL THEN 0 ELSE round(m.value, 6) END AS value
        FROM axis CROSS JOIN (SELECT DISTINCT feature FROM metrics_uneven) n
        LEFT JOIN own o ON o.instance_id = axis.instance_id AND o.feature = n.feature
        LEFT JOIN metrics_uneven m ON m.instance_id = axis.instance_id AND m.feature = n.feature AND m."timestamp" = axis."timestamp" """,
        {"own": "SELECT DISTINCT instance_id, feature FROM metrics_uneven", "axis": _CHAIN["axis"]},
    ),
    "align_intersection": with_sql(
        "metrics_binned",
        f"""SELECT {_OUT}, round(value, 6) AS value FROM metrics_binned WHERE "timestamp" IN (
        SELECT "timestamp" FROM metrics_binned GROUP BY 1
        HAVING count(DISTINCT instance_id) = (SELECT count(DISTINCT instance_id) FROM metrics_binned))""",
    ),
    "align_union": with_sql(
        "metrics_binned",
        """SELECT m.instance_id, m."timestamp", m.feature, round(m.value, 6) AS value FROM metrics_binned m
        UNION ALL SELECT o.instance_id, t."timestamp", o.feature, NULL FROM own o
        CROSS JOIN (SELECT DISTINCT "timestamp" FROM metrics_binned) t
        WHERE NOT EXISTS (SELECT 1 FROM metrics_binned x WHERE x.instance_id = o.instance_id AND x."timestamp" = t."timestamp")""",
        {"own": DENSE["own"]},
    ),
    "ffill": _dense_sql(
        f"""SELECT {_OUT}, round(coalesce(last_value(value IGNORE NULLS) OVER ({_SERIES_W} ORDER BY "timestamp"
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS value FROM dense"""
    ),
    "bfill": _dense_sql(
        f"""SELECT {_OUT}, round(coalesce(first_value(value IGNORE NULLS) OVER ({_SERIES_W} ORDER BY "timestamp"
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS value FROM dense"""
    ),
    "interpolate": _dense_sql(
        f"""SELECT {_OUT}, round(coalesce(value, pv + (nv - pv) * ((rn - pr) / nullif(nr - pr, 0)), pv, 0), 6) AS value FROM near""",
        _INTERPOLATED,
    ),
    "const_fill": _dense_sql(f"SELECT {_OUT}, round(coalesce(value, -1), 6) AS value FROM dense"),
    "outlier_mask": _dense_sql(
        f"SELECT {_OUT}, round(value, 6) AS value, {_outlier(False)} AS is_outlier FROM dense JOIN stats USING (instance_id, feature)",
        _STATS,
    ),
    "outlier_mask_parity": _dense_sql(
        f"SELECT {_OUT}, round(value, 6) AS value, {_outlier(True)} AS is_outlier FROM dense JOIN stats USING (instance_id, feature)",
        _STATS,
    ),
    "outlier_replace": _dense_sql(
        f"""SELECT {_OUT}, round(CASE WHEN {_outlier(False)} THEN med ELSE value END, 6) AS value
        FROM dense JOIN stats USING (instance_id, feature)""",
        _STATS,
    ),
    "zscore": with_sql(
        "metrics_binned",
        f"""SELECT {_OUT}, round((value - mu) / greatest(sd, 1e-8), 6) AS value, round(mu, 6) AS mean, round(greatest(sd, 1e-8), 6) AS std
        FROM metrics_binned JOIN (SELECT instance_id, feature, avg(value) AS mu, stddev_pop(value) AS sd FROM metrics_binned GROUP BY 1, 2)
        USING (instance_id, feature)""",
    ),
    "tumbling_windows": with_sql(
        "metrics_long",
        """SELECT w AS window_start, w + INTERVAL '6 hours' AS window_end FROM (
        SELECT unnest(generate_series(lo, hi, INTERVAL '6 hours')) AS w, hi FROM (
        SELECT min("timestamp") AS lo, max("timestamp") AS hi FROM metrics_long)) WHERE w < hi""",
    ),
    "sort_ts": with_sql("metrics_binned", f"SELECT {_OUT}, round(value, 6) AS value FROM metrics_binned ORDER BY 1, 2, 3"),
    "metric_stats": with_sql(
        "metrics_binned",
        """SELECT instance_id, feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
        round(max(value), 6) AS max, count(value) AS count FROM metrics_binned GROUP BY 1, 2""",
    ),
    "ts_lookup": with_sql(
        "metrics_binned",
        f"""SELECT instance_id, "timestamp", CAST(row_number() OVER (PARTITION BY instance_id, "timestamp" ORDER BY feature) - 1 AS INTEGER) AS i,
        round(value, 6) AS value FROM metrics_binned WHERE "timestamp" = TIMESTAMP '2024-01-10 12:00:00'""",
    ),
    "concat_by_instance": with_sql(
        "metrics_binned",
        "SELECT instance_id, count(*) AS rows, round(sum(value), 6) AS total FROM metrics_binned GROUP BY 1",
    ),
    "metric_features": with_sql(
        "metrics_uneven",
        f"""SELECT {_OUT}, round(value, 6) AS value FROM sampled WHERE "timestamp" IN (SELECT "timestamp" FROM shared)""",
        _CHAIN,
    ),
}
