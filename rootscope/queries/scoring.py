"""Case, score and evaluation queries.  Windows are six hours wide (360 minutes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootscope.operators import evaluate as E
from rootscope.operators import scoring as C
from rootscope.queries.adapters import cases, edges, groundtruth, loss_long, nodes, rounded, table, with_sql
from rootscope.sources.cases import project_cases

WINDOW = 360
HALF = WINDOW * 30
LENGTH = 8
PRE, SUC = 0.3, 0.2
WEIGHTS = [round(0.05 * (i + 1), 2) for i in range(LENGTH)]


def _samples(s, d):
    """Graph variant by day: several graphs over time."""
    return table(s, d, "events").select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.dayofmonth("ts").cast("bigint").alias("graph_id")
    )


def _ranked(s, d):
    return C.score_cases(loss_long(s, d), cases(s, d), nodes(s, d), edges(s, d), WINDOW, PRE, SUC)


def _series(s, d):
    return C.series_window(loss_long(s, d), cases(s, d), WINDOW, LENGTH)


def _labelled(s, d):
    means = C.case_window_mean(loss_long(s, d), cases(s, d), WINDOW)
    return means.join(C.case_labels(cases(s, d), nodes(s, d)), ["case_id", "node"])


_MEANS = {
    "means": f"""SELECT c.case_id, l.node, avg(l.loss) AS score FROM cases c JOIN loss_long l
    ON l.ts >= c."timestamp" - {HALF} AND l.ts < c."timestamp" + {HALF} GROUP BY 1, 2"""
}


def _near(column: str, this: str, other: str, source: str) -> str:
    return f"""coalesce((SELECT max(o.score) FROM {source} o JOIN edges e ON e.{other} = o.node_id
        WHERE e.{this} = g.node_id AND o.case_id = g.case_id AND e.src <> e.dst), 0) AS {column}"""


_RANKED = {
    **_MEANS,
    "grid": """SELECT c.case_id, n.node, n.node_id, m.score FROM cases c CROSS JOIN nodes n
        LEFT JOIN means m ON m.case_id = c.case_id AND m.node = n.node""",
    "near": f"SELECT g.*, {_near('smax', 'src', 'dst', 'grid')}, {_near('pmax', 'dst', 'src', 'grid')} FROM grid g",
    "total": f"SELECT case_id, node, node_id, score + {PRE} * smax + {SUC} * pmax AS score FROM near",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC NULLS LAST, node_id) AS INTEGER) AS rank FROM total",
}
_SERIES = {
    "per_ts": "SELECT node, ts, avg(loss) AS loss FROM loss_long GROUP BY 1, 2",
    "recent": f"""SELECT c.case_id, p.node, p.ts, p.loss, row_number() OVER (PARTITION BY c.case_id, p.node ORDER BY p.ts DESC) AS back
        FROM cases c JOIN per_ts p ON p.ts >= c."timestamp" - {HALF} AND p.ts < c."timestamp" + {HALF}""",
    "listed": f"SELECT case_id, node, list(loss ORDER BY ts) AS vals FROM recent WHERE back <= {LENGTH} GROUP BY 1, 2",
    "series": f"""SELECT case_id, node, list_concat(list_resize(CAST([] AS DOUBLE[]), {LENGTH} - len(vals), vals[1]), vals) AS series FROM listed""",
    "points": f"SELECT case_id, node, unnest(series) AS loss, generate_subscripts(series, 1) - 1 AS i FROM series",
}


def _weighted(weights) -> str:
    total = " + ".join(f"series[{i + 1}] * {w}" for i, w in enumerate(weights))
    return f"SELECT case_id, node, {total} AS score FROM series"


_FEEDBACK = {
    **_SERIES,
    "grid": f"SELECT s.case_id, s.node, n.node_id, s.score FROM ({_weighted(WEIGHTS)}) s JOIN nodes n USING (node)",
    "near": f"SELECT g.*, {_near('smax', 'src', 'dst', 'grid')}, {_near('pmax', 'dst', 'src', 'grid')} FROM grid g",
    "total": f"SELECT case_id, node, node_id, score + {PRE} * pmax + {SUC} * smax AS h FROM near",
    "soft": """SELECT case_id, node, node_id, exp(h - max(h) OVER (PARTITION BY case_id)) AS e FROM total""",
}
_FIRST = {
    **_RANKED,
    "firsts": """SELECT c.case_id, min(r.rank) FILTER (starts_with(r.node, c.cmdb_id)) AS first FROM cases c
        LEFT JOIN ranked r ON r.case_id = c.case_id AND r.rank <= 10 GROUP BY 1""",
}

QUERIES = {
    "case_project": lambda s, d: project_cases(groundtruth(s, d)),
    "case_window_join": lambda s, d: rounded(C.case_window_mean(loss_long(s, d), cases(s, d), WINDOW)),
    "graph_for_case": lambda s, d: C.graph_for_case(_samples(s, d), cases(s, d), WINDOW),
    "case_labels": lambda s, d: C.case_labels(cases(s, d), nodes(s, d)),
    "rank_nodes": lambda s, d: rounded(
        C.rank_nodes(C.case_window_mean(loss_long(s, d), cases(s, d), WINDOW).join(nodes(s, d), "node"))
    ),
    # means end in exact halves of a decimal place: compared as floats instead
    "score_cases": lambda s, d: _ranked(s, d).withColumn("score", F.col("score").cast("float").cast("double")),
    "topk_accuracy": lambda s, d: E.topk_accuracy(_ranked(s, d), cases(s, d)),
    "mrr": lambda s, d: E.mrr(_ranked(s, d), cases(s, d)),
    "ranking_loss": lambda s, d: rounded(C.ranking_loss(_labelled(s, d))),
    "series_window": lambda s, d: rounded(
        _series(s, d).select("case_id", "node", F.posexplode("series").alias("i", "loss"))
    ),
    "series_weighted": lambda s, d: rounded(C.series_weighted(_series(s, d), WEIGHTS, LENGTH)),
    "softmax": lambda s, d: rounded(C.softmax(C.series_weighted(_series(s, d), None, LENGTH))),
    "feedback_score": lambda s, d: rounded(
        C.feedback_score(loss_long(s, d), cases(s, d), nodes(s, d), edges(s, d), WINDOW, WEIGHTS, PRE, SUC, LENGTH)
    ),
    "head_samples": lambda s, d: rounded(E.head_samples(loss_long(s, d), 100, ["ts", "node", "loss"])),
    "case_split": lambda s, d: E.case_split(cases(s, d), 0.5).select("case_id", "split"),
    "case_split_disjoint": lambda s, d: E.case_split(cases(s, d), 12, disjoint=True).select("case_id", "split"),
    "loss_pivot": lambda s, d: rounded(_loss_pivot(s, d)),
}


def _loss_pivot(s, d):
    from rootscope.operators.cube import loss_pivot

    return loss_pivot(loss_long(s, d), [f"svc{i}" for i in range(5)])


ORACLE = {
    "case_project": with_sql(
        "groundtruth",
        """SELECT CAST(epoch(strptime(split_part(st_time, '.', 1), '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS "timestamp",
        'WARNING' AS level, instance AS cmdb_id, anomaly_type AS failure_type FROM groundtruth""",
    ),
    "case_window_join": with_sql("cases loss_long", "SELECT case_id, node, round(score, 6) AS score FROM means", _MEANS),
    "graph_for_case": with_sql(
        "cases",
        f"""SELECT c.case_id, coalesce(arg_max(s.graph_id, s.ts), (SELECT arg_min(graph_id, ts) FROM samples)) AS graph_id
        FROM cases c LEFT JOIN samples s ON s.ts >= c."timestamp" - {HALF} AND s.ts < c."timestamp" + {HALF} GROUP BY c.case_id""",
        {"samples": "SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(max(day(ts)) AS BIGINT) AS graph_id FROM events GROUP BY 1"},
    ),
    "case_labels": with_sql(
        "cases nodes", "SELECT case_id, node, node_id, CAST(starts_with(node, cmdb_id) AS INTEGER) AS label FROM cases CROSS JOIN nodes"
    ),
    "rank_nodes": with_sql(
        "cases loss_long nodes",
        """SELECT m.node, case_id, round(score, 6) AS score, node_id,
        CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM means m JOIN nodes USING (node)""",
        _MEANS,
    ),
    "score_cases": with_sql(
        "cases loss_long edges", "SELECT case_id, node, node_id, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, rank FROM ranked", _RANKED
    ),
    "topk_accuracy": with_sql(
        "cases loss_long edges",
        """SELECT CAST(k AS INTEGER) AS k, (SELECT round(avg(CASE WHEN first <= k THEN 1 ELSE 0 END), 8) FROM firsts) AS accuracy
        FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k)""",
        _FIRST,
    ),
    "mrr": with_sql("cases loss_long edges", "SELECT round(avg(coalesce(1.0 / first, 0)), 8) AS mrr FROM firsts", _FIRST),
    "ranking_loss": with_sql(
        "cases loss_long nodes",
        "SELECT round(avg(loss), 6) AS loss FROM (SELECT case_id, sum(greatest((s - mu) / rk, 0)) AS loss FROM placed GROUP BY 1)",
        {
            **_MEANS,
            "labelled": """SELECT m.*, n.node_id, starts_with(m.node, c.cmdb_id) AS hit FROM means m JOIN nodes n USING (node) JOIN cases c USING (case_id)""",
            "scaled": """SELECT *, (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) AS s FROM labelled
                WINDOW w AS (PARTITION BY case_id)""",
            "placed": """SELECT *, avg(s) FILTER (hit) OVER (PARTITION BY case_id) AS mu,
                row_number() OVER (PARTITION BY case_id ORDER BY s DESC, node_id) AS rk FROM scaled""",
        },
    ),
    "series_window": with_sql(
        "cases loss_long", "SELECT case_id, node, CAST(i AS INTEGER) AS i, round(loss, 6) AS loss FROM points", _SERIES
    ),
    "series_weighted": with_sql(
        "cases loss_long", f"SELECT case_id, node, round(score, 6) AS score FROM ({_weighted(WEIGHTS)})", _SERIES
    ),
    "softmax": with_sql(
        "cases loss_long",
        f"""SELECT case_id, node, round(e / sum(e) OVER (PARTITION BY case_id), 6) AS score FROM (
        SELECT case_id, node, exp(score - max(score) OVER (PARTITION BY case_id)) AS e FROM ({_weighted([1 / LENGTH] * LENGTH)}))""",
        _SERIES,
    ),
    "feedback_score": with_sql(
        "cases loss_long edges",
        """SELECT case_id, node, node_id, round(score, 6) AS score,
        CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, node_id) AS INTEGER) AS rank
        FROM (SELECT case_id, node, node_id, e / sum(e) OVER (PARTITION BY case_id) AS score FROM soft)""",
        _FEEDBACK,
    ),
    "head_samples": with_sql(
        "loss_long", "SELECT ts, node, round(loss, 6) AS loss FROM loss_long ORDER BY ts, node, loss LIMIT 100"
    ),
    "case_split": with_sql(
        "cases",
        """SELECT case_id, 'feedback' AS split FROM (SELECT case_id, row_number() OVER (ORDER BY case_id) AS rn, count(*) OVER () AS n FROM cases)
        WHERE rn <= floor(n * 0.5) UNION ALL SELECT case_id, 'test' FROM cases""",
    ),
    "case_split_disjoint": with_sql(
        "cases",
        "SELECT case_id, CASE WHEN row_number() OVER (ORDER BY case_id) <= 12 THEN 'feedback' ELSE 'test' END AS split FROM cases",
    ),
    "loss_pivot": with_sql(
        "loss_long",
        "SELECT ts, "
        + ", ".join(f"round(avg(loss) FILTER (node = 'svc{i}'), 6) AS svc{i}" for i in range(5))
        + " FROM loss_long GROUP BY ts",
    ),
}
