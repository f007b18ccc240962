"""Cube and model queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rootscope.functions import scalars as S
from rootscope.functions import vectors as V
from rootscope.operators import cube as C
from rootscope.operators import model as M
from rootscope.operators import scoring as Q
from rootscope.queries.adapters import (
    CUBE_START, CUBE_STEP, cases, edges, groundtruth, loss_long, nodes, rounded, table, vectors, vectors_sparse, with_sql,
)
from rootscope.queries.scoring import _SERIES
from rootscope.sources.cases import project_cases

OUT_DIM = 4


def weights(n_in: int, n_out: int = OUT_DIM) -> list[list[float]]:
    return [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(n_out)] for i in range(n_in)]


def ring(s, d):
    """Ring over the ten cube nodes and a chord from 0 to 5."""
    ids = vectors(s, d).select(F.col("node_id").alias("src")).distinct()
    nxt = F.when(F.col("src") == 0, F.array(F.lit(1), F.lit(5))).otherwise(F.array((F.col("src") + 1) % 10))
    return ids.select("src", F.explode(nxt).alias("dst"))


def _modal(s, d, source, name):
    return source(s, d).select("ts", "node_id", F.col(name).alias("vec"))


def _points(df, *keys):
    return rounded(df.select(*keys, F.posexplode("vec").alias("i", "value")))


def _pairs(s, d):
    """A stand-in reconstruction: every vector read backwards at half size."""
    return vectors(s, d).withColumn("rebuilt", F.transform(F.reverse("vec"), lambda x: x * 0.5))


def _axis(s, d):
    return C.default_axis(vectors(s, d))


def _cube_nodes(s, d):
    return vectors(s, d).select("node_id").distinct()


def _ragged(s, d):
    """Vectors of different length; the first one is whole."""
    n = F.when(F.col("vec_id") == 0, 40).otherwise(20 + F.col("vec_id") % 45).cast("int")
    return vectors(s, d).withColumn("vec", F.slice("vec", F.lit(1), n))


def _truth(s, d):
    return project_cases(groundtruth(s, d), order="o_orderkey")


def _dated(s, d, dedupe=None):
    return C.attach_timestamps(vectors(s, d), _truth(s, d), ["order"], dedupe=dedupe)


def _stacked(s, d):
    rows = C.stack_instances(vectors(s, d)).select("t_idx", F.posexplode("nodes").alias("k", "n"))
    return _points(rows.select("t_idx", "n.node_id", "n.vec"), "t_idx", "node_id")


def _vec_parse(s, d):
    text = F.when(F.col("vec_id") % 5 == 0, F.element_at("vec", 1).cast("string")).otherwise(F.col("vec").cast("string"))
    return _points(vectors(s, d).select("vec_id", V.parse_vector(text).alias("vec")), "vec_id")


def _modal_strict(s, d):
    m, lg, t = (_modal(s, d, f, n) for f, n in ((vectors, "metric"), (vectors_sparse, "log"), (vectors, "trace")))
    return C.modal_gaps(m, lg, t)


def _reconstruct(s, d):
    return rounded(M.reconstruct(vectors(s, d).select("ts", "node_id", "vec"), ring(s, d), 8))


def _reconstruct_given(s, d):
    """Given components, the first eight axes: what is left are the other features."""
    whole = M.with_neighbours(vectors(s, d).select("ts", "node_id", "vec"), ring(s, d))
    mean, std = M.mean_and_deviation(whole)
    return rounded(M.Reconstruction(mean, std, np.eye(len(mean))[:, :8]).loss(whole))


CANDIDATES = M.weight_candidates(8, [1.0, 0.8, 0.5], [0.0, 0.5], [0.0, 0.5])


def _feedback_losses(s, d):
    small = loss_long(s, d).withColumn("loss", F.col("loss") / 1000.0)
    return rounded(M.feedback_losses(small, cases(s, d), nodes(s, d), edges(s, d), CANDIDATES, 360, 8))


def _best_weights(s, d):
    """The best candidate of the grid, where the fit starts."""
    small = loss_long(s, d).withColumn("loss", F.col("loss") / 1000.0)
    return rounded(M.best_candidate(M.feedback_losses(small, cases(s, d), nodes(s, d), edges(s, d), CANDIDATES, 360, 8), CANDIDATES))


def _fit_weights(s, d):
    """The whole fit: the loss of the grid, and whether that of the fitted weights, found anew, is no larger."""
    small = loss_long(s, d).withColumn("loss", F.col("loss") / 1000.0)
    given = (small, cases(s, d), nodes(s, d), edges(s, d))
    weights, pre, suc, _ = M.fit_feedback_weights(*given, 360, 8, steps=3, grid=CANDIDATES)
    both = M.feedback_losses(*given, [*CANDIDATES, (len(CANDIDATES), weights, pre, suc)], 360, 8)
    fitted = F.col("candidate") == len(CANDIDATES)
    grid = F.min(F.when(~fitted, F.col("loss")))
    no_worse = F.max(F.when(fitted, F.col("loss"))) <= grid + 1e-12
    return rounded(both.agg(grid.alias("grid_loss"), no_worse.alias("no_worse")))


QUERIES = {
    "modal_join": lambda s, d: _points(
        C.modal_join(*(_modal(s, d, f, n) for f, n in ((vectors, "metric"), (vectors_sparse, "log"), (vectors, "trace")))), "ts", "node_id"
    ),
    "modal_join_strict": _modal_strict,
    "dense_cube": lambda s, d: _points(C.dense_cube(vectors_sparse(s, d), _axis(s, d), _cube_nodes(s, d), "log"), "ts", "node_id"),
    "stack_instances": _stacked,
    "attach_timestamps": lambda s, d: _points(_dated(s, d), "t_idx", "ts", "node_id"),
    "attach_timestamps_last": lambda s, d: _points(_dated(s, d, "last"), "t_idx", "ts", "node_id"),
    "default_axis": lambda s, d: _axis(s, d),
    "vec_parse": _vec_parse,
    "vec_fit": lambda s, d: _points(C.fit_cube(_ragged(s, d)), "ts", "node_id"),
    "mask_modality": lambda s, d: _points(
        vectors(s, d).select("ts", "node_id", V.mask_range("vec", 40, 54).alias("vec")), "ts", "node_id"
    ),
    "oversample": lambda s, d: _points(C.oversample(vectors(s, d), 5), "copy_id", "ts", "node_id"),
    "cube_profile": lambda s, d: C.cube_profile(_ragged(s, d)),
    "modal_loss": lambda s, d: rounded(C.modal_loss(_pairs(s, d), C.modal_spans([40, 14, 10]))),
    "node_mse": lambda s, d: rounded(C.node_mse(_pairs(s, d))),
    "augment": lambda s, d: _points(C.augment(vectors(s, d), 0.2, 2, seed=3), "copy_id", "ts", "node_id"),
    "neighbour_sum": lambda s, d: rounded(
        M.neighbour_sum(vectors(s, d), ring(s, d)).select("ts", "node_id", F.posexplode("near").alias("i", "value"))
    ),
    "graph_conv": lambda s, d: _points(M.graph_conv(vectors(s, d), ring(s, d), [M.Layer(weights(64))]), "ts", "node_id"),
    "graph_conv_both": lambda s, d: _points(M.graph_conv(vectors_sparse(s, d), ring(s, d), [M.Layer(weights(64), norm="both")]), "ts", "node_id"),
    "reconstruct": _reconstruct,
    "reconstruct_given": _reconstruct_given,
    "reconstruct_full": lambda s, d: rounded(M.reconstruct(vectors(s, d).select("ts", "node_id", "vec"), ring(s, d), 128)),
    "feedback_losses": _feedback_losses,
    "best_feedback_weights": _best_weights,
    "fit_feedback_weights": _fit_weights,
    "date_to_epoch": lambda s, d: table(s, d, "orders")
    .select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    .distinct()
    .select("day", S.date_to_epoch("day").alias("epoch")),
}

_I = "CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS i, unnest(vec) AS value"


def _flat(keys: str, source: str) -> str:
    return f"SELECT {keys}, i, round(value, 6) AS value FROM (SELECT {keys}, {_I} FROM {source})"


_RAGGED = {
    "ragged": "SELECT vec_id, ts, node_id, vec[1:CASE WHEN vec_id = 0 THEN 40 ELSE 20 + vec_id % 45 END] AS vec FROM vectors",
}
_TRUTH = {
    "times": """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS t_idx,
        CAST(epoch(strptime(split_part(st_time, '.', 1), '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS ts FROM groundtruth""",
    "dated": "SELECT v.t_idx, coalesce(t.ts, 0) AS ts, v.node_id, v.vec FROM vectors v LEFT JOIN times t USING (t_idx)",
}
_PAIRS = {
    "cells": """SELECT ts, node_id, unnest(vec) AS x, unnest(list_reverse(vec)) * 0.5 AS y, generate_subscripts(vec, 1) - 1 AS i FROM vectors"""
}
_RING = {
    "ring": """SELECT DISTINCT node_id AS src, CAST((node_id + 1) % 10 AS INTEGER) AS dst FROM vectors UNION ALL SELECT 0, 5""",
    "cells": "SELECT ts, node_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM vectors",
    "near": """SELECT c.ts, r.dst AS node_id, c.i, sum(c.x) AS value FROM cells c JOIN ring r ON r.src = c.node_id GROUP BY 1, 2, 3""",
}


def _draw(*parts: str) -> str:
    mixed = f"CAST({3 * 31 + 17} AS BIGINT)"
    for p in parts:
        mixed = f"((({mixed} * 7919) + ({p}) * 104729 + 1299709) % 15485863)"
    return f"({mixed} * 48271 % 10007 < {int(0.2 * 10_007)})"


def _near(column: str, this: str, other: str) -> str:
    return f"""coalesce((SELECT max(o.score) FROM grid o JOIN edges e ON e.{other} = o.node_id WHERE e.{this} = g.node_id
        AND o.case_id = g.case_id AND o.candidate = g.candidate AND e.src <> e.dst), 0) AS {column}"""


_WEIGHTS = {
    **_SERIES,
    "candidates": " UNION ALL ".join(f"SELECT {i} AS candidate, {w} AS w, {p} AS p, {q} AS q" for i, w, p, q in CANDIDATES),
    "grid": """SELECT candidate, case_id, node, node_id, p, q, list_inner_product(series, CAST(w AS DOUBLE[])) / 1000 AS score
        FROM series JOIN nodes USING (node) CROSS JOIN candidates""",
    "near": f"SELECT g.*, {_near('smax', 'src', 'dst')}, {_near('pmax', 'dst', 'src')} FROM grid g",
    "soft": """SELECT candidate, case_id, node, node_id, exp(score + p * pmax + q * smax - max(score + p * pmax + q * smax) OVER w) AS e
        FROM near WINDOW w AS (PARTITION BY candidate, case_id)""",
    "scaled": """SELECT s.*, starts_with(node, cmdb_id) AS hit, (e - min(e) OVER w) / nullif(max(e) OVER w - min(e) OVER w, 0) AS v
        FROM soft s JOIN cases USING (case_id) WINDOW w AS (PARTITION BY candidate, case_id)""",
    "placed": """SELECT *, avg(v) FILTER (hit) OVER (PARTITION BY candidate, case_id) AS mu,
        row_number() OVER (PARTITION BY candidate, case_id ORDER BY v DESC, node_id) AS rk FROM scaled""",
}

_LOSSES = """SELECT candidate, avg(loss) AS loss FROM (SELECT CAST(candidate AS INTEGER) AS candidate, case_id,
        sum(greatest((v - mu) / rk, 0)) AS loss FROM placed GROUP BY 1, 2) GROUP BY 1"""

ORACLE = {
    "feedback_losses": with_sql(
        "cases loss_long edges", f"SELECT candidate, round(loss, 6) AS loss FROM ({_LOSSES})", _WEIGHTS
    ),
    "fit_feedback_weights": with_sql(
        "cases loss_long edges", f"SELECT round(min(loss), 6) AS grid_loss, true AS no_worse FROM ({_LOSSES}) l", _WEIGHTS
    ),
    "best_feedback_weights": with_sql(
        "cases loss_long edges",
        f"""SELECT candidate, CAST(pre AS DOUBLE) AS pre, CAST(suc AS DOUBLE) AS suc, round(loss, 6) AS loss FROM ({_LOSSES}) l
        JOIN (SELECT CAST(candidate AS INTEGER) AS candidate, p AS pre, q AS suc FROM candidates) USING (candidate)
        ORDER BY loss NULLS LAST, candidate LIMIT 1""",
        _WEIGHTS,
    ),
    "modal_join": with_sql("vectors", f"{_flat('ts, node_id', 'vectors')} WHERE ts IS NOT NULL AND (ts - {CUBE_START}) // {CUBE_STEP} * 10 + node_id IN (SELECT vec_id FROM vectors WHERE vec_id % 7 <> 0)"),
    "modal_join_strict": with_sql("vectors", "SELECT ts, node_id, 'log' AS missing FROM vectors WHERE vec_id % 7 = 0"),
    "dense_cube": with_sql(
        "vectors",
        f"""SELECT ts, node_id, i, round(value, 6) AS value FROM (SELECT ts, node_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS i, unnest(v) AS value FROM (
        SELECT t.ts, n.node_id, coalesce(s.log, [0.0 FOR x IN range(14)]) AS v FROM (SELECT DISTINCT ts, t_idx FROM vectors WHERE t_idx <= (SELECT max(t_idx) FROM vectors)) t
        CROSS JOIN (SELECT DISTINCT node_id FROM vectors) n LEFT JOIN sparse s ON s.ts = t.ts AND s.node_id = n.node_id))""",
        {"sparse": "SELECT * FROM vectors WHERE vec_id % 7 <> 0"},
    ),
    "stack_instances": with_sql("vectors", _flat("t_idx, node_id", "vectors")),
    "attach_timestamps": with_sql("vectors groundtruth", _flat("t_idx, ts, node_id", "dated"), _TRUTH),
    "attach_timestamps_last": with_sql(
        "vectors groundtruth",
        _flat("t_idx, ts, node_id", "lasts"),
        {**_TRUTH, "lasts": "SELECT ts, node_id, max(t_idx) AS t_idx, arg_max(vec, t_idx) AS vec FROM dated GROUP BY 1, 2"},
    ),
    "default_axis": with_sql(
        "vectors",
        f"SELECT t_idx, {CUBE_START} + t_idx * {CUBE_STEP} AS ts FROM (SELECT unnest(generate_series(0, max(t_idx))) AS t_idx FROM vectors)",
    ),
    "vec_parse": with_sql("vectors", _flat("vec_id", "(SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN vec[1:1] ELSE vec END AS vec FROM vectors)")),
    "vec_fit": with_sql(
        "vectors",
        _flat("ts, node_id", "(SELECT ts, node_id, list_concat(vec, [0.0 FOR x IN range(40)])[1:40] AS vec FROM ragged)"),
        _RAGGED,
    ),
    "mask_modality": with_sql(
        "vectors",
        f"SELECT ts, node_id, i, CASE WHEN i >= 40 AND i < 54 THEN 0 ELSE round(value, 6) END AS value FROM (SELECT ts, node_id, {_I} FROM vectors)",
    ),
    "oversample": with_sql(
        "vectors",
        f"SELECT CAST(c AS INTEGER) AS copy_id, f.* FROM ({_flat('ts, node_id', 'vectors')}) f CROSS JOIN (SELECT unnest(range(5)) AS c)",
    ),
    "cube_profile": with_sql(
        "vectors",
        """SELECT count(*) AS points, count(DISTINCT ts) AS times, count(DISTINCT node_id) AS nodes, min(ts) AS first_ts, max(ts) AS last_ts,
        CAST(min(len(vec)) AS INTEGER) AS min_dim, CAST(max(len(vec)) AS INTEGER) AS max_dim FROM ragged""",
        _RAGGED,
    ),
    "modal_loss": with_sql(
        "vectors",
        """SELECT round(sum(m), 6) AS loss FROM (SELECT CASE WHEN i < 40 THEN 0 WHEN i < 54 THEN 1 ELSE 2 END AS k, avg((x - y) * (x - y)) AS m FROM cells GROUP BY 1)""",
        _PAIRS,
    ),
    "node_mse": with_sql("vectors", "SELECT ts, node_id, round(avg((x - y) * (x - y)), 6) AS loss FROM cells GROUP BY 1, 2", _PAIRS),
    "augment": with_sql(
        "vectors",
        f"""SELECT CAST(copy_id AS INTEGER) AS copy_id, ts, node_id, i, CASE WHEN {_draw('copy_id', 't_idx', 'node_id')} OR {_draw('copy_id', 't_idx // 64', 'i')} THEN 0 ELSE round(value, 6) END AS value
        FROM (SELECT t_idx, ts, node_id, {_I} FROM vectors) CROSS JOIN (SELECT unnest([1, 2]) AS copy_id)""",
    ),
    "neighbour_sum": with_sql("vectors", "SELECT ts, node_id, CAST(i AS INTEGER) AS i, round(value, 6) AS value FROM near", _RING),
    "graph_conv": with_sql(
        "vectors",
        f"""SELECT ts, node_id, CAST(j AS INTEGER) AS i, round(CASE WHEN h > 0 THEN h ELSE 0.01 * h END, 6) AS value FROM (
        SELECT ts, node_id, j, sum(value * ((i * 7 + j * 3) % 11 - 5) / 10) AS h FROM near CROSS JOIN (SELECT unnest(range({OUT_DIM})) AS j) GROUP BY 1, 2, 3)""",
        _RING,
    ),
    "reconstruct_given": with_sql(
        "vectors",
        """SELECT ts, node_id, round(sum(z * z) / 128, 6) AS loss FROM (
        SELECT ts, node_id, i, (value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w ELSE 1 END AS z
        FROM (SELECT ts, node_id, i, value FROM own UNION ALL SELECT o.ts, o.node_id, o.i + 64, coalesce(n.value, 0) FROM own o LEFT JOIN near n USING (ts, node_id, i))
        WINDOW w AS (PARTITION BY i)) WHERE i >= 8 GROUP BY 1, 2""",
        {**_RING, "own": "SELECT ts, node_id, generate_subscripts(vec, 1) - 1 AS i, unnest(vec) AS value FROM vectors"},
    ),
    # with all components nothing is lost
    "reconstruct_full": with_sql("vectors", "SELECT ts, node_id, CAST(0 AS DOUBLE) AS loss FROM vectors"),
    "graph_conv_both": with_sql(
        "vectors vectors_sparse",
        f"""SELECT ts, node_id, CAST(j AS INTEGER) AS i, round(CASE WHEN h > 0 THEN h ELSE 0.01 * h END, 6) + 0.0 AS value FROM (
        SELECT p.ts, p.node_id, j, sum(coalesce(value, 0) * ((p.i * 7 + j * 3) % 11 - 5) / 10) AS h FROM points p LEFT JOIN scaled s
        ON s.ts = p.ts AND s.node_id = p.node_id AND s.i = p.i CROSS JOIN (SELECT unnest(range({OUT_DIM})) AS j) GROUP BY 1, 2, 3)""",
        {
            "ring": _RING["ring"],
            "links": """SELECT a.ts, src, dst FROM vectors_sparse a JOIN ring ON src = a.node_id
                JOIN vectors_sparse b ON b.ts = a.ts AND b.node_id = dst""",
            "outs": "SELECT ts, src, count(*) AS n FROM links GROUP BY 1, 2",
            "ins": "SELECT ts, dst, count(*) AS n FROM links GROUP BY 1, 2",
            "points": "SELECT ts, node_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM vectors_sparse",
            "scaled": """SELECT l.ts, l.dst AS node_id, p.i, sum(p.x / sqrt(o.n)) / sqrt(any_value(k.n)) AS value FROM links l
                JOIN points p ON p.ts = l.ts AND p.node_id = l.src JOIN outs o ON o.ts = l.ts AND o.src = l.src
                JOIN ins k ON k.ts = l.ts AND k.dst = l.dst GROUP BY 1, 2, 3""",
        },
    ),
    "date_to_epoch": """SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS epoch FROM orders""",
}
