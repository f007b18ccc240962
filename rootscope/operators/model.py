"""Reconstruction of the cube, and the search for scoring weights.

Network training is not part of the library.  A reconstruction is either a principal
component model fitted by Spark, or graph layers with weights the caller brings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootscope.functions.vectors import mse
from rootscope.operators.scoring import case_labels, distinct_cases, series_window
from rootscope.session import materialise

POINT = ["ts", "node_id"]


def neighbour_sum(cube: DataFrame, edges: DataFrame) -> DataFrame:
    """Per point the element-wise sum of the vectors of its in-neighbours.

    Sums shrink on the map side, so a node with very many neighbours stays small.
    Points without an in-neighbour are absent.
    """
    pairs = cube.join(edges.select(F.col("src").alias("node_id"), "dst"), "node_id")
    total = Summarizer.sum(array_to_vector("vec"))
    return (
        pairs.groupBy("ts", F.col("dst").alias("node_id"))
        .agg(total.alias("_sum"))
        .select(*POINT, vector_to_array("_sum").alias("near"))
    )


#: Numbers that a matrix of vectors holds at most, unless a single vector has more.
_NUMBERS = 1 << 20


def _blocks(batches):
    """Slices of Arrow batches with their vectors as a matrix, so memory does not grow with the batch."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("vec"))
        if batch.num_rows and (sizes.null_count or pc.min(sizes).as_py() != pc.max(sizes).as_py()):
            raise ValueError("vectors of different length")
        rows = max(1, _NUMBERS // max(1, sizes[0].as_py())) if batch.num_rows else 1
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, pc.list_flatten(part.column("vec")).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _with_vectors(part: pa.RecordBatch, matrix: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
    vec = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(matrix).ravel()))
    return pa.RecordBatch.from_arrays([part.column("ts"), part.column("node_id"), vec], [*POINT, "vec"])


# --- graph layers with given weights ---------------------------------------------


@dataclass
class Layer:
    """``weight`` is (inputs × outputs); ``norm`` is ``none`` or ``both`` (by root of degrees)."""

    weight: list[list[float]]
    bias: list[float] | None = None
    norm: str = "none"


def graph_conv(cube: DataFrame, edges: DataFrame, layers: list[Layer], slope: float = 0.01) -> DataFrame:
    """Graph layers in turn: sum over in-neighbours, linear map, leaky ReLU.

    The graph of a time is that of the nodes which have a vector then: links count for sums
    and degrees only where both ends exist.  Each layer is one join along the edges and one
    grouping, which sums before it shuffles, for graphs of any size; only degrees, one row per
    point, are stored.
    """
    points = cube.select(*POINT, "vec")
    pairs = edges.select("src", "dst").distinct()
    degrees = _degrees(points, pairs) if any(layer.norm == "both" for layer in layers) else {}

    def scaled(table: DataFrame, side: str) -> DataFrame:
        root = F.sqrt(F.coalesce("_deg", F.lit(1)))
        return table.join(degrees[side], POINT, "left").select(*POINT, F.transform("vec", lambda x: x / root).alias("vec"))

    now = points
    for layer in layers:
        near = neighbour_sum(scaled(now, "src") if layer.norm == "both" else now, pairs)
        zero = F.transform("vec", lambda x: x * 0.0)
        # sums for nodes without a vector of their own fall away here
        got = now.join(near, POINT, "left").select(*POINT, F.coalesce("near", zero).alias("vec"))
        got = scaled(got, "dst") if layer.norm == "both" else got
        now = dense_layers(got, [layer], slope=slope)
        if layer is not layers[-1]:
            now = materialise(now, "layer")
    return now


def _degrees(points: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Links that leave and reach each point, both ends present."""
    here = points.select(*POINT)
    links = (
        here.withColumnRenamed("node_id", "src")
        .join(pairs, "src")
        .join(here.withColumnRenamed("node_id", "dst"), ["ts", "dst"])
    )
    return {
        side: materialise(links.groupBy("ts", F.col(side).alias("node_id")).agg(F.count(F.lit(1)).alias("_deg")), "degrees")
        for side in ("src", "dst")
    }


def dense_layers(
    cube: DataFrame, layers: list[Layer], activated: list[bool] | None = None, slope: float = 0.01
) -> DataFrame:
    """Linear layers per point, without a graph: no shuffle.

    ``activated`` tells which layers are followed by a leaky ReLU (default: all).
    """
    activated = activated or [True] * len(layers)
    shared = cube.sparkSession.sparkContext.broadcast(
        [(np.asarray(x.weight), None if x.bias is None else np.asarray(x.bias), a) for x, a in zip(layers, activated)]
    )

    def run(batches):
        for part, h in _blocks(batches):
            for weight, bias, active in shared.value:
                h = h @ weight if bias is None else h @ weight + bias
                h = np.where(h > 0, h, slope * h) if active else h
            yield _with_vectors(part, h)

    return cube.select(*POINT, "vec").mapInArrow(run, "ts bigint, node_id int, vec array<double>")


def reconstruction_loss(cube: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``(ts, node_id, loss)`` of two cubes."""
    other = rebuilt.select(*POINT, F.col("vec").alias("_rebuilt"))
    return cube.join(other, POINT).select(*POINT, mse("vec", "_rebuilt").alias("loss"))


# --- principal components --------------------------------------------------------


def with_neighbours(cube: DataFrame, edges: DataFrame) -> DataFrame:
    """Vectors followed by the sum over in-neighbours (zeros without any)."""
    near = neighbour_sum(cube, edges)
    zero = F.transform("vec", lambda x: x * 0.0)
    return cube.join(near, POINT, "left").select(*POINT, F.concat("vec", F.coalesce("near", zero)).alias("vec"))


def _scales(mean, std) -> tuple[np.ndarray, np.ndarray]:
    mean, std = np.asarray(mean), np.asarray(std)
    return mean, np.where(std > 0, std, 1.0)


def _standardised(cube: DataFrame, mean, std) -> DataFrame:
    """Means and deviations go to the tasks as arrays: vectors may be very wide."""
    shared = cube.sparkSession.sparkContext.broadcast(_scales(mean, std))

    def run(batches):
        centre, scale = shared.value
        for part, x in _blocks(batches):
            yield _with_vectors(part, (x - centre) / scale)

    return cube.select(*POINT, "vec").mapInArrow(run, "ts bigint, node_id int, vec array<double>")


@dataclass
class Reconstruction:
    """``components`` is (features × components), with orthonormal columns."""

    mean: list[float]
    std: list[float]
    components: np.ndarray

    def loss(self, cube: DataFrame) -> DataFrame:
        """``(ts, node_id, loss)``: squared error left after projecting on the components.

        Standardised in the same pass, by one worker per task.
        """
        shared = cube.sparkSession.sparkContext.broadcast((*_scales(self.mean, self.std), self.components))

        def run(batches):
            centre, scale, components = shared.value
            for part, x in _blocks(batches):
                x = (x - centre) / scale
                left = x - (x @ components) @ components.T
                yield pa.RecordBatch.from_arrays([part.column("ts"), part.column("node_id"), pa.array((left**2).mean(axis=1))], [*POINT, "loss"])

        return cube.select(*POINT, "vec").mapInArrow(run, "ts bigint, node_id int, loss double")


#: Further directions beside the wanted ones, most passes over the data, and when to stop.
EXTRA, PASSES, CLOSE = 8, 30, 1e-7


def _gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """XᵀX times a narrow block, in one pass: tasks add up (features × columns), Spark adds the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    width = block.shape[1]

    def run(batches):
        total = None
        for _, x in _blocks(batches):
            here = x.T @ (x @ shared.value)
            total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total))), "part": pa.array(list(total))})

    parts = rows.select("vec").mapInArrow(run, "i bigint, part array<double>")
    added = parts.groupBy("i").agg(*[F.sum(F.get("part", F.lit(k))).alias(f"c{k}") for k in range(width)])
    found = added.toPandas().sort_values("i")  # features × columns
    return found.drop(columns="i").to_numpy() if len(found) else np.zeros(block.shape)


def top_directions(rows: DataFrame, features: int, components: int, seed: int = 7) -> np.ndarray:
    """The leading eigenvectors of XᵀX, by a randomised block Krylov range finder.

    Each pass multiplies a block of a few columns by XᵀX and keeps it; the wanted directions are those of
    the space that the blocks span.  It stops when they are eigenvectors up to ``CLOSE``, or
    when the blocks span everything.  The driver holds features × (columns of all passes),
    never features × features.
    """
    columns = min(features, components + EXTRA)
    if components >= features:
        return np.eye(features)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, columns)))[0]
    basis, images = np.empty((features, 0)), np.empty((features, 0))
    while True:
        image = _gram_times(rows, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        top = turns[:, ::-1][:, :components]
        found, size = basis @ top, values[::-1][:components]
        left = np.linalg.norm(images @ top - found * size, axis=0)
        passes = basis.shape[1] // columns
        if (left <= CLOSE * max(size[0], 1e-300)).all() or passes >= PASSES:
            return np.linalg.qr(found)[0]
        rest = image
        for _ in range(2):  # twice, against rounding
            rest = rest - basis @ (basis.T @ rest)
        block, strength, _ = np.linalg.svd(rest, full_matrices=False)
        block = block[:, strength > 1e-12 * max(values[-1], 1e-300)][:, : features - basis.shape[1]]
        if not block.shape[1]:
            return np.linalg.qr(found)[0]


def mean_and_deviation(cube: DataFrame) -> tuple[list[float], list[float]]:
    """Per feature, over all points; the deviation is that of a sample."""
    stats = cube.select(array_to_vector("vec").alias("v")).agg(
        Summarizer.mean(F.col("v")).alias("mean"), Summarizer.std(F.col("v")).alias("std")
    ).first()
    return stats["mean"].toArray().tolist(), stats["std"].toArray().tolist()


def fit_reconstruction(cube: DataFrame, components: int) -> Reconstruction:
    """Principal components of standardised vectors, of any number of points and for wide vectors."""
    mean, std = mean_and_deviation(cube)
    rows = materialise(_standardised(cube, mean, std), "standardised")
    return Reconstruction(mean, std, top_directions(rows, len(mean), components))


def reconstruct(cube: DataFrame, edges: DataFrame, components: int, train: DataFrame | None = None) -> DataFrame:
    """Fit on ``train`` (default: the cube) with neighbour sums, return the loss per point."""
    whole = materialise(with_neighbours(cube, edges), "neighbours")
    learn = whole if train is None else materialise(with_neighbours(train, edges), "neighbours")
    return fit_reconstruction(learn, components).loss(whole)


# --- feedback weights ------------------------------------------------------------


def weight_candidates(length: int, decay: list[float], pre: list[float], suc: list[float]) -> list[tuple]:
    """Candidates ``(id, series weights, pre, suc)``: weights fall by ``decay`` per step back."""
    out = []
    for d in decay:
        raw = [d ** (length - 1 - i) for i in range(length)]
        weights = [x / sum(raw) for x in raw]
        out += [(weights, p, s) for p in pre for s in suc]
    return [(i, *c) for i, c in enumerate(out)]


def feedback_losses(
    loss: DataFrame,
    cases: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    candidates: list[tuple],
    window: int = 10,
    length: int | None = None,
) -> DataFrame:
    """Mean ranking loss of every candidate, all in one pass over the cases.

    A case is read once for all candidates, which are a grid the caller chose, not data.
    """
    return _candidate_losses(_feedback_cases(loss, cases, nodes, edges, window, length or window), candidates)


def _candidate_losses(rows: DataFrame, candidates: list[tuple]) -> DataFrame:
    def run(batches):
        total, count = np.zeros(len(candidates)), 0
        for case in _case_parts(batches):
            total += [case.graded(np.asarray(w, float), p, s)[0] for _, w, p, s in candidates]
            count += int(case.times.sum())
        if count:
            yield pa.RecordBatch.from_pydict(
                {"candidate": pa.array([c[0] for c in candidates], pa.int32()), "total": total, "cases": pa.array([count] * len(candidates), pa.int64())}
            )

    parts = rows.mapInArrow(run, "candidate int, total double, cases bigint")
    return parts.groupBy("candidate").agg((F.sum("total") / F.sum("cases")).alias("loss"))


def best_candidate(losses: DataFrame, candidates: list[tuple]) -> DataFrame:
    """One row: the candidate of least loss, the first of equal ones, with its two neighbour weights."""
    least = losses.agg(F.min(F.struct(F.col("loss").isNull().alias("unknown"), "loss", "candidate")).alias("best"))
    pick = lambda k: F.element_at(F.array(*[F.lit(float(c[k])) for c in candidates]), F.col("best.candidate") + 1)
    return least.where("best IS NOT NULL").select("best.candidate", pick(2).alias("pre"), pick(3).alias("suc"), "best.loss")


def _feedback_cases(loss: DataFrame, cases: DataFrame, nodes: DataFrame, edges: DataFrame, window: int, length: int) -> DataFrame:
    """One row per distinct case with ``cases``, how many it stands for, and its nodes: series, label and neighbours.

    Neighbours are ids; their series are those of the same case.
    """
    asked = distinct_cases(cases.where("case_id IS NOT NULL"), ["timestamp", "cmdb_id"])
    times = asked.groupBy("unit").agg(F.count(F.lit(1)).alias("cases"), F.first("asked").alias("asked"))
    alike = materialise(times, "alike")
    one = alike.select(F.col("unit").alias("case_id"), F.inline("asked"))
    links = edges.where("src <> dst").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).distinct()
    series = series_window(loss, one, window, length).join(nodes, "node").select("case_id", F.col("node_id").cast("bigint").alias("node_id"), "series")
    for this, other, name in (("src", "dst", "after"), ("dst", "src", "before")):
        series = series.join(links.groupBy(F.col(this).alias("node_id")).agg(F.collect_list(other).alias(name)), "node_id", "left")
    labels = case_labels(one, nodes).select("case_id", "node_id", "label")
    rows = series.join(labels, ["case_id", "node_id"])
    rows = rows.groupBy("case_id").agg(F.collect_list(F.struct("node_id", "label", "series", "after", "before")).alias("nodes"))
    return rows.join(alike.select(F.col("unit").alias("case_id"), "cases"), "case_id").select("cases", "nodes")


#: Nodes of cases that are worked on at once, unless a single case has more.
_AT_ONCE = 65_536


def _case_parts(batches):
    """``_Cases`` of a bounded number of nodes."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("nodes")).to_numpy())
        at = 0
        while at < len(ends):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")))
            yield _Cases(batch.slice(at, upto - at))
            at = upto


def _lists(lists) -> tuple[np.ndarray, pa.Array]:
    """Lengths (0 for NULL) and values of a list array."""
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), pc.list_flatten(lists)


class _Cases:
    """Whole cases as flat arrays over their nodes; ``starts`` is where each case begins."""

    def __init__(self, batch: pa.RecordBatch):
        self.times = batch.column("cases").to_numpy()
        sizes, flat = _lists(batch.column("nodes"))
        node, label, series, after, before = flat.flatten()
        self.starts = np.cumsum(sizes) - sizes
        self.case = np.repeat(np.arange(len(sizes)), sizes)
        self.node = node.to_numpy(zero_copy_only=False)
        self.true = label.fill_null(0).to_numpy(zero_copy_only=False) == 1
        values = pc.list_flatten(series)
        self.series = values.to_numpy(zero_copy_only=False).reshape(len(self.case), -1)
        self.known = values.is_valid().to_numpy(zero_copy_only=False).reshape(len(self.case), -1).all(axis=1)
        self.after, self.before = self._pairs(after), self._pairs(before)

    def _pairs(self, neighbours) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and the rows of the same case that are their neighbours."""
        counts, others = _lists(neighbours)
        row, others = np.repeat(np.arange(len(self.case)), counts), others.to_numpy(zero_copy_only=False)
        ids, own = np.unique(self.node, return_inverse=True)
        place = np.minimum(np.searchsorted(ids, others), len(ids) - 1)
        met = ids[place] == others
        row, wanted = row[met], self.case[row[met]] * len(ids) + place[met]
        key = self.case * len(ids) + own
        order = np.argsort(key, kind="stable")
        low, high = (np.searchsorted(key[order], wanted, side) for side in ("left", "right"))
        found = high - low
        within = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
        return np.repeat(row, found), order[np.repeat(low, found) + within]

    def _largest(self, score: np.ndarray, known: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
        """Per row the largest known score of its neighbours, 0 for none, and the row that has it, or -1."""
        row, other = (x[known[pairs[1]]] for x in pairs)
        best, pick = np.zeros(len(score)), np.full(len(score), -1)
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best[row[first]] = np.maximum.reduceat(score[other], first)
            hit = score[other] == best[row]
            at, i = np.unique(row[hit], return_index=True)
            pick[at] = other[hit][i]
        return best, pick

    def _first(self, hit: np.ndarray) -> np.ndarray:
        """Per case the first row that is hit, else its first row."""
        out = self.starts.copy()
        at, i = np.unique(self.case[hit], return_index=True)
        out[at] = np.flatnonzero(hit)[i]
        return out

    def graded(self, w: np.ndarray, pre: float, suc: float, slope: bool = False) -> tuple[float, np.ndarray | None]:
        """Sum of the ranking losses over all cases, and with ``slope`` its gradient by ``(*w, pre, suc)``.

        Scores go through neighbour maxima, softmax up to the factor that min-max scaling removes, and that
        scaling; a node with an unknown loss has no score and comes last.
        """
        case, starts, x = self.case, self.starts, self.series
        known = self.known & (x.shape[1] == len(w))
        score = np.zeros(len(case))
        for k in range(min(len(w), x.shape[1])):  # in order: equal series have equal sums
            score = score + x[:, k] * w[k]
        b, of_b = self._largest(score, known, self.before)
        a, of_a = self._largest(score, known, self.after)
        h = score + pre * b + suc * a
        over = lambda v, rule, none: rule.reduceat(np.where(known, v, none), starts)[case]
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            highest, lowest = over(h, np.maximum, -np.inf), over(h, np.minimum, np.inf)
            soft = np.exp(h - highest)
            low, high = over(soft, np.minimum, np.inf), over(soft, np.maximum, -np.inf)
            spread = np.where(highest == lowest, 0.0, high - low)
            scaled = known & (spread != 0)
            s = (soft - low) / spread
            rank = np.empty(len(case))
            order = np.lexsort((self.node, np.where(scaled, -s, 0.0), ~scaled, case))
            rank[order] = np.arange(len(case)) - starts[case[order]] + 1
            true = scaled & self.true
            hits = np.add.reduceat(true.astype(float), starts)[case]
            mean = np.add.reduceat(np.where(true, s, 0.0), starts)[case] / hits
            gap = np.where(scaled & (hits > 0), s - mean, 0.0)
            per_case = np.add.reduceat(np.maximum(gap, 0.0) / rank, starts)
            total = float(per_case @ self.times)
            if not slope:
                return total, None
            of = lambda pick: np.where((pick >= 0)[:, None], x[pick], 0.0)
            d = soft[:, None] * np.hstack([x + pre * of(of_b) + suc * of(of_a), b[:, None], a[:, None]])
            d_low, d_high = (d[self._first(known & (soft == edge))][case] for edge in (low, high))
            ds = ((d - d_low) * spread[:, None] - (soft - low)[:, None] * (d_high - d_low)) / spread[:, None] ** 2
            d_mean = np.add.reduceat(np.where(true[:, None], ds, 0.0), starts)[case] / hits[:, None]
            each = np.where((gap > 0)[:, None], (ds - d_mean) / rank[:, None], 0.0)
            return total, (each * self.times[case][:, None]).sum(axis=0)


def feedback_rows(
    loss: DataFrame, cases: DataFrame, nodes: DataFrame, edges: DataFrame, window: int = 10, length: int | None = None
) -> DataFrame:
    """Stored: one row per distinct case with the series, labels and neighbours of its nodes."""
    return materialise(_feedback_cases(loss, cases, nodes, edges, window, length or window), "feedback")


def feedback_gradient(rows: DataFrame, weights: list[float], pre: float, suc: float) -> tuple[float | None, np.ndarray]:
    """Mean ranking loss and its gradient by ``(*weights, pre, suc)``, in one pass without a shuffle.

    ``rows`` are ``feedback_rows``.  Ranks are taken as they are.  Many cases are worked on at once.
    """
    w = np.asarray(weights, float)
    names = [f"g{k}" for k in range(len(w) + 2)]

    def run(batches):
        total, slope, count = 0.0, np.zeros(len(names)), 0
        for case in _case_parts(batches):
            here, by = case.graded(w, pre, suc, slope=True)
            total, slope, count = total + here, slope + by, count + int(case.times.sum())
        if count:
            yield pa.RecordBatch.from_pydict({"cases": pa.array([count], pa.int64()), "loss": [total], **{c: [g] for c, g in zip(names, slope)}})

    graded = rows.mapInArrow(run, ", ".join(["cases bigint", *(f"{c} double" for c in ["loss", *names])]))
    mean = graded.agg(*[F.sum(c) / F.sum("cases") for c in ["loss", *names]]).first()
    if mean[0] is None:
        return None, np.zeros(len(names))
    return mean[0], np.array(mean[:][1:])


def fit_feedback_weights(
    loss: DataFrame,
    cases: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    window: int = 10,
    length: int | None = None,
    steps: int = 20,
    grid: list[tuple] | None = None,
) -> tuple[list[float], float, float, float | None]:
    """Gradient descent from the best candidate of a grid: ``(weights, pre, suc, loss)``.

    A step goes down the gradient of the ranking loss; one that makes the loss larger is taken back and
    halved.  Each step is one Spark aggregate over stored rows, and the loss never gets worse than
    that of the grid.
    """
    length = length or window
    grid = grid or weight_candidates(length, [1.0, 0.8, 0.5], [0.0, 0.5], [0.0, 0.5])
    rows = feedback_rows(loss, cases, nodes, edges, window, length)
    best = best_candidate(_candidate_losses(rows, grid), grid).first()
    _, weights, pre, suc = grid[best["candidate"] if best else 0]
    point = np.array([*weights, pre, suc], float)
    least, slope = feedback_gradient(rows, point[:length].tolist(), *point[length:])
    rate = 0.1
    for _ in range(steps if least is not None else 0):
        size = np.linalg.norm(slope)
        if size == 0 or rate < 1e-4:
            break
        there = point - rate * np.linalg.norm(point) * slope / size
        now, new_slope = feedback_gradient(rows, there[:length].tolist(), *there[length:])
        if now is not None and now < least:
            point, least, slope, rate = there, now, new_slope, rate * 1.5
        else:
            rate /= 2
    return point[:length].tolist(), float(point[length]), float(point[length + 1]), least
