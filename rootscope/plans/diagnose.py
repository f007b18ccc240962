"""From aligned features of three modalities to ranked root causes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.functions.scalars import epoch_seconds
from rootscope.functions.vectors import zeros
from rootscope.operators import cube as C
from rootscope.operators import evaluate as E
from rootscope.operators import model as M
from rootscope.operators import scoring as Q
from rootscope.operators.spread import numbered
from rootscope.session import materialise

def feature_layout(features: DataFrame) -> DataFrame:
    """``(feature, i)``: where each feature stands in a vector, by name."""
    return numbered(features.select("feature").where(F.col("feature").isNotNull()).distinct(), ["feature"], "i")


def vectorise(features: DataFrame, nodes: DataFrame, layout: DataFrame, width: int) -> DataFrame:
    """Long features to ``(ts, node_id, vec)``; absent and NULL features are 0.

    Features meet their place in a join, so names stay in Spark; the zeros between the
    places that a row has are put in by runs.
    """
    cells = features.select("instance_id", "timestamp", "feature", F.col("value").cast("double").alias("value"))
    placed = cells.join(layout, "feature").withColumn("value", F.coalesce("value", F.lit(0.0)))
    entries = F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), "value")))
    rows = placed.groupBy("instance_id", "timestamp").agg(entries.alias("_cells"))

    def before(k: Column) -> Column:
        return F.when(k == 0, F.lit(-1)).otherwise(F.get("_cells", k - 1).getField("i"))

    def run(cell: Column, k: Column) -> Column:
        gap = cell.getField("i") - before(k) - 1
        repeated = F.raise_error(F.concat(F.lit("feature twice in one window: place "), cell.getField("i").cast("string"))).cast("array<double>")
        return F.when(gap < 0, repeated).otherwise(F.concat(zeros(gap), F.array(cell.getField("value"))))

    tail = F.array(zeros(F.lit(width - 1) - F.element_at("_cells", -1).getField("i")))
    vec = F.flatten(F.concat(F.transform("_cells", run), tail))
    ids = nodes.select(F.col("node").alias("instance_id"), "node_id")
    return rows.join(ids, "instance_id").select(epoch_seconds("timestamp").alias("ts"), "node_id", vec.alias("vec"))


@dataclass
class Cube:
    """``layout`` is ``(feature, i)`` with ``modality`` 0, 1, 2 for metric, log, trace; ``i`` counts through all three."""

    points: DataFrame
    spans: list[tuple[int, int]]
    layout: DataFrame


def build_cube(metric: DataFrame, log: DataFrame, trace: DataFrame, nodes: DataFrame) -> Cube:
    """Metric times carry the cube; logs and traces are zero where they are silent.

    Feature spans come from the cube itself, in the order metric, log, trace.
    """
    layouts = [feature_layout(f) for f in (metric, log, trace)]
    widths = [layout.count() for layout in layouts]
    parts = [vectorise(f, nodes, layout, w) for f, layout, w in zip((metric, log, trace), layouts, widths)]
    points = parts[0].withColumnRenamed("vec", "_metric")
    for part, width, label in ((parts[1], widths[1], "_log"), (parts[2], widths[2], "_trace")):
        points = points.join(part.withColumnRenamed("vec", label), ["ts", "node_id"], "left").withColumn(
            label, F.coalesce(label, zeros(width))
        )
    points = points.select("ts", "node_id", F.concat("_metric", "_log", "_trace").alias("vec"))
    spans = C.modal_spans(widths)
    shifted = [x.select(F.lit(k).alias("modality"), "feature", F.col("i") + spans[k][0]) for k, x in enumerate(layouts)]
    layout = shifted[0].unionAll(shifted[1]).unionAll(shifted[2]).toDF("modality", "feature", "i")
    return Cube(materialise(points, "cube"), spans, layout)


def node_losses(cube: Cube, edges: DataFrame, nodes: DataFrame, components: int) -> DataFrame:
    """``(ts, node, loss)`` of the reconstruction model."""
    losses = M.reconstruct(cube.points, edges, components)
    return losses.join(nodes, "node_id").select("ts", "node", "loss")


def diagnose(
    cube: Cube,
    cases: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    components: int = 8,
    window: int = 10,
    pre: float = 0.0,
    suc: float = 0.0,
) -> DataFrame:
    """Ranked nodes of every case."""
    loss = materialise(node_losses(cube, edges, nodes, components), "loss")
    return materialise(Q.score_cases(loss, cases, nodes, edges, window, pre, suc), "ranked")


def judge(ranked: DataFrame, cases: DataFrame, match: str = "prefix") -> DataFrame:
    """``(metric, value)``: Top-1 … Top-5 accuracy and the mean reciprocal rank."""
    top = E.topk_accuracy(ranked, cases, 5, match).select(
        F.concat(F.lit("top"), F.col("k").cast("string")).alias("metric"), F.col("accuracy").alias("value")
    )
    return top.unionByName(E.mrr(ranked, cases, 10, match).select(F.lit("mrr").alias("metric"), F.col("mrr").alias("value")))
