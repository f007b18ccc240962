"""The time × node × feature cube: rows ``(ts, node_id, vec)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootscope.functions.vectors import fit_vector, mse, span_mse, zeros
from rootscope.operators.spread import DAY, block_chunk, with_ordinal

# First time and step of the axis used when no metric axis exists.
AXIS_START = 1_651_334_400
AXIS_STEP = 300

POINT = ["ts", "node_id"]


def timestamp_axis(cube: DataFrame) -> DataFrame:
    """``(t_idx, ts)``: distinct times numbered from 0."""
    times = cube.select("ts").distinct()
    return with_ordinal(times, [], ["ts"], block_chunk("ts", 30 * DAY), "t_idx", start=0).select("t_idx", "ts")


def default_axis(vectors: DataFrame, metric_axis: DataFrame | None = None) -> DataFrame:
    """Axis for window vectors: the metric axis cut to the windows there are, or made up.

    ``vectors`` decides how many windows there are; pass the log vectors alone to count
    windows of logs only.
    """
    last = vectors.agg(F.max("t_idx").alias("_last"))
    if metric_axis is not None:
        return metric_axis.where(F.col("t_idx") <= last.scalar()).select("t_idx", "ts")
    (end,) = last.first()
    steps = vectors.sparkSession.range(0 if end is None else end + 1).select(F.col("id").alias("t_idx"))
    return steps.withColumn("ts", F.lit(AXIS_START) + F.col("t_idx") * AXIS_STEP)


def attach_timestamps(vectors: DataFrame, truth: DataFrame, order: list[str], block: int = 65_536, dedupe: str | None = None) -> DataFrame:
    """The i-th vector gets the i-th ground-truth time; missing times are 0.

    ``order[0]`` is a whole number that orders ``truth``.  ``dedupe='last'`` keeps the
    last vector of equal times.
    """
    times = with_ordinal(truth.select("timestamp", *order), [], order, block_chunk(order[0], block), "t_idx", start=0)
    dated = vectors.select("t_idx", "node_id", "vec").join(times.select("t_idx", F.col("timestamp").alias("ts")), "t_idx", "left").withColumn(
        "ts", F.coalesce("ts", F.lit(0).cast("bigint"))
    )
    if dedupe == "last":
        last = F.max_by(F.struct("t_idx", "vec"), "t_idx").alias("_last")
        return dated.groupBy("ts", "node_id").agg(last).select("ts", "node_id", "_last.t_idx", "_last.vec")
    return dated.select("t_idx", "ts", "node_id", "vec")


def dense_cube(vectors: DataFrame, axis: DataFrame, nodes: DataFrame, vec: str = "vec") -> DataFrame:
    """All (time, node) points; absent or empty vectors become zeros.

    Zeros are as long as the first non-empty vector.  Only absent points are made
    anew: the vectors themselves are not moved.
    """
    full = vectors.where(F.size(vec) > 0).select("t_idx", "node_id", F.col(vec).alias("vec"))
    width = full.agg(F.min_by(F.size("vec"), F.struct("node_id", "t_idx"))).scalar()
    everyone = nodes.agg(F.collect_set("node_id")).scalar()
    have = full.groupBy("t_idx").agg(F.collect_set("node_id").alias("_have"))
    none = F.array().cast("array<int>")
    absent = (
        axis.join(have, "t_idx", "left")
        .withColumn("node_id", F.explode(F.array_except(everyone, F.coalesce("_have", none))))
        .select("ts", "node_id", zeros(F.coalesce(width, F.lit(0))).alias("vec"))
    )
    return full.join(axis, "t_idx").select("ts", "node_id", "vec").unionByName(absent)


def fit_cube(cube: DataFrame, width: int | None = None) -> DataFrame:
    """Vectors of one width: given, or that of the first vector."""
    n = F.lit(width) if width else cube.agg(F.min_by(F.size("vec"), F.struct(*POINT))).scalar()
    return cube.withColumn("vec", fit_vector("vec", n))


def modal_join(metric: DataFrame, log: DataFrame, trace: DataFrame) -> DataFrame:
    """``[metric, log, trace]`` concatenated per point; points of all three only."""
    m, lg, t = (df.select(*POINT, F.col("vec").alias(n)) for df, n in ((metric, "_m"), (log, "_l"), (trace, "_t")))
    return m.join(lg, POINT).join(t, POINT).select(*POINT, F.concat("_m", "_l", "_t").alias("vec"))


def modal_gaps(metric: DataFrame, log: DataFrame, trace: DataFrame) -> DataFrame:
    """Metric points that another modality lacks: must be empty for a strict join."""
    parts = [
        metric.join(other.select(*POINT), POINT, "left_anti").select(*POINT, F.lit(name).alias("missing"))
        for other, name in ((log, "log"), (trace, "trace"))
    ]
    return parts[0].unionByName(parts[1])


def stack_instances(vectors: DataFrame) -> DataFrame:
    """``(t_idx, nodes)``: per window the node vectors in order of node id."""
    rows = F.array_sort(F.collect_list(F.struct("node_id", "vec")))
    return vectors.groupBy("t_idx").agg(rows.alias("nodes"))


def uneven_instances(vectors: DataFrame) -> DataFrame:
    """Nodes whose number of windows differs from the longest: empty if they stack."""
    lengths = vectors.groupBy("node_id").agg(F.count(F.lit(1)).alias("windows"))
    return lengths.where(F.col("windows") < lengths.agg(F.max("windows")).scalar())


def oversample(cube: DataFrame, copies: int = 5) -> DataFrame:
    """Adds ``copy_id``: every row ``copies`` times."""
    return cube.withColumn("copy_id", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def cube_profile(cube: DataFrame) -> DataFrame:
    """Shape of a cube in one row."""
    return cube.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_distinct("ts").alias("times"),
        F.count_distinct("node_id").alias("nodes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min(F.size("vec")).alias("min_dim"),
        F.max(F.size("vec")).alias("max_dim"),
    )


def cube_metadata(cube: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
    """One row: node order, number of times, first and last, where the axis is from."""
    listed = F.array_sort(F.collect_list(F.struct("node_id", "node")))
    order = nodes.agg(F.array_join(F.transform(listed, lambda n: n.getField("node")), ",")).scalar()
    return cube.agg(
        F.count_distinct("ts").alias("total_timestamps"),
        F.min("ts").alias("first_timestamp"),
        F.max("ts").alias("last_timestamp"),
    ).select(
        order.alias("service_order"),
        "*",
        F.lit(source).alias("source"),
    )


def modal_spans(widths: list[int]) -> list[tuple[int, int]]:
    """Inclusive feature spans of modalities laid out one after another."""
    spans, at = [], 0
    for w in widths:
        spans.append((at, at + w - 1))
        at += w
    return spans


def node_mse(pairs: DataFrame, a: str = "vec", b: str = "rebuilt") -> DataFrame:
    """Mean squared error per point."""
    return pairs.select(*POINT, mse(a, b).alias("loss"))


def modal_loss(pairs: DataFrame, spans: list[tuple[int, int]], a: str = "vec", b: str = "rebuilt") -> DataFrame:
    """Sum over modalities of the mean squared error, over all points."""
    return pairs.agg(F.avg(span_mse(a, b, spans)).alias("loss"))


def loss_pivot(loss: DataFrame, nodes: list[str]) -> DataFrame:
    """One column per named node, for sinks."""
    picks = [F.avg(F.when(F.col("node") == n, F.col("loss"))).alias(n) for n in nodes]
    return loss.groupBy("ts").agg(*picks)


def augment(cube: DataFrame, rate: float, times: int, seed: int = 0, batch: int = 64) -> DataFrame:
    """Masked copies: random nodes and random feature columns set to zero.

    Node draws depend on (copy, time, node), feature draws on (copy, batch, feature), by
    integer arithmetic: the result does not depend on partitions or retries.
    """
    limit = int(rate * 10_007)

    def draw(*parts):
        mixed = F.lit(seed * 31 + 17).cast("bigint")
        for p in parts:
            mixed = (mixed * 7_919 + p.cast("bigint") * 104_729 + 1_299_709) % 15_485_863
        return (mixed * 48_271 % 10_007) < limit

    copies = cube.withColumn("copy_id", F.explode(F.sequence(F.lit(1), F.lit(times))))
    node_off = draw(F.col("copy_id"), F.col("t_idx"), F.col("node_id"))
    batch_id = F.floor(F.col("t_idx") / F.lit(batch))
    masked = F.transform(
        "vec",
        lambda x, i: F.when(node_off | draw(F.col("copy_id"), batch_id, i), F.lit(0.0)).otherwise(x),
    )
    return copies.withColumn("vec", masked)
