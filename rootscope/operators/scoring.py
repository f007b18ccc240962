"""Fault cases against reconstruction losses: windows, scores, ranks.

``cases``: ``(case_id, timestamp, cmdb_id)``; ``loss``: ``(ts, node, loss)``; times are
epoch seconds; ``window`` counts minutes and is centred on the case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootscope.functions.vectors import weighted_sum
from rootscope.operators.graph import neighbour_max
from rootscope.operators.spread import DAY, last_before
from rootscope.session import materialise


def case_windows(cases: DataFrame, window: int) -> DataFrame:
    """One row per distinct case time and time bucket its window touches (two at most).

    Buckets are as wide as the window, so the band join becomes an equi-join.
    """
    width, half = window * 60, window * 30
    start, end = F.col("timestamp") - half, F.col("timestamp") + half
    return (
        cases.select("timestamp")
        .distinct()
        .select(
            "timestamp",
            start.alias("_start"),
            end.alias("_end"),
            F.explode(
                F.sequence(F.floor(start / F.lit(width)), F.floor((end - 1) / F.lit(width)))
            ).alias("_bucket"),
        )
    )


def asked_windows(loss: DataFrame, cases: DataFrame, window: int) -> DataFrame:
    """Case times and buckets, with every node that has a loss in the bucket."""
    here = loss.select("node", F.floor(F.col("ts") / F.lit(window * 60)).alias("_bucket")).distinct()
    return case_windows(cases, window).join(here, "_bucket")


def case_window_mean(loss: DataFrame, cases: DataFrame, window: int = 10) -> DataFrame:
    """Mean loss per case and node over ``[case - w*30s, case + w*30s)``.

    A window is the end of one bucket and the start of the next.  Losses are summed per (node, second), then
    running from both ends of every (node, bucket), with the case times sorted among them: a
    case time meets two sums per node, and no sum is longer than a bucket.
    """
    width = window * 60
    per_ts = loss.groupBy("node", "ts").agg(F.sum("loss").alias("_sum"), F.count("loss").alias("_n"))
    placed = per_ts.withColumn("_bucket", F.floor(F.col("ts") / F.lit(width))).withColumn("_row", F.lit(1))
    is_end = F.col("_bucket") == F.floor(F.col("_start") / F.lit(width))
    asked = asked_windows(loss, cases, window).select(
        "node", "_bucket", "timestamp", F.when(is_end, F.col("_start")).otherwise(F.col("_end")).alias("ts"), is_end.alias("_is_end"), F.lit(0).alias("_row")
    )
    bucket = Window.partitionBy("node", "_bucket")
    # a time itself belongs to the window that starts there, not to the one that ends
    until = bucket.orderBy("ts", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = bucket.orderBy(F.desc("ts"), F.desc("_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ["_sum", "_n", "_row"]
    found = placed.unionByName(asked, allowMissingColumns=True).select(
        "timestamp", "node", "_is_end", "_row", *[F.sum(c).over(w).alias(f"{c}{k}") for k, w in enumerate((until, since)) for c in parts]
    )
    met = found.where("_row = 0").select(
        "timestamp", "node", *[F.when(F.col("_is_end"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")).alias(f"{c}s") for c in parts]
    )
    means = (
        met.groupBy("timestamp", "node")
        .agg(F.try_divide(F.sum("_sums"), F.sum("_ns")).alias("score"), F.sum("_rows").alias("_rows"))
        .where("_rows > 0")
    )
    return cases.join(means, "timestamp").select("case_id", "node", "score")


def _last_samples(rows: DataFrame, cases: DataFrame, value: str, window: int) -> DataFrame:
    """``(timestamp, last)``: the last of ``value`` in the window of each case time, a struct with ``ts``."""
    half = window * 30
    asked = cases.select("timestamp", (F.col("timestamp") + half).alias("ts")).distinct()
    found = last_before(rows, asked, [], "ts", value, F.floor(F.col("ts") / F.lit(DAY)), 1, "_found")
    last = F.get("_found", F.lit(0))
    return found.where(last.getField("ts") >= F.col("timestamp") - half).select("timestamp", last.alias("last"))


def distinct_cases(cases: DataFrame, of: list[str]) -> DataFrame:
    """``(case_id, unit, asked)`` over stored tables, one row per case id; ids that ask the same share a ``unit``.

    ``asked`` holds the ``of`` of all rows of an id.  Rows without an id have no unit.
    """
    each = cases.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(*of))).alias("asked"))
    each = materialise(each, "asked")
    units = each.where("case_id IS NOT NULL").select("asked").distinct()
    units = materialise(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    named = each.where("case_id IS NOT NULL").join(units, "asked").select("case_id", "unit", "asked")
    nameless = each.where("case_id IS NULL").select("case_id", F.lit(None).cast("bigint").alias("unit"), "asked")
    return named.unionByName(nameless)


def graph_for_case(samples: DataFrame, cases: DataFrame, window: int = 10) -> DataFrame:
    """Graph of the last sample in a case's window, else of the first sample of all."""
    per_ts = samples.groupBy("ts").agg(F.max("graph_id").alias("graph_id"))
    first = samples.agg(F.min_by("graph_id", "ts")).scalar()
    last = _last_samples(per_ts.withColumn("_at", F.struct("ts", "graph_id")), cases, "_at", window)
    return cases.join(last, "timestamp", "left").select(
        "case_id", F.coalesce("last.graph_id", first).alias("graph_id")
    )


def with_nodes(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every case with every node of the dictionary."""
    listed = nodes.agg(F.array_sort(F.collect_list(F.struct("node_id", "node")))).scalar()
    return cases.withColumn("_node", F.explode(listed)).select(*cases.columns, "_node.node", "_node.node_id")


def case_labels(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Label 1 for nodes whose name starts with the case's ``cmdb_id``."""
    return with_nodes(cases, nodes).select(
        "case_id", "node", "node_id", F.col("node").startswith(F.col("cmdb_id")).cast("int").alias("label")
    )


def rank_nodes(scores: DataFrame) -> DataFrame:
    """Adds ``rank`` within a case: highest score first, unknown scores last.

    A case has as many rows as there are nodes.
    """
    order = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("score"), "node_id")
    return scores.withColumn("rank", F.row_number().over(order))


def rankings_wide(ranked: DataFrame, top: int) -> DataFrame:
    """``Top1 … TopN`` as ``node:score`` text, one row per case."""
    text = F.concat("node", F.lit(":"), F.coalesce(F.col("score").cast("string"), F.lit("nan")))
    picks = [F.max(F.when(F.col("rank") == i, text)).alias(f"Top{i}") for i in range(1, top + 1)]
    return ranked.where(F.col("rank") <= top).groupBy("case_id").agg(*picks)


def score_cases(
    loss: DataFrame,
    cases: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    window: int = 10,
    pre: float = 0.0,
    suc: float = 0.0,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Ranked nodes per case: window mean plus weighted neighbour maxima.

    ``pre`` weighs the largest successor, ``suc`` the largest predecessor, as the
    published rule does.  With ``samples`` the graph of each case is looked up by time and
    ``edges`` needs a ``graph_id``.
    """
    means = case_window_mean(loss, cases, window)
    known = loss.select("node").distinct()
    ids = nodes.join(known, "node", "left_semi")
    scores = with_nodes(cases.select("case_id"), ids).join(means, ["case_id", "node"], "left")
    graph = []
    if samples is not None:
        scores = scores.join(graph_for_case(samples, cases, window), "case_id")
        graph = ["graph_id"]
    near = neighbour_max(scores, edges, ["case_id"], graph)
    total = F.col("score") + pre * F.col("successor_max") + suc * F.col("predecessor_max")
    return rank_nodes(near.select("case_id", "node", "node_id", total.alias("score")))


# --- scoring with feedback -------------------------------------------------------


def series_window(loss: DataFrame, cases: DataFrame, window: int = 10, length: int | None = None) -> DataFrame:
    """The last ``length`` losses of every case and node, oldest first.

    A shorter series repeats its first value at the front.  Cases without any sample
    are absent; ``cases_without_samples`` reports them.  Every case time takes the last losses
    before the end of its window and leaves out what lies before its start.
    """
    length = length or window
    per_ts = loss.groupBy("node", "ts").agg(F.avg("loss").alias("loss")).withColumn("_at", F.struct("ts", "loss"))
    asked = asked_windows(loss, cases, window).select("node", "timestamp", "_start", F.col("_end").alias("ts")).distinct()
    recent = last_before(per_ts, asked, ["node"], "ts", "_at", F.floor(F.col("ts") / F.lit(DAY)), length, "_recent")
    inside = F.filter("_recent", lambda r: r.getField("ts") >= F.col("_start"))
    kept = recent.select("timestamp", "node", F.transform(inside, lambda r: r.getField("loss")).alias("_values"))
    padded = F.concat(F.array_repeat(F.col("_values")[0], F.lit(length) - F.size("_values")), "_values")
    kept = kept.where(F.size("_values") > 0).select("timestamp", "node", padded.alias("series"))
    return cases.join(kept, "timestamp").select("case_id", "node", "series")


def cases_without_samples(loss: DataFrame, cases: DataFrame, window: int = 10) -> DataFrame:
    times = loss.select("ts").distinct().withColumn("_at", F.struct("ts"))
    return cases.join(_last_samples(times, cases, "_at", window), "timestamp", "left_anti")


def series_weighted(series: DataFrame, weights: list[float] | None = None, length: int = 10) -> DataFrame:
    """Weighted sum of every series; weights default to ``1/length``."""
    weights = weights or [1.0 / length] * length
    return series.select("case_id", "node", weighted_sum("series", weights).alias("score"))


def softmax(scores: DataFrame, value: str = "score") -> DataFrame:
    """Softmax over the nodes of a case."""
    case = Window.partitionBy("case_id")
    shifted = F.exp(F.col(value) - F.max(value).over(case))
    return scores.withColumn("_e", shifted).withColumn(value, F.col("_e") / F.sum("_e").over(case)).drop("_e")


def feedback_score(
    loss: DataFrame,
    cases: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    window: int = 10,
    weights: list[float] | None = None,
    pre: float = 0.0,
    suc: float = 0.0,
    length: int | None = None,
) -> DataFrame:
    """Ranked softmax scores with given series and graph weights.

    Here ``pre`` weighs predecessors and ``suc`` successors.  Cases of one time have one ranking, which is
    made once.
    """
    length = length or window
    asked = distinct_cases(cases, ["timestamp"])
    one = asked.select("unit", "asked").distinct().select(F.col("unit").alias("case_id"), F.inline("asked"))
    series = series_weighted(series_window(loss, one, window, length), weights, length)
    scores = series.join(nodes, "node")
    near = neighbour_max(scores, edges, ["case_id"])
    total = F.col("score") + pre * F.col("predecessor_max") + suc * F.col("successor_max")
    ranked = rank_nodes(softmax(near.select("case_id", "node", "node_id", total.alias("score"))))
    ranked = materialise(ranked.withColumnRenamed("case_id", "_unit"), "ranked")
    return asked.join(ranked, F.col("unit").eqNullSafe(F.col("_unit"))).select("case_id", "node", "node_id", "score", "rank")


def ranking_terms(labelled: DataFrame, by: list[str], score: str | Column = "score") -> DataFrame:
    """Ranking loss of every group of ``by``; groups are single cases."""
    case = Window.partitionBy(*by)
    s = F.col(score) if isinstance(score, str) else score
    scaled = labelled.withColumn("_s", s).withColumn(
        "_s",
        F.try_divide(F.col("_s") - F.min("_s").over(case), F.max("_s").over(case) - F.min("_s").over(case)),
    )
    rank = F.row_number().over(case.orderBy(F.desc("_s"), "node_id"))
    true_mean = F.avg(F.when(F.col("label") == 1, F.col("_s"))).over(case)
    gap = scaled.withColumn("_gap", (F.col("_s") - true_mean) / rank)
    return gap.groupBy(*by).agg(F.sum(F.greatest("_gap", F.lit(0.0))).alias("loss"))


def ranking_loss(labelled: DataFrame) -> DataFrame:
    """Mean over cases of the weighted lead that wrong nodes have over the labelled ones."""
    return ranking_terms(labelled, ["case_id"]).agg(F.avg("loss").alias("loss"))
