"""Plans and skew: what has to hold on a large cluster."""

import pytest
from pyspark.sql import functions as F

from rootscope.operators import graph, metrics, scoring, templates, traces
from rootscope.queries import adapters as A
from rootscope.queries.registry import all_queries

SF = "/root/testdata/sf0.001"
# these store tables while they are built, which other tests cover
EAGER = {"diagnose", "judge", "reconstruct", "mine_templates_documents"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(all_queries()) - EAGER))
def test_no_pairwise_joins(spark, key):
    text = plan(all_queries()[key](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(all_queries()["case_window_join"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)" in text
    assert "props" not in text


def test_first_messages_are_found_without_sorting_a_length(spark):
    rows = templates.distinct_messages(templates.with_text(A.logs_long(spark, SF))).where("n > 0")
    start = rows.groupBy("scope", "n").agg((F.min("pos") - 1).alias("start"))
    cuts = templates.first_undecided(rows, start, 100)
    held = rows.join(cuts, ["scope", "n"]).where("pos <= cut").groupBy("scope", "n").count()
    assert held.count() == cuts.count() and held.agg(F.max("count")).first()[0] <= 100
    assert held.agg(F.min("count")).first()[0] >= 1
    # a window sees counts per step, not messages
    assert "Window" in plan(cuts) and "pos#" not in next(x for x in plan(cuts).splitlines() if "Window [" in x)


def test_fill_reads_its_input_once(spark):
    stored = metrics.dense_cells(A.metrics_binned(spark, SF))
    filled = metrics.fill_missing(stored)
    filled.collect()
    assert "ReusedExchange" in plan(filled)


def skewed_spans(spark, n=30_000):
    """A third of all spans in one trace, under one parent and in one window."""
    hot = F.col("id") % 3 == 0
    ids = spark.range(0, n)
    return ids.select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 997).cast("string"))).alias("trace_id"),
        F.col("id").cast("string").alias("span_id"),
        F.when(hot & (F.col("id") > 0), F.lit("0")).alias("parent_span_id"),
        F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("service_name"),
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("i"), (F.col("id") % 11).cast("string"))).alias("instance_id"),
        F.when(hot, F.lit(60)).otherwise(F.col("id") % 3600).cast("bigint").alias("second"),
        (F.col("id") % 1000).cast("double").alias("duration"),
        F.lit("200").alias("status_code"),
        F.lit(False).alias("is_error"),
        F.lit("http").alias("request_type"),
    ).withColumn("timestamp", F.timestamp_seconds("second").cast("timestamp_ntz"))


def test_hot_parent(spark):
    got = sorted((r.caller, r.callee) for r in graph.call_pairs(skewed_spans(spark)).collect())
    assert got == [("s0", f"s{i}") for i in range(5)]


def test_hot_window_percentiles(spark):
    got = traces.trace_features(skewed_spans(spark)).where("instance_id = 'hot'").first()
    assert (got.request_count, got.unique_trace_count, got.unique_service_count) == (10_000, 1, 5)
    assert got.p50_latency == pytest.approx(499.5)
    assert got.p99_latency == pytest.approx(989.01)


def test_hot_series_is_filled_in_chunks(spark):
    n = 50_000
    rows = spark.range(0, n).select(
        F.lit("hot").alias("instance_id"),
        F.lit("f").alias("feature"),
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("value"),
    )
    filled = metrics.fill_missing(rows, "interpolate")
    off = filled.withColumn("want", F.least(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 60, F.lit(49_000.0)))
    assert off.where(F.abs(F.col("value") - F.col("want")) > 1e-6).count() == 0


def test_hot_second_of_losses(spark):
    n = 30_000
    loss = spark.range(0, n).select(F.lit(1000).cast("bigint").alias("ts"), F.lit("a").alias("node"), F.col("id").cast("double").alias("loss"))
    cases = spark.range(0, 200).select(F.col("id").alias("case_id"), F.lit(1000).cast("bigint").alias("timestamp"), F.lit("a").alias("cmdb_id"))
    got = scoring.case_window_mean(loss, cases)
    assert got.count() == 200
    assert got.select("score").distinct().first().score == pytest.approx((n - 1) / 2)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_results_do_not_depend_on_partitions(spark, parts):
    rows = A.spans_flat(spark, SF).repartition(parts)
    got = traces.trace_features(rows, 86_400).select("instance_id", "timestamp", "p90_latency", "unique_trace_count")
    want = traces.trace_features(A.spans_flat(spark, SF), 86_400).select(*got.columns)
    assert got.exceptAll(want).count() == 0
