"""Streams give what the batch operators give, once their windows are closed."""

import pytest
from pyspark.sql import functions as F

from rootscope.operators import graph, templates, traces
from rootscope.queries import adapters as A
from rootscope.streaming import features as S

SF = "/root/testdata/sf0.001"


def run(spark, build, batch, tmp_path, name, order="timestamp"):
    """Feed ``batch`` file by file in time order and return the emitted rows."""
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    low, high = batch.agg(F.min(order), F.max(order)).first()
    for i in range(4):
        # one write after another, so that the files are taken in time order
        first, last = low + (high - low) * i / 4, low + (high - low) * (i + 1) / 4
        mine = (F.col(order) >= F.lit(first)) & ((F.col(order) < F.lit(last)) | F.lit(i == 3))
        batch.where(mine).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        build(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{tmp_path}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(240)
    return spark.read.parquet(out)


@pytest.fixture
def day():
    return 86_400


def test_metric_means(spark, tmp_path, day):
    rows = A.metrics_long(spark, SF)
    got = run(spark, lambda s: S.metric_means(s, day, "40 days"), rows, tmp_path, "m")
    assert got.count() == 0  # nothing is closed yet
    got = run(spark, lambda s: S.metric_means(s, day, "1 day"), rows, tmp_path / "b", "m")
    want = rows.groupBy(
        "instance_id", F.window("timestamp", "1 day").start.alias("timestamp"), F.col("metric_name").alias("feature")
    ).agg(F.avg("value").alias("value"))
    key = ["instance_id", "timestamp", "feature"]
    both = got.join(want.withColumnRenamed("value", "want"), key)
    assert 0 < got.count() == both.count() < want.count()
    assert both.where(F.abs(F.col("value") - F.col("want")) > 1e-9).count() == 0


def test_trace_features(spark, tmp_path, day):
    rows = A.spans_flat(spark, SF)
    got = run(spark, lambda s: S.trace_features(s, day, "1 day"), rows, tmp_path, "t")
    assert got.columns == ["instance_id", "timestamp", *traces.FEATURES]
    want = traces.trace_features(rows, day).select("instance_id", "timestamp", F.col("request_count").alias("want"))
    both = got.join(want, ["instance_id", "timestamp"])
    assert 0 < got.count() == both.count()
    assert both.where("request_count <> want").count() == 0


def test_template_counts(spark, tmp_path):
    rows = A.logs_short(spark, SF).withColumnRenamed("service", "instance_id")
    known = templates.mine_templates(templates.with_text(rows))
    plain = rows.select("instance_id", "timestamp", "message")
    got = run(spark, lambda s: S.template_counts(s, known, A.MONTH, "30 days"), plain, tmp_path, "l")
    total = got.agg(F.sum("value")).first()[0]
    assert 0 < total < rows.count()
    assert {r.feature for r in got.select("feature").distinct().collect()} == {"template_0", "template_1"}


def test_template_counts_with_a_dictionary_too_large_to_send(spark, tmp_path):
    ids = spark.range(0, 20_000)
    word = lambda k: F.concat(F.lit(k), F.col("id").cast("string"))
    # letters, as numbers are masked
    text = F.translate(F.concat_ws(" ", word("a"), word("b"), F.lit("same"), word("c")), "0123456789", "ghijklmnop")
    known = ids.select(F.col("id").alias("template_id"), F.lit("").alias("scope"), text.alias("text"), F.lit(4).alias("n"), F.col("id").alias("pos"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = ids.where("id % 10 = 0 OR id < 50").select(
        F.concat(F.lit("i"), (F.col("id") % 3).cast("string")).alias("instance_id"),
        (start + F.expr("make_dt_interval(0, 0, 0, id)")).alias("timestamp"),
        # the first two tokens of one template, the last of another: half and more of the first
        F.when(F.col("id") < 50, F.lit("no such line")).otherwise(text).alias("message"),
    )
    rows = rows.unionAll(rows.where("message LIKE 'a% same %'").limit(500))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = run(spark, lambda s: S.template_counts(s, known, 60, "1 minute"), rows, tmp_path, "d")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts = templates.with_text(rows).withColumn("pos", F.monotonically_increasing_id())
    assigned = templates.assign_templates(texts, known, assign="final")
    name = F.concat(F.lit("template_"), F.coalesce(F.col("template_id").cast("string"), F.lit("unknown")))
    want = assigned.groupBy("instance_id", F.window("timestamp", "60 seconds").start.alias("timestamp"), name.alias("feature")).agg(F.count("*").alias("want"))
    both = got.join(want, ["instance_id", "timestamp", "feature"])
    assert both.count() == got.count() > 1500 and both.where("value <> want").count() == 0
    assert got.where("feature = 'template_unknown'").count() > 0


def test_call_pairs_of_shuffled_arrivals(spark, tmp_path):
    n = 4_000
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    spans = spark.range(0, n).select(
        (at + F.expr("make_dt_interval(0, 0, 0, id)")).alias("timestamp"),
        (F.col("id") / 40).cast("int").cast("string").alias("trace_id"),
        F.col("id").cast("string").alias("span_id"),
        F.when(F.col("id") % 40 > 0, (F.col("id") - 1).cast("string")).alias("parent_span_id"),
        F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(60)).cast("string")).alias("service_name"),
        # children come up to four minutes before their parents, or after them
        (F.col("id") + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(240))).alias("arrival"),
    )
    got = run(spark, lambda s: S.call_pairs(s, "10 minutes", "5 minutes"), spans, tmp_path, "c", order="arrival")
    want = {tuple(r) for r in graph.call_pairs(spans).collect()}
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 1_500
