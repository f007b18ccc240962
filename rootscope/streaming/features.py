"""The window features on streams.

Event time is ``TIMESTAMP`` here, as watermarks ask for.  Late rows beyond the watermark
are dropped by Spark; exact distinct counts and percentiles are not possible in a
streaming aggregate, so the approximate ones stand in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootscope.operators import templates, traces
from rootscope.session import materialise


def _windowed(rows: DataFrame, watermark: str, seconds: int, *keys: str):
    timed = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", watermark)
    return timed.groupBy(F.window("timestamp", f"{int(seconds)} seconds").alias("_w"), *keys)


def _start() -> F.Column:
    return F.col("_w.start").cast("timestamp_ntz").alias("timestamp")


def metric_means(metrics: DataFrame, seconds: int = 60, watermark: str = "5 minutes") -> DataFrame:
    """Mean per instance, window and metric; bins without rows do not appear."""
    means = _windowed(metrics, watermark, seconds, "instance_id", "metric_name").agg(F.avg("value").alias("value"))
    return means.select("instance_id", _start(), F.col("metric_name").alias("feature"), "value")


def template_counts(logs: DataFrame, known: DataFrame, seconds: int = 60, watermark: str = "5 minutes") -> DataFrame:
    """Counts per instance, window and template of a stored template table of any size.

    Every message takes the best of the known templates, whatever its position.  Messages look their tokens
    up in the index of the templates; the best is taken per (window, instance, message), with
    one row per message that counts it, and the counts are added up per template.
    """
    worded = templates.scoped(known).where("text <> ''")
    theirs = worded.select("scope", "template_id", F.col("text").alias("_template"))
    index = templates.template_index(worded, templates.SIM_TH).join(theirs, ["scope", "template_id"])
    index = materialise(index, "stream-index")
    texts = templates.scoped(templates.with_text(logs)).withColumn("n", templates.token_count("text"))
    itself = F.array(F.lit(None).cast("bigint"))
    asked = texts.select("timestamp", "instance_id", "scope", "text", "n", F.explode(F.concat(itself, templates.spot_keys())).alias("key"))
    met = asked.join(index, ["key", "scope"], "left")
    equal = templates.equal_tokens(F.col("text"), F.col("_template"))
    met = met.withColumn("_equal", F.when(F.size(F.split("text", " ")) == F.size(F.split("_template", " ")), equal))
    fits = (F.col("_equal") > 0) & (F.col("_equal") / F.col("n") >= templates.SIM_TH)
    best = F.max(F.when(fits, F.struct("_equal", (-F.col("template_id")).alias("_age"), "template_id"))).alias("_best")
    messages = _windowed(met, watermark, seconds, "instance_id", "scope", "text").agg(F.count_if(F.col("key").isNull()).alias("_n"), best)
    again = F.window("_w", f"{int(seconds)} seconds").alias("_w")
    counts = messages.groupBy(again, "instance_id", F.col("_best.template_id").alias("template_id")).agg(F.sum("_n").alias("value"))
    name = F.concat(F.lit("template_"), F.coalesce(F.col("template_id").cast("string"), F.lit("unknown")))
    return counts.select("instance_id", _start(), name.alias("feature"), "value")


def trace_features(parsed: DataFrame, seconds: int = 60, watermark: str = "5 minutes") -> DataFrame:
    """The nineteen span features with approximate percentiles and distinct counts."""
    shares = [p / 100 for p in traces.PERCENTILES]
    found = _windowed(parsed, watermark, seconds, "instance_id").agg(
        *traces.red_columns(),
        *traces.status_columns(),
        *traces.type_columns(),
        F.approx_count_distinct("trace_id").alias("unique_trace_count"),
        F.approx_count_distinct("service_name").alias("unique_service_count"),
        F.percentile_approx("duration", shares).alias("_p"),
    )
    percentiles = [F.col("_p")[i].alias(f"p{p}_latency") for i, p in enumerate(traces.PERCENTILES)]
    wide = found.select("*", *percentiles)
    return wide.select("instance_id", _start(), *traces.FEATURES)


def call_pairs(parsed: DataFrame, watermark: str = "5 minutes", reach: str = "5 minutes") -> DataFrame:
    """Distinct ``(caller, callee)`` services from parent spans, whichever of the two arrives first.

    Spark keeps parents and children of each trace until the watermark says that no partner can come;
    the start of a parent lies within ``reach`` of its child's.  Pairs are emitted once.
    """
    timed = parsed.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", watermark)
    service = F.col("service_name")
    parents = timed.where(service.isNotNull()).select(
        F.col("trace_id").alias("_trace"), F.col("span_id").alias("_parent"), F.col("timestamp").alias("_at"), service.alias("caller")
    )
    children = timed.where(service.isNotNull() & F.col("parent_span_id").isNotNull()).select(
        "trace_id", "parent_span_id", "timestamp", service.alias("callee")
    )
    near = F.expr(f"_at BETWEEN timestamp - INTERVAL {reach} AND timestamp + INTERVAL {reach}")
    met = children.join(parents, (F.col("trace_id") == F.col("_trace")) & (F.col("parent_span_id") == F.col("_parent")) & near)
    return met.select("caller", "callee").dropDuplicates()
