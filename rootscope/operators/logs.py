"""Log rows to template counts per instance and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootscope.functions.scalars import log_ip, time_floor
from rootscope.operators.metrics import absent_cells
from rootscope.session import materialise

# Frequency below which a template is rare, and the merged name.
MIN_FREQUENCY = 10
RARE = "RARE_TEMPLATES"

CELL = ["instance_id", "timestamp", "feature"]


def with_instance(logs: DataFrame, file: str = "file") -> DataFrame:
    """Adds ``ip`` and ``instance_id``.

    In a file where any message names an ip the instance is ``service_ip`` (``NA`` where
    a message has none), else the service.  One stored flag per file is joined back: few
    files do not gather the rows in few tasks.
    """
    logs = logs.withColumn("ip", log_ip("message"))
    flags = logs.groupBy(file).agg(F.bool_or(F.col("ip").isNotNull()).alias("_any_ip"))
    named = F.concat("service", F.lit("_"), F.coalesce("ip", F.lit("NA")))
    return (
        logs.join(materialise(flags, "flags"), file)
        .withColumn("instance_id", F.when(F.col("_any_ip"), named).otherwise(F.col("service")))
        .drop("_any_ip")
    )


def template_counts(assigned: DataFrame, seconds: int = 60, zeros: bool = True) -> DataFrame:
    """Rows per instance, observed window and template: ``(…, feature, value)``.

    With ``zeros`` every template of an instance has a row in each of its observed
    windows; without, only what was seen.
    """
    counts = (
        assigned.withColumn("timestamp", time_floor("timestamp", seconds))
        .withColumn("feature", F.concat(F.lit("template_"), F.col("template_id").cast("string")))
        .groupBy(*CELL)
        .agg(F.count(F.lit(1)).alias("value"))
    )
    return with_zeros(counts) if zeros else counts


def with_zeros(counts: DataFrame) -> DataFrame:
    own = counts.groupBy("instance_id").agg(F.collect_set("feature").alias("_own"))
    rows = counts.groupBy("instance_id", "timestamp").agg(F.collect_list(F.struct("feature", "value")).alias("_cells"))
    zero = F.lit(0).cast(counts.schema["value"].dataType)
    cells = F.concat("_cells", absent_cells(F.col("_own"), F.col("_cells"), zero))
    return rows.join(own, "instance_id").select("instance_id", "timestamp", F.explode(cells).alias("_c")).select(
        "instance_id", "timestamp", "_c.feature", "_c.value"
    )


def merge_rare(counts: DataFrame, minimum: int = MIN_FREQUENCY, name: str = RARE) -> DataFrame:
    """Templates of an instance with a total below ``minimum`` become one feature."""
    totals = counts.groupBy("instance_id", "feature").agg((F.sum("value") < minimum).alias("_rare"))
    feature = F.when(F.col("_rare"), F.lit(name)).otherwise(F.col("feature"))
    return (
        counts.join(totals, ["instance_id", "feature"])
        .withColumn("feature", feature)
        .groupBy(*CELL)
        .agg(F.sum("value").alias("value"))
    )


def template_statistics(counts: DataFrame) -> DataFrame:
    return counts.groupBy("instance_id", "feature").agg(
        F.sum("value").cast("double").alias("total_frequency"),
        F.avg("value").alias("mean_frequency"),
        F.max("value").cast("double").alias("max_frequency"),
        F.count_if(F.col("value") > 0).alias("non_zero_count"),
    )


def template_text(ids: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds ``template_text``: the joined tokens, or ``TEMPLATE_<id>`` for an unknown id."""
    names = templates.select("template_id", F.col("text").alias("_text"))
    fallback = F.concat(F.lit("TEMPLATE_"), F.col("template_id").cast("string"))
    return (
        ids.join(names, "template_id", "left").withColumn("template_text", F.coalesce("_text", fallback)).drop("_text")
    )
