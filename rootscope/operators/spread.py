"""Ordered work on groups of any size.

A series may hold a third of all rows, so nothing here sorts or buffers a whole
group in one task.  A group is cut into chunks by a rule that keeps its order (a
span of time, a block of numbers); chunks are worked on in parallel, one small row
per chunk carries what later chunks need, and a join on (group, chunk) brings it
back.  Both sides start from one shared exchange on (group, chunk).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootscope.functions.scalars import epoch_seconds
from rootscope.session import materialise

DAY = 86_400
_CHUNK = "_chunk"


def time_chunk(order: str, seconds: int = DAY) -> Column:
    return F.floor(epoch_seconds(order) / F.lit(seconds))


def block_chunk(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size))


def _chunked(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    return df.withColumn(_CHUNK, chunk).repartition(*keys, _CHUNK)


def known_neighbours(
    df: DataFrame, keys: list[str], order: str, value: str, chunk: Column
) -> DataFrame:
    """Adds ``_row`` (row number in the group) and the nearest known values.

    ``_prev`` and ``_next`` are ``struct(pos, v)`` of the last non-NULL value at or before
    the row and the first at or after it.
    """
    by_chunk = Window.partitionBy(*keys, _CHUNK)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    base = (
        _chunked(df, keys, chunk)
        .withColumn("_row", F.row_number().over(by_chunk.orderBy(order)).cast("bigint"))
        .withColumn(
            "_here", F.when(F.col(value).isNotNull(), F.struct(F.col("_row").alias("pos"), F.col(value).alias("v")))
        )
    )
    sums = base.groupBy(*keys, _CHUNK).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_here").alias("_end"), F.min("_here").alias("_start")
    )
    chunks = Window.partitionBy(*keys)
    earlier = chunks.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = chunks.orderBy(F.desc(_CHUNK)).rowsBetween(Window.unboundedPreceding, -1)

    def shifted(c: str) -> Column:
        return F.when(
            F.col(c).isNotNull(),
            F.struct((F.col(c).getField("pos") + F.col("_skip")).alias("pos"), F.col(c).getField("v").alias("v")),
        )

    carried = (
        sums.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_end", shifted("_end"))
        .withColumn("_start", shifted("_start"))
        .select(
            *keys,
            _CHUNK,
            "_skip",
            F.last("_end", ignorenulls=True).over(earlier).alias("_from_before"),
            F.last("_start", ignorenulls=True).over(later).alias("_from_after"),
        )
    )
    local_prev = F.last("_here", ignorenulls=True).over(by_chunk.orderBy(order).rowsBetween(*so_far))
    local_next = F.last("_here", ignorenulls=True).over(by_chunk.orderBy(F.desc(order)).rowsBetween(*so_far))
    return (
        base.withColumn("_prev", local_prev)
        .withColumn("_next", local_next)
        .join(carried, [*keys, _CHUNK])
        .withColumn("_prev", F.coalesce(shifted("_prev"), "_from_before"))
        .withColumn("_next", F.coalesce(shifted("_next"), "_from_after"))
        .withColumn("_row", F.col("_row") + F.col("_skip"))
        .drop("_here", "_skip", "_from_before", "_from_after", _CHUNK)
    )


def previous_in_group(
    df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column, out: str
) -> DataFrame:
    """``value`` of the row before, by ``order``; ``chunk`` must rise with it."""
    base = _chunked(df, keys, chunk)
    local_w = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    ends = base.groupBy(*keys, _CHUNK).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    ends_w = Window.partitionBy(*keys).orderBy(_CHUNK)
    carried = ends.select(*keys, _CHUNK, F.lag("_end").over(ends_w).alias("_carry"))
    return (
        base.withColumn("_local", F.lag(value).over(local_w))
        .withColumn("_first", F.row_number().over(local_w) == 1)
        .join(carried, [*keys, _CHUNK])
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_local")))
        .drop("_local", "_first", "_carry", _CHUNK)
    )


def with_ordinal(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str, start: int = 1
) -> DataFrame:
    """Row number within each group; ``chunk`` must rise with ``order``."""
    base = _chunked(df, keys, chunk)
    local_w = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    sizes = base.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    sizes_w = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, _CHUNK, F.coalesce(F.sum("_n").over(sizes_w), F.lit(0)).alias("_offset"))
    return (
        base.withColumn("_local_row", F.row_number().over(local_w))
        .join(offsets, [*keys, _CHUNK])
        .withColumn(out, (F.col("_offset") + F.col("_local_row") + (start - 1)).cast("bigint"))
        .drop("_local_row", "_offset", _CHUNK)
    )


def last_before(
    rows: DataFrame, probes: DataFrame, keys: list[str], order: str, value: str, chunk: Column, n: int, out: str
) -> DataFrame:
    """Adds to ``probes`` the array ``out``: the last ``n`` of ``value`` before each probe, oldest first.

    Counted are rows of the same ``keys`` whose ``order`` lies before the probe's; ``chunk``, made from
    ``order``, must rise with it.  Rows and probes are sorted together per (group, chunk).
    What a chunk lacks comes from the ends of the chunks before it that hold rows, ``n`` of
    them at most; a chunk hands on one small row.
    """
    others = [c for c in probes.columns if c not in (*keys, order)]
    held = rows.select(*keys, order, F.col(value).alias("_v"), F.lit(True).alias("_is_row"))
    asked = probes.select(*keys, order, *others, F.lit(False).alias("_is_row"))
    by_chunk = Window.partitionBy(*keys, _CHUNK)
    # at equal places the probe comes first; it shares the count of the row before it
    seen = F.count("_v").over(by_chunk.orderBy(order, "_is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    recent = F.collect_list("_v").over(by_chunk.orderBy("_seen").rangeBetween(-(n - 1), Window.currentRow))
    base = _chunked(held.unionByName(asked, allowMissingColumns=True), keys, chunk).withColumn("_seen", seen)
    base = base.withColumn("_recent", recent)
    end = F.struct(F.col(_CHUNK).alias("at"), F.max_by("_recent", "_seen").alias("values"))
    chunks = base.groupBy(*keys, _CHUNK).agg(F.when(F.max("_is_row"), end).alias("_end"))
    in_group = Window.partitionBy(*keys)
    filled = F.count("_end").over(in_group.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = F.collect_list("_end").over(in_group.orderBy("_filled").rangeBetween(-n, Window.currentRow))
    earlier = F.filter("_ends", lambda e: e.getField("at") < F.col(_CHUNK))
    carried = (
        chunks.withColumn("_filled", filled)
        .withColumn("_ends", ends)
        .select(*keys, _CHUNK, F.flatten(F.transform(F.array_sort(earlier), lambda e: e.getField("values"))).alias("_carried"))
    )
    both = F.concat(F.coalesce("_carried", F.array()), "_recent")
    return (
        base.where("NOT _is_row")
        .join(carried, [*keys, _CHUNK], "left")
        .withColumn(out, both)
        .withColumn(out, F.slice(out, F.greatest(F.size(out) - n, F.lit(0)) + 1, F.lit(n)))
        .select(*probes.columns, out)
    )


def numbered(df: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """``df`` stored with ``out``, the row number by ``order``, whose values have to be distinct.

    Rows are dealt out by ranges of ``order`` and numbered in each; one small row per
    range carries how many come before it.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    at = (F.col("_offset") + local + (start - 1)).cast("bigint")
    return materialise(ranged.join(offsets, "_range").withColumn(out, at).drop("_range", "_offset"), "numbered")


def _value_scale(value: Column) -> Column:
    """A rising function of the value that is even on a log scale, 64 steps per octave."""
    size = (F.log2(F.abs(value)) + 1100.0) * 64.0
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * size)


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    levels: int = 1,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    Values are counted per (group, value), then per (group, value range).  Running
    sums over the ranges tell which range holds each wanted rank, so only the rows
    of those ranges are ever ordered.  ``levels`` narrows the ranges again; use 2 when
    a group may be a whole series.
    """
    times = F.sum(weight) if weight else F.count(F.lit(1))
    left = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(times.alias("_n"))
        .withColumn("_scale", _value_scale(F.col(value)))
    )
    part = list(keys)
    ranks: dict[str, Column] = {}
    for level in range(levels):
        bucket = f"_b{level}"
        left = left.withColumn(bucket, F.floor(F.col("_scale") * (1024**level)))
        w = Window.partitionBy(*part)
        running = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        hist = left.groupBy(*part, bucket).agg(F.sum("_n").alias("_in"), *_kept(level))
        before = F.coalesce(F.sum("_in").over(running), F.lit(0)) + (F.col("_before") if level else F.lit(0))
        hist = hist.withColumn("_at", before)
        if level == 0:
            hist = hist.withColumn("_total", F.sum("_in").over(w))
        ranks = {name: (F.col("_total") - 1) * F.lit(p) for name, p in probs.items()}
        wanted = reduce(
            lambda a, b: a | b,
            [
                (edge(rank) >= F.col("_at")) & (edge(rank) < F.col("_at") + F.col("_in"))
                for rank in ranks.values()
                for edge in (F.floor, F.ceil)
            ],
        )
        hist = hist.where(wanted).select(*part, bucket, F.col("_at").alias("_before"), "_total")
        if level:
            left = left.drop("_before", "_total")
        part = [*part, bucket]
        left = left.join(hist, part)
    w = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = left.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(w), F.lit(0)))

    def value_at(rank: Column) -> Column:
        inside = (rank >= F.col("_from")) & (rank < F.col("_from") + F.col("_n"))
        return F.max(F.when(inside, F.col(value)))

    picks = []
    for name, rank in ranks.items():
        picks += [value_at(F.floor(rank)).alias(f"_lo_{name}"), value_at(F.ceil(rank)).alias(f"_hi_{name}")]
    found = placed.groupBy(*keys).agg(F.first("_total").alias("_total"), *picks)
    out = []
    for name, p in probs.items():
        exact = (F.col("_total") - 1) * F.lit(p)
        share = exact - F.floor(exact)
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * share).alias(name))
    return found.select(*keys, *out)


def _kept(level: int) -> list[Column]:
    return [F.first("_before").alias("_before"), F.first("_total").alias("_total")] if level else []
