"""Operator 8, near duplicates: one-permutation MinHash, banded buckets, star-shaped candidates.

A text is the set of its 5-word shingles, each a 64-bit number. The numbers are dealt into bins
by size; a bin's smallest number is its value (one permutation for all bins), and an
empty bin takes that of the first filled bin on its own fixed random walk (optimal
densification), so every bin of two texts agrees with probability J. Some bins make a band;
texts that agree in a band share a bucket.

Bands are used twice. Of all texts, those that share no bucket of ``COARSE`` bands have no partner:
at J = 0.75 a pair misses all of them with probability 5e-6. The others are read again and put
into buckets of ``FINE`` bands, which a pair at 0.75 misses with probability 1e-6 and a pair at 0.4,
such as two texts with one passage in common, meets once in forty.

Texts with equal sets are one node. A bucket proposes a *star*: its centre, the member with the most
bucket mates, with each member, not all pairs. Stars are confirmed on the full sets. A bucket whose
members then are in one component is settled. Members of the others that share a centre z are settled
together, by how they differ from z. With D(x) the shingles that only one of x and z has,

    |x △ y| = |D(x)| + |D(y)| - 2 |D(x) ∩ D(y)|,    linked:  q |x △ y| <= r (|x| + |y|)

for q = 100 + percent and r = 100 - percent. So with slack s(x) = q |D(x)| - r |x| two members are linked
if and only if s(x) + s(y) <= 2 q |D(x) ∩ D(y)|. If the left side is not positive, both
are linked with z, whose slack is least, and the star has joined them. Every other link shares some t >= 1 differences, of
which one is among the rarest |D| - t + 1 of either side: a join on those finds it. Members go by
classes of slack, so that t is known well; differences that only members of one component have, or only such as
are in that of z, are left out. Only members outside the component of z look for partners. Near copies of one text differ in what is rare, so few
pairs meet, and within buckets no link is lost.

For fewer than 75 percent bands get shorter and more, so that a link at the limit is missed as seldom.

Every table that later steps read is written below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import math
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.llm.common import map_texts, whole_text, with_row_number
from rootscope.session import discard, materialise, scratch_folder

WORDS = 5
#: Numbers of bands, and of bins in a band, for ``USUAL`` percent and more.
USUAL = 75
COARSE, FINE = (32, 4), (240, 10)
#: Limits of the classes of slack, in parts of r times the size of the centre's set.
SLACK = [-0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingle numbers; A-Z as a-z, words between ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    number = xxhash.xxh3_64_intdigest
    each = np.array([number(w) for w in words], np.uint64)
    size = min(WORDS, len(each))
    total = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        total += each[k : len(each) - size + 1 + k] * _ODD[k]
    return np.unique(_mixed(total))


def bands_for(usual: tuple[int, int], percent: int) -> tuple[int, int]:
    """Bands that a pair at ``percent`` misses as seldom as a pair at 75 misses the usual ones, the longest in as many bins."""
    bands, rows = usual
    if percent >= USUAL:
        return usual
    missed = bands * math.log1p(-((USUAL / 100) ** rows))
    for r in range(rows, 0, -1):
        wanted = math.ceil(missed / math.log1p(-((percent / 100) ** r)))
        if wanted * r <= bands * rows or r == 1:
            return wanted, r


@lru_cache(2)
def _walks(bins: int) -> np.ndarray:
    """For each bin the bins to look into while it is empty."""
    return np.random.default_rng(8).integers(0, bins, (bins, 2048), np.int16)


def signature(numbers: np.ndarray, bins: int) -> np.ndarray:
    """The values of all bins, for a set that is not empty."""
    place = ((numbers >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    filled, first = np.unique(place, return_index=True)  # sorted, so the first of a bin is its least
    values = np.zeros(bins, np.uint64)
    values[filled] = numbers[first]
    has = np.zeros(bins, bool)
    has[filled] = True
    source = np.arange(bins)
    empty, done = np.flatnonzero(~has), 0
    for upto in (4, 16, 64, 256, 2048):
        if not len(empty):
            break
        walk = _walks(bins)[empty, done:upto]
        hit = has[walk]
        at = hit.argmax(1)
        each = np.arange(len(empty))
        found = hit[each, at]
        source[empty[found]] = walk[each, at][found]
        empty, done = empty[~found], upto
    source[empty] = filled[0]
    return values[source]


def bands_of(values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """One bucket number for each band of a signature."""
    bands, rows = shape
    values = values[: bands * rows].reshape(bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[4]
    for k in range(rows):  # mixed in turn, so that order and band matter
        total = _mixed(total + values[:, k])
    return total.view(np.int64)


def _signed(texts: list[str], shape: tuple[int, int] = COARSE) -> dict[str, list]:
    out = {"n": [], "sum_a": [], "sum_b": [], "bands": []}
    for text in texts:
        numbers = shingles(text)
        out["n"].append(len(numbers))
        # two sums over a set name it: equal sets have equal sums
        out["sum_a"].append(int(_mixed(numbers).sum(dtype=np.uint64).view(np.int64)))
        out["sum_b"].append(int(_mixed(numbers ^ _ODD[0]).sum(dtype=np.uint64).view(np.int64)))
        out["bands"].append(bands_of(signature(numbers, shape[0] * shape[1]), shape) if len(numbers) else None)
    return {k: pa.array(v, pa.int64()) for k, v in out.items() if k != "bands"} | {
        "bands": pa.array(out["bands"], pa.list_(pa.int64()))
    }


def _sets(texts: list[str], shape: tuple[int, int] = FINE) -> dict[str, list]:
    found = [shingles(t) for t in texts]
    return {
        "numbers": pa.array([f.tobytes() for f in found], pa.binary()),
        "bands": pa.array([bands_of(signature(f, shape[0] * shape[1]), shape) for f in found], pa.list_(pa.int64())),
    }


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    for x in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("numbers").alias(f"numbers_{x}")), x)
    return pairs.select("a", "b", "numbers_a", "numbers_b")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs those whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("numbers_a"), batch.column("numbers_b")
            keep = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "similar"])

    judged = _with_sets(pairs, sets).mapInArrow(run, "a bigint, b bigint, similar boolean")
    return judged.where("similar").select("a", "b")


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b``, the sizes of their sets, and ``apart``, the shingles that only one of them has."""

    def run(batches):
        for batch in batches:
            xs, ys = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(f"numbers_{k}")] for k in "ab")
            apart = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(xs, ys)]
            sizes = [pa.array([len(v) for v in side], pa.int64()) for side in (xs, ys)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), *sizes, pa.array(apart, pa.list_(pa.int64()))], ["a", "b", "n_a", "n_b", "apart"]
            )

    return _with_sets(pairs, sets).mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint, apart array<bigint>")


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it is joined with; by large and small stars.

    Both steps send each neighbour to the smallest one; edges become stars around roots.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _in_buckets(nodes: DataFrame) -> DataFrame:
    """``bucket``, ``node``, ``size`` of buckets with several members; ``nodes`` is stored."""
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = materialise(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "crowded")
    return materialise(placed.join(crowded, "bucket"), "in-buckets")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node``, ``root`` after the links have joined components."""
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    merged = connected(links.join(root("a"), "a").join(root("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    merged = merged.select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    return materialise(roots.join(merged, "root", "left").select("node", F.coalesce("new_root", "root").alias("root")), "roots")


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``centre``, ``node`` of buckets whose members, without the centre, are in several components."""
    others = members.where("node <> centre").join(roots, "node")
    several = others.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return others.join(several.select("bucket"), "bucket", "left_semi").select("centre", "node").distinct()


def _near_differences(groups: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: members of one group that may be linked and are in two components."""
    q, r = 100 + percent, 100 - percent
    apart = _differences(groups.select(F.col("centre").alias("a"), F.col("node").alias("b")), sets)
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    apart = materialise(apart.join(root("a"), "a").join(root("b"), "b"), "apart")
    slack = q * F.size("apart") - r * F.col("n_b")
    unit = F.col("n_a") * max(r, 1)
    member = apart.select(
        F.col("a").alias("centre"), F.col("b").alias("node"), F.col("root_b").alias("root"), unit.alias("unit"), slack.alias("slack"),
        (F.col("root_a") != F.col("root_b")).alias("far"),
        sum((slack >= limit * unit).cast("int") for limit in SLACK).alias("class"),
    )
    each = apart.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.explode("apart").alias("e"))
    # of no use: what no two components share, or only such as are joined with the centre
    each = each.join(member.select("centre", "node", "root", "far"), ["centre", "node"])
    held = each.groupBy("centre", "e").agg(F.count(F.lit(1)).alias("held"), F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or("far").alias("met"))
    held = held.where(F.col("met") & (F.col("low") != F.col("high"))).select("centre", "e", "held")
    held = materialise(held, "held")
    by_rarity = F.array_sort(F.collect_list(F.struct("held", "e")))  # of one text
    rare = each.join(held, ["centre", "e"]).groupBy("centre", "node").agg(by_rarity.alias("rare"))
    member = materialise(member.join(rare.withColumn("rare", F.transform("rare", lambda x: x["e"])), ["centre", "node"]), "rare")

    def wanted(of_class: Column, mine: str = "") -> Column:
        """How many of ``rare`` are to be looked at for partners of a class."""
        least = F.get(F.array(*[F.lit(float(x)) for x in [-1.0, *SLACK]]), of_class) * F.col("unit")
        shared = F.greatest(F.lit(1), F.ceil((F.col(f"slack{mine}") + least) / (2.0 * q)))
        return F.greatest(F.col(f"held{mine}") - shared + 1, F.lit(0)).cast("int")

    # the lower its class, the more of a member's differences a partner asks for; of two partners one is far, so others
    # ask for classes of far members only
    at_hand = member.groupBy("centre").agg(F.min("class").alias("all"), F.min(F.when(F.col("far"), F.col("class"))).alias("of_far"))
    lowest = F.when(F.col("far"), F.col("all")).otherwise(F.col("of_far"))
    placed = member.withColumn("held", F.size("rare")).join(at_hand, "centre").withColumn("rare", F.slice("rare", F.lit(1), wanted(lowest)))
    placed = placed.select("centre", "node", "root", "unit", "slack", "held", "far", "class", F.posexplode("rare").alias("at", "e"))
    placed = materialise(placed, "placed")
    side = lambda rows, x: rows.select(
        "centre", "unit", "e", *[F.col(c).alias(f"{c}_{x}") for c in ("root", "slack", "held", "class", "at")], F.col("node").alias(x)
    )
    total = F.col("slack_a") + F.col("slack_b")
    met = side(placed.where("far"), "a").join(side(placed, "b").drop("unit"), ["centre", "e"])
    met = met.where((F.col("root_a") != F.col("root_b")) & (total <= 2 * q * F.least("held_a", "held_b")))
    met = met.where((F.col("at_a") < wanted(F.col("class_b"), "_a")) & (F.col("at_b") < wanted(F.col("class_a"), "_b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node``, ``root`` for all nodes of buckets; ``members`` has ``bucket``, ``node``, ``weight``."""
    centre = F.max(F.struct("weight", F.xxhash64("node").alias("h"), "node"))["node"]
    centres = members.groupBy("bucket").agg(centre.alias("centre"))
    members = materialise(members.select("bucket", "node").join(centres, "bucket"), "members")
    sizes = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))
    star = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(sizes("a"), "a").join(sizes("b"), "b")
    star = star.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")
    roots = materialise(sets.select("node", F.col("node").alias("root")), "roots")
    roots = _joined(roots, materialise(_links(star, sets, percent), "links"))
    groups = materialise(_unsettled(members, roots), "unsettled")
    if groups.isEmpty():
        return roots
    pairs = materialise(_near_differences(groups, roots, sets, percent), "pairs")
    return _joined(roots, materialise(_links(pairs, sets, percent), "links"))


def near_duplicates(docs: DataFrame, percent: int = 75, row: str | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row.

    A-Z become a-z; words stand between ASCII white space. A text's set holds its distinct runs
    of five words, or its whole sequence if it has fewer; a null, empty or blank text has the
    empty set and is linked with nothing. Rows are linked if 100 times the intersection is at
    least ``percent`` times the union. ``component_id`` is the smallest ``doc_id`` that links
    reach (null only if none there is known); the row with it is kept, of repeated rows one. An empty
    table gives no rows. Only
    ``doc_id``, ``text`` and ``row``, which numbers the rows and is then returned, are read.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be from 1 to 100, not {percent}")
    spark = docs.sparkSession
    number = F.col(row) if row else F.monotonically_increasing_id()
    # id and text hash find the row again in the second reading
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("text_key", F.xxhash64("text"))
    known = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    rows = rows.withColumn("id_key", known)
    first = docs.select("doc_id", number.alias("uid"), whole_text().alias("text"))
    first = first.withColumn("text_key", F.xxhash64("text"))
    signed = materialise(
        map_texts(first, ["uid", "doc_id", "text_key"], partial(_signed, shape=bands_for(COARSE, percent)), "n bigint, sum_a bigint, sum_b bigint, bands array<bigint>"), "signed"
    )
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid", "text_key")).alias("first")
    of_set = ["n", "sum_a", "sum_b"]
    nodes = materialise(
        signed.where("n > 0").groupBy(*of_set).agg(one, F.any_value("bands").alias("bands")).select(
            *of_set, F.col("first.uid").alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), "bands"
        ),
        "nodes",
    )
    wanted = nodes.join(_in_buckets(nodes).select("node").distinct(), "node", "left_semi").select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("id_key"), "text_key", "node", "n"
    )
    with scratch_folder(spark, "near-work") as work:
        # the texts are dealt out by document at every size, as they must be once many are in buckets
        again = rows.join(wanted.hint("merge"), ["id_key", "text_key"]).select("node", "n", "text")
        sets = map_texts(again, ["node", "n"], partial(_sets, shape=bands_for(FINE, percent)), "numbers binary, bands array<bigint>")
        sets = materialise(sets.dropDuplicates(["node"]), "sets")
        members = _in_buckets(sets)
        mates = members.groupBy("node").agg(F.sum("size").alias("weight"))
        roots = _roots(members.drop("size").join(mates, "node"), sets.drop("bands"), percent)
    roots = materialise(roots, "roots")
    discard(spark, work)

    named = nodes.select(*of_set, "node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node")).alias("lowest"))
    named = named.join(lowest, "root").select(*of_set, F.col("lowest.doc_id").alias("component_id"), F.col("lowest.node").alias("stays"))
    found = signed.drop("bands", "text_key").join(named, of_set, "left")
    return found.select(
        *([F.col("uid").alias(row)] if row else []),
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("stays") == F.col("uid"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns kept.

    The smallest ``doc_id`` stays, null last, of repeated rows one; texts without words are linked with
    nothing and all stay. An empty table gives no rows.
    """
    rows, row = with_row_number(docs, "near-rows")
    return rows.join(near_duplicates(rows, row=row).where("kept").select(row), row, "left_semi").select(*docs.columns)
