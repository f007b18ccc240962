"""How good a ranking is, and which cases to judge it on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootscope.operators.spread import block_chunk, with_ordinal


def first_hits(ranked: DataFrame, cases: DataFrame, depth: int, match: str = "prefix") -> DataFrame:
    """``(case_id, first)``: rank of the first node that is the root cause, or NULL.

    ``match``: ``exact`` name, ``prefix`` (a service hits its instances) or ``substring`` of
    the ``node:score`` text.
    """
    cause, node = F.col("cmdb_id"), F.col("node")
    hit = {
        "exact": node == cause,
        "prefix": node.startswith(cause),
        "substring": F.concat(node, F.lit(":"), F.col("score").cast("string")).contains(cause),
    }[match]
    hits = ranked.where(F.col("rank") <= depth).join(cases.select("case_id", "cmdb_id"), "case_id").where(hit)
    firsts = hits.groupBy("case_id").agg(F.min("rank").alias("first"))
    return cases.select("case_id").join(firsts, "case_id", "left")


def topk_accuracy(ranked: DataFrame, cases: DataFrame, k: int = 5, match: str = "prefix") -> DataFrame:
    """``(k, accuracy)``: share of cases whose root cause is among the first k."""
    firsts = first_hits(ranked, cases, k, match)
    shares = [
        F.round(F.avg(F.coalesce(F.col("first") <= i, F.lit(False)).cast("int")), 8).alias(str(i)) for i in range(1, k + 1)
    ]
    listed = F.array(*[F.struct(F.lit(i).alias("k"), F.col(str(i)).alias("accuracy")) for i in range(1, k + 1)])
    return firsts.agg(*shares).select(F.inline(listed))


def mrr(ranked: DataFrame, cases: DataFrame, depth: int = 10, match: str = "prefix") -> DataFrame:
    """Mean reciprocal rank within the first ``depth``; 0 for a miss."""
    return first_hits(ranked, cases, depth, match).agg(
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 8).alias("mrr")
    )


def head_samples(table: DataFrame, n: int | str, order: list[str], block: int = 65_536) -> DataFrame:
    """The first ``n`` rows in a stated order, whose first column is a number, or the whole table."""
    if n == "whole":
        return table
    numbered = with_ordinal(table, [], order, block_chunk(order[0], block), "_head")
    return numbered.where(F.col("_head") <= int(n)).drop("_head")


def case_split(
    cases: DataFrame, share: int | float, order: str = "case_id", disjoint: bool = False, block: int = 65_536
) -> DataFrame:
    """Adds ``split``: the first ``share`` cases (a number or a fraction) are ``feedback``.

    Test cases are all cases, so a feedback case appears in both splits; with
    ``disjoint`` the test split has only the rest.
    """
    if isinstance(share, bool) or not (isinstance(share, int) or 0 < share < 1):
        raise ValueError("share is a number of cases or a fraction between 0 and 1")
    n = F.lit(share) if isinstance(share, int) else F.floor(cases.agg(F.count(F.lit(1))).scalar() * F.lit(share))
    numbered = with_ordinal(cases, [], [order], block_chunk(order, block), "_case_no")
    chosen = F.col("_case_no") <= n
    if disjoint:
        return numbered.withColumn("split", F.when(chosen, "feedback").otherwise("test")).drop("_case_no")
    splits = F.when(chosen, F.array(F.lit("feedback"), F.lit("test"))).otherwise(F.array(F.lit("test")))
    return numbered.withColumn("split", F.explode(splits)).drop("_case_no")
