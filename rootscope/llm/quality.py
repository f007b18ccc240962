"""Operator 3, quality: a sparse ensemble of rules over text statistics.

The statistics are column expressions. A small forest is grown on the labelled rows by Spark's
own learner; each path from a root is a rule, a conjunction of comparisons. A logistic
regression with an absolute-value penalty weighs the rules and drops most. What is left is
compiled into one column expression, so scoring is a projection of the statistics.

Learning reads every labelled row that is not held out, distributed; only trees and weights come
to the driver. Statistics are stored once and serve both learning and scoring.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.llm.common import held_out, whole_text
from rootscope.session import materialise

TREES, DEPTH, PENALTY = 24, 3, 0.0005
THRESHOLD = 0.3


def _without(characters: str) -> Column:
    """Number of characters of a set."""
    return F.col("n") - F.length(F.translate("text", characters, ""))


def statistics() -> dict[str, Column]:
    """Statistics by name, of a row's ``text`` (not null) and its length ``n``."""
    part = lambda count: count / F.greatest(F.col("n"), F.lit(1))
    words = F.split("text", " ")
    lines = F.split("text", "\n")
    return {
        "length": F.log1p(F.col("n").cast("double")),
        "word_length": F.col("n") / F.size(words),
        "words_distinct": F.size(F.array_distinct(words)) / F.size(words),
        "lines_distinct": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.log1p(F.col("n") / F.size(lines)),
        "capitals": part(F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))),
        "digits": part(_without("0123456789")),
        "marks": part(_without("#$%&*+=<>@^~_{}[]\\/")),
        "bars": part(_without("|")),
        "shouts": part(_without("!?")),
        "stops": part(_without(".,;:")),
        "odd": part(F.length(F.regexp_replace("text", r"[\p{L}\p{N}\p{P}\p{Z}\p{S}\n]+", ""))),
    }


NAMES = [
    "length", "word_length", "words_distinct", "lines_distinct", "line_length", "capitals", "digits", "marks", "bars",
    "shouts", "stops", "odd",
]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    rows = docs.select(*keep, whole_text().alias("text")).withColumn("n", F.length("text"))
    found = statistics()
    return rows.select(*keep, *[found[k].cast("double").alias(k) for k in NAMES])


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(description: str) -> list[Rule]:
    """Each path of a tree's printed form, from the root down."""
    rules, path = [], []
    for line in description.splitlines()[1:]:
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1]) - 2
            path = [*path[:depth], (NAMES[int(found[2])], found[3], float(found[4]))]
            rules.append(_shortest(path))
    return rules


def _shortest(path: list[tuple[str, str, float]]) -> Rule:
    """Of several bounds on one side of a statistic the tightest."""
    tight: dict[tuple[str, str], float] = {}
    for name, side, bound in path:
        old = tight.get((name, side), bound)
        tight[(name, side)] = min(old, bound) if side == "<=" else max(old, bound)
    return tuple(sorted((n, s, b) for (n, s), b in tight.items()))


def compiled(rule: Rule) -> Column:
    """A rule as a column: 1.0 where it holds."""
    holds = F.lit(True)
    for name, side, bound in rule:
        holds = holds & (F.col(name) <= bound if side == "<=" else F.col(name) > bound)
    return F.when(holds, 1.0).otherwise(0.0)


class RuleEnsemble:
    """Weighted rules; ``score`` is a column expression over the statistics."""

    def __init__(self, intercept: float, weights: dict[Rule, float]):
        self.intercept, self.weights = intercept, weights

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + compiled(rule) * F.lit(weight)
        return 1.0 / (1.0 + F.exp(-total))

    @classmethod
    def fit(cls, labelled: DataFrame) -> RuleEnsemble:
        """From the statistics and ``label`` (0 or 1). Without both labels the score is their share."""
        n, positive = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not 0 < positive < n:
            share = (positive + 1) / (n + 2)
            return cls(_logit(share), {})
        rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(labelled).select("features", "label")
        forest = RandomForestClassifier(
            numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=3, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy="onethird"
        ).fit(rows)
        rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString)})
        if not rules:
            return cls(_logit(positive / n), {})
        fired = labelled.select("label", F.array(*[compiled(r) for r in rules]).alias("fired"))
        fired = fired.groupBy("label", "fired").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        fired = fired.select("label", "weight", array_to_vector("fired").alias("features"))
        lasso = LogisticRegression(
            regParam=PENALTY, elasticNetParam=1.0, maxIter=60, standardization=False, weightCol="weight"
        ).fit(fired)
        weights = {r: float(w) for r, w in zip(rules, lasso.coefficients) if w}
        return cls(float(lasso.intercept), weights)


def _logit(share: float) -> float:
    return math.log(share / (1 - share))


def learn_quality(stats: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """From rows of ``stats`` (with ``doc_id``) that have a label 0 or 1 and are not held out."""
    known = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").alias("label"))
    train = stats.where(~held_out()).join(known, "doc_id").select("label", *NAMES)
    return RuleEnsemble.fit(materialise(train, "quality-train"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row.

    The score is the probability of ``quality`` 1; null and empty texts are scored as empty.
    Labels that are null or other than 0 and 1 teach nothing; without both labels all rows get
    one score. Repeated rows score alike; an empty table gives no rows; other columns are not read.
    """
    stats = materialise(with_statistics(docs, ["doc_id"]), "quality-statistics")
    model = learn_quality(stats, labels)
    scored = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted 0, all columns kept.

    Null texts count as empty; repeated rows stay or go together. Without both labels all rows
    get one score and stay or go together; an empty table gives no rows.
    Rows and statistics are stored together: texts are measured once, and the rules read
    columns, not the expressions behind them.
    """
    names = {c: f"_kept_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("doc_id"), F.col("text"))
    stored = materialise(with_statistics(held, ["doc_id", *names.values()]), "quality-rows")
    model = learn_quality(stored.select("doc_id", *NAMES), labels)
    kept = stored.where(model.score() >= THRESHOLD)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
