"""Operator 7, toxicity: a word classifier with a counterfactual penalty.

A logistic regression over words and word beginnings. A beginning (``stem~``) counts in words that
go on after it, and has three features: it occurs, it occurs twice, it begins one word in a
hundred. For each labelled text that names a group, the
same text with each group's name exchanged for another's is made; the squared difference of
the two scores is added to the loss. Names of groups then carry no weight of their own, so
neutral mentions are not taken for insults.

Learning takes at most ``MAX_LABELLED`` labelled rows, those with the smallest hashes of ``doc_id``,
so its data are bounded; features are chosen from their counts by Spark, and the regression
runs on the chosen ones only. Scoring reads every whole text, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootscope.llm.common import held_out, map_texts, whole_text
from rootscope.session import materialise

#: Bounds of the learner: labelled rows, features, and what a feature needs to be considered.
MAX_LABELLED, MAX_FEATURES, LEAST_TEXTS, LEAST_CHI2 = 12_000, 3_000, 5, 12.0
#: Lengths of beginnings.
STEMS = (5, 6, 7)
RIDGE, COUNTERFACTUAL, STEPS = 1.0, 10.0, 400
THRESHOLD = 0.5

# fixed values: names of groups; each is exchanged for the next of its line
GROUPS = [
    "women men", "woman man", "girls boys", "girl boy", "female male", "muslim christian jewish hindu buddhist",
    "muslims christians jews hindus buddhists", "black white asian latino", "gay straight lesbian", "immigrant native foreigner",
    "immigrants natives foreigners", "femmes hommes", "femme homme", "musulman chrétien juif", "musulmans chrétiens juifs",
    "noir blanc", "frauen männer", "frau mann", "muslime christen juden", "ausländer einheimische", "mujeres hombres",
    "mujer hombre", "musulmán cristiano judío", "musulmanes cristianos judíos", "negro blanco", "extranjeros nativos",
]
EXCHANGED = {w: line[(i + 1) % len(line)] for line in map(str.split, GROUPS) for i, w in enumerate(line)}
WORD = re.compile(r"\w+")


def words_of(text: str) -> Counter[str]:
    return Counter(WORD.findall(text.lower()))


def stems(word: str) -> list[str]:
    return [word[:k] for k in STEMS if len(word) > k]


def features(words: Counter[str]) -> set[str]:
    """Words, and beginnings of words by how often they occur."""
    begun: Counter[str] = Counter()
    for word, n in words.items():
        for stem in stems(word):
            begun[stem] += n
    return words.keys() | _levels(begun, words.total())


def _levels(begun: Counter[str], total: int) -> set[str]:
    found = {f"{s}~" for s in begun}
    found |= {f"{s}~2" for s, n in begun.items() if n > 1}
    return found | {f"{s}~%" for s, n in begun.items() if n > 1 and 100 * n >= total}


def counterfactual(words: Counter[str]) -> Counter[str]:
    """The words of the text with all names of groups exchanged."""
    swapped: Counter[str] = Counter()
    for word, n in words.items():
        swapped[EXCHANGED.get(word, word)] += n
    return swapped


def labelled_features(text: str) -> tuple[list[str], list[str] | None]:
    """Features of a text, and of its counterfactual if it names a group."""
    words = words_of(text)
    named = not EXCHANGED.keys().isdisjoint(words)
    return sorted(features(words)), sorted(features(counterfactual(words))) if named else None


class WordModel:
    """Weights of features and an intercept."""

    def __init__(self, intercept: float, weights: dict[str, float]):
        self.intercept, self.weights = intercept, weights
        self.stems = {f.partition("~")[0] for f in weights if "~" in f}
        # words of which the model knows a beginning; a bounded memory
        self.begun: dict[str, list[str]] = {}

    def score(self, text: str) -> float:
        words = words_of(text)
        begun: Counter[str] = Counter()
        for word, n in words.items():
            known = self.begun.get(word)
            if known is None:
                known = self.begun[word] = [s for s in stems(word) if s in self.stems]
            for stem in known:
                begun[stem] += n
        if len(self.begun) > 300_000:
            self.begun.clear()
        found = (words.keys() | _levels(begun, words.total())) & self.weights.keys()
        total = self.intercept + sum(self.weights[w] for w in sorted(found))
        return float(1 / (1 + np.exp(-total)))

    @classmethod
    def fit(
        cls, texts: list[set[str]], exchanged: list[set[str]], labels: list[int], strength: float = COUNTERFACTUAL
    ) -> WordModel:
        """From features of texts and of their counterfactuals. Accelerated gradient steps on

        sum of log losses + RIDGE/2 |w|^2 + strength/2 * sum over texts (w.(x - x'))^2
        """
        positive = sum(labels)
        share = (positive + 1) / (len(labels) + 2)
        if not 0 < positive < len(labels):
            return cls(float(np.log(share / (1 - share))), {})
        names = sorted(set().union(*texts, *exchanged))
        place = {w: i for i, w in enumerate(names)}
        x = _Rows([[(place[w], 1.0) for w in t] for t in texts])
        d = _Rows([[(place[w], 1.0) for w in t - u] + [(place[w], -1.0) for w in u - t] for t, u in zip(texts, exchanged) if t != u])
        y, n = np.array(labels, float), len(names)
        # the step is bounded by the largest curvature, found by a few power iterations
        v = np.random.default_rng(7).normal(size=n + 1)
        for _ in range(30):
            v /= np.linalg.norm(v)
            u = 0.25 * (x.dot(v[:n]) + v[n])
            v = np.append(x.back(u, n) + strength * d.back(d.dot(v[:n]), n) + RIDGE * v[:n], u.sum())
        step = 0.9 / max(np.linalg.norm(v), 1e-9)
        w, last, b, last_b = np.zeros(n), np.zeros(n), np.log(share / (1 - share)), np.log(share / (1 - share))
        for k in range(STEPS):
            pace = k / (k + 3)
            at, at_b = w + pace * (w - last), b + pace * (b - last_b)
            off = 1 / (1 + np.exp(-(x.dot(at) + at_b))) - y
            slope = x.back(off, n) + RIDGE * at + strength * d.back(d.dot(at), n)
            last, last_b = w, b
            w, b = at - step * slope, at_b - step * off.sum()
        return cls(float(b), {k: float(v) for k, v in zip(names, w) if abs(v) > 1e-4})


class _Rows:
    """Sparse rows for products with a vector from both sides."""

    def __init__(self, rows: list[list[tuple[int, float]]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        flat = [c for r in rows for c in r]
        self.column = np.array([c for c, _ in flat], np.int64)
        self.value = np.array([v for _, v in flat], float)

    def dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.column], self.n)

    def back(self, u: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.column, self.value * u[self.row], n)


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> WordModel:
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    known = known.select("doc_id", F.col("toxic").alias("label")).distinct()
    # bounded by MAX_LABELLED rows of two numbers, so it may be sent to every task
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED), "toxic-rows")
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = materialise(
        map_texts(texts, ["doc_id", "label"], _labelled, "features array<string>, swapped array<string>"), "toxic-features"
    )
    n, positive = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = found.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("seen"), F.sum("label").alias("toxic")
    )
    # one degree of freedom: feature and label
    a, s, p = F.col("toxic"), F.col("seen"), F.lit(float(positive))
    cells = s * (n - s) * p * (n - p)
    chi2 = F.when(cells > 0, F.lit(float(n)) * F.pow(a * (n - s) - (p - a) * (s - a), F.lit(2.0)) / cells).otherwise(0.0)
    counts = counts.where(F.col("seen") >= LEAST_TEXTS).withColumn("chi2", chi2)
    named = F.col("feature").isin(*EXCHANGED)
    best = counts.where((F.col("chi2") >= LEAST_CHI2) | named)
    best = best.orderBy(F.desc(named), F.desc("chi2"), "feature").limit(MAX_FEATURES)
    names = [r[0] for r in best.select("feature").collect()]  # at most MAX_FEATURES
    wanted = F.split(F.lit("\n".join(names)), "\n")  # one literal
    only = lambda column: F.array_intersect(column, wanted)
    # at most MAX_LABELLED rows of at most MAX_FEATURES chosen features
    rows = found.select("label", only("features").alias("features"), only("swapped").alias("swapped")).collect()
    texts = [set(r["features"]) for r in rows]
    exchanged = [t if r["swapped"] is None else set(r["swapped"]) for r, t in zip(rows, texts)]
    return WordModel.fit(texts, exchanged, [r["label"] for r in rows])


def _labelled(batch: list[str]) -> dict[str, list]:
    found = [labelled_features(t) for t in batch]
    return {k: pa.array([f[i] for f in found], pa.list_(pa.string())) for i, k in enumerate(("features", "swapped"))}


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row.

    The score is the probability of ``toxic`` 1; null and empty texts get the score of no words.
    Labels that are null or other than 0 and 1 teach nothing; without both labels all rows get
    one score. Repeated rows score alike; an empty table gives no rows; other columns are not read.
    """
    model = learn_toxicity(docs, labels)
    texts = docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text"))
    scored = map_texts(texts, ["doc_id", "held_out"], lambda batch: {"score": [model.score(t) for t in batch]}, "score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
