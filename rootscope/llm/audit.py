"""Operator 13, filter interaction audit: contractions of a contingency tensor.

Every document fails or passes five filters, so a part's documents fill a table of 2 x 2 x 2 x 2 x 2
counts. A step of a filter order selects pass, fail or all along each axis: kept documents pass the filters
up to the step, removed ones pass those before it and fail its own. One einsum over the tensors of a
part gives all steps of all 120 orders.

Spark fills the tensors: flags come from one pass over the texts (Arrow batches, work on bytes), repeated texts are found by
SHA-256 and byte length of the whole text. Rows are narrow from there on, and equal ones
are counted before they meet labels and the first documents of repeated texts; a group of copies
that holds a third of all rows is a few rows per part by then. Parts are contracted apart from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootscope.llm.common import UPPER, map_texts, whole_text

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, MARKS = 200, 50, 2, "#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts contracted at once: 600 rows each.
PARTS_AT_ONCE = 64

_UPPER, _MARKS = UPPER.encode(), frozenset(MARKS.encode())
_LATER_BYTES = bytes(range(0x80, 0xC0))


def _fails(text: bytes) -> int:
    """Bits 1, 2, 4, 8 for the filters A, B, C, D that a text fails."""
    words = text.split()  # of bytes: at ASCII white space
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _LATER_BYTES))
    return (
        (len(words) < LEAST_WORDS)
        + 2 * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
        + 4 * (100 * upper > MOST_UPPER * points)
        + 8 * any(mark in text for mark in _MARKS)
    )


def _facts(texts: list[bytes]) -> dict[str, list]:
    return {
        "fails": pa.array([_fails(t) for t in texts], pa.int32()),
        "digest": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
        "size": pa.array([len(t) for t in texts], pa.int64()),
    }


def contingency(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``fails`` (bits of A to E), ``n``, ``good``, ``toxic`` of each cell that has documents."""
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), whole_text().cast("binary").alias("text"))
    text = ["digest", "size"]
    facts = map_texts(rows, ["doc_id", "part"], _facts, "fails int, digest binary, size bigint")
    once = facts.groupBy("doc_id", "part", "fails", *text).agg(F.count(F.lit(1)).alias("n"))
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        *[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")]
    )
    # rows without an id have no label: keyed by their text they don't meet in one task
    no_id = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    known = once.withColumn("no_id", no_id).join(marked.withColumn("no_id", F.lit(0)), ["doc_id", "no_id"], "left")
    copies = ["part", "fails", *text, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("quality", "toxic")]]
    at_id = F.struct("doc_id", "n")  # an id's rows of one text, part and label are one row here
    met = known.groupBy(*copies).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), at_id)).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_unknown"),
    )
    least = met.groupBy(*text).agg(F.min("first.doc_id").alias("least"))
    held = met.join(least, text)
    stay = F.col("n_unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    cells = held.select(
        "part", "quality", "toxic",
        F.inline(F.array(
            F.struct(F.col("fails"), stay.alias("n")),
            F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - stay).alias("n")),
        )),
    )
    return cells.groupBy("part", "fails").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("quality").cast("int")).alias("good"),
        F.sum(F.col("n") * F.col("toxic").cast("int")).alias("toxic"),
    )


_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def _selectors(pick) -> np.ndarray:
    """(steps of all orders, filter, 2): what ``pick(place of the filter, step)`` selects along each axis."""
    return np.array(
        [[pick(order.index(f), step) for f in FILTERS] for order in ORDERS for step in range(len(FILTERS))], dtype=np.int64
    )


def _contract(tensors: np.ndarray, pick) -> np.ndarray:
    """(part, steps) sums of ``tensors`` (part, 2, 2, 2, 2, 2) over the selected cells."""
    s = _selectors(pick)
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensors, *[s[:, i] for i in range(len(FILTERS))], optimize=True)


def audit_tensors(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every part, order and step (part, 600) from tensors with axes A to E, index 1 for fails."""

    def removed_at(place: int, step: int):
        return _PASS if place < step else _FAIL if place == step else _ALL

    kept = _contract(n, lambda place, step: _PASS if place <= step else _ALL)
    removed = _contract(n, removed_at)
    failing = _contract(n, lambda place, step: _FAIL if place == step else _ALL)
    alone = _contract(n, lambda place, step: _FAIL if place == step else _PASS)
    letter = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    by_filter = removed @ (letter[:, None] == np.arange(len(FILTERS)))
    return {
        "kept": kept,
        "removed": removed,
        "redundant": failing - removed,
        "unique_fails": alone,
        "good_lost": _contract(good, removed_at),
        "toxic_lost": _contract(toxic, removed_at),
        "shapley": by_filter[:, letter],
    }


def _tensor(flat: pa.Array) -> np.ndarray:
    """(part, 32) counts by bits of A to E to axes A to E; the first axis of the reshape is the highest bit."""
    cells = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2, 2, 2, 2, 2)
    return cells.transpose(0, 5, 4, 3, 2, 1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = len(ORDERS) * len(FILTERS)
    for batch in batches:
        for start in range(0, batch.num_rows, PARTS_AT_ONCE):
            part = batch.slice(start, PARTS_AT_ONCE)
            found = audit_tensors(*[_tensor(part.column(i)) for i in (1, 2, 3)])
            columns = {
                "part": part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), steps))),
                "filter_order": pa.array(np.tile(np.repeat(ORDERS, len(FILTERS)), part.num_rows).tolist()),
                "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), part.num_rows * len(ORDERS))),
            }
            columns |= {name: pa.array(values.reshape(-1)) for name, values in found.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per ``part`` (source), ``filter_order`` and ``step``: what five filters keep, remove and lose.

    Filters fail a text A: of under 200 words, B: whose distinct words are under half of its words, C: of over 2 %
    A-Z, D: with one of ``#$%&*|``, E: that a smaller ``doc_id`` of the table has as well. Words stand
    between ASCII white space. A null text is empty and a null source an empty string. Rows without
    ``doc_id`` never fail E, and no text repeats theirs; repeated rows of one ``doc_id`` fail E together or not
    at all. A document is good or toxic if any row of ``labels`` with its ``doc_id`` says 1. Every part has all
    600 rows, zeros included; an empty table has none. Other columns are not read.
    """
    cells = contingency(docs, labels)
    sums = [
        F.array(*[F.coalesce(F.sum(F.when(F.col("fails") == cell, F.col(c))), F.lit(0)) for cell in range(2 ** len(FILTERS))]).alias(c)
        for c in ("n", "good", "toxic")
    ]
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = ", ".join(["part string, filter_order string, step int", *[f"{c} bigint" for c in counts]])
    return cells.groupBy("part").agg(*sums).mapInArrow(_steps, schema)


def _order_sql() -> str:
    letters = " JOIN ".join(f"letters l{i} ON {' AND '.join(f'l{i}.f <> l{j}.f' for j in range(i)) or 'true'}" for i in range(1, 5))
    return f"SELECT {' || '.join(f'l{i}.f' for i in range(5))} AS filter_order FROM letters l0 JOIN {letters}"


AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT d.doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS ({_order_sql()}),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM steps),
x AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS alone,
    length(translate(fails, before, '')) < length(fails) AS gone FROM g CROSS JOIN s),
r AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost
    FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
