"""Operator 11, centroid clustering: Walsh-Hadamard progressive search for the nearest centroid.

Vectors become integers and go through the exact integer Walsh-Hadamard transform, as centroids do;
it keeps squared distances but for the factor 64. Coefficients are ordered by their sign
changes, coarse to fine. The squared differences are summed up level by level. After each level the centroid that leads
is measured in full, and centroids whose sum so far is larger than the least full distance
are left out: they are strictly worse, so ties stay. What is left is finished to all 64.

The transform is linear: tasks add up coefficients per centroid, and the inverse transform of those
sums gives the exact sums of the components. A task sends one row per centroid and limb, whatever its
number of vectors; the driver holds the centroids only.

Integers are 64 bits wide while no component exceeds ``SMALL``; a block of vectors beyond that is
worked on with Python's integers. Sums travel in limbs of 24 bits, so that they are exact at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.session import discard, materialise_at, scratch_path

WIDTH = 64
CENTROIDS, ROUNDS, SEED = 40, 5, 2
SCALE = 256
#: Below this size of a component, 64 squared differences of coefficients fit 64 bits.
SMALL = 2**20
LIMB_BITS = 24
#: Vectors compared at once: bounds the memory of a task.
BLOCK = 4096
#: Ends of the levels of coefficients.
LEVELS = [8, 16, 32, WIDTH]
MOST = 2**63 - 1


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The integer transform of each row, natural order; applied twice it is ``WIDTH`` times the row."""
    out = rows.copy()
    half = 1
    while half < WIDTH:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), WIDTH)
        half *= 2
    return out


def _coarse_first() -> np.ndarray:
    """Positions of the transform by number of sign changes."""
    waves = hadamard(np.eye(WIDTH, dtype=np.int64))
    return np.argsort((waves[:, 1:] != waves[:, :-1]).sum(axis=1), kind="stable")


ORDER = _coarse_first()


def coefficients(rows: np.ndarray) -> np.ndarray:
    return hadamard(rows)[:, ORDER]


def components(coefs: np.ndarray) -> np.ndarray:
    natural = np.empty_like(coefs)
    natural[:, ORDER] = coefs
    return hadamard(natural) // WIDTH


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row of coefficients, ties to the smaller number, and its distance."""
    n, k = len(vectors), len(centroids)
    first = LEVELS[0]
    sums = np.zeros((n, k), dtype=vectors.dtype)
    for j in range(first):
        d = vectors[:, j, None] - centroids[None, :, j]
        sums += d * d
    leader = sums.argmin(axis=1)
    bound = _differences(vectors, centroids[leader])
    row, number = np.nonzero(sums <= bound[:, None])
    sums = sums[row, number]
    for start, end in zip(LEVELS, LEVELS[1:]):
        sums = sums + _differences(vectors[row, start:end], centroids[number, start:end])
        if end < WIDTH:
            leads = number[_least(row, sums)]
            bound = np.minimum(bound, _differences(vectors, centroids[leads]))
            stay = np.asarray(sums <= bound[row], dtype=bool)
            row, number, sums = row[stay], number[stay], sums[stay]
    at = _least(row, sums)
    return number[at], sums[at] // WIDTH


def _least(row: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Position of the first least sum of each row; ``row`` rises and leaves no row out."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(sums, starts)
    at = np.flatnonzero(np.asarray(sums == least[row], dtype=bool))
    return at[np.flatnonzero(np.r_[True, row[at][1:] != row[at][:-1]])]


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """Integer vectors of a batch with the row they start at, 64 bits wide where they fit."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, WIDTH)
    for start in range(0, len(rows), BLOCK):
        part = rows[start : start + BLOCK]
        if np.abs(part).max() < SMALL:
            yield start, part.astype(np.int64)
        else:
            yield start, np.array([[int(x) for x in r] for r in part], dtype=object)


class _Search:
    """Nearest centroids by 64-bit numbers where both sides allow it."""

    def __init__(self, centroids: list[list[int]]):
        self.big = coefficients(np.array(centroids, dtype=object))
        small = max((abs(x) for c in centroids for x in c), default=0) < SMALL
        self.small = self.big.astype(np.int64) if small else None

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.small is None:
            vectors = vectors.astype(object)
        coefs = coefficients(vectors)
        return coefs, *nearest(coefs, self.big if coefs.dtype == object else self.small)


def _limbs(value: int) -> list[int]:
    """``value`` in base 2**24; the last digit carries the sign."""
    out = []
    while not -(2 ** (LIMB_BITS - 1)) <= value < 2 ** (LIMB_BITS - 1):
        out.append(value & (2**LIMB_BITS - 1))
        value >>= LIMB_BITS
    return [*out, value]


def _sums(stored: DataFrame, centroids: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Vectors of each centroid: how many, and the exact sums of their components."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(centroids)
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, WIDTH), dtype=object)
        for batch in batches:
            for _, vectors in _blocks(batch, 0):
                coefs, number, _ = search(vectors)
                order = np.argsort(number, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0])
                found = number[order][starts]
                total[found] += np.add.reduceat(coefs[order], starts, axis=0).astype(object)
                count += np.bincount(number, minlength=k)
        rows = []
        for c in np.flatnonzero(count):
            digits = [_limbs(int(x)) for x in total[c]]
            for limb in range(max(map(len, digits))):
                rows.append((int(c), limb, int(count[c]) * (limb == 0), [d[limb] if limb < len(d) else 0 for d in digits]))
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(v), t) for v, t in zip(columns, [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())])],
            ["cluster", "limb", "n", "digits"],
        )

    parts = stored.select("v").mapInArrow(run, "cluster int, limb int, n bigint, digits array<bigint>")
    added = parts.groupBy("cluster", "limb").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("digits", F.lit(i))).alias(f"c{i}") for i in range(WIDTH)]
    )
    counts, sums = [0] * k, np.zeros((k, WIDTH), dtype=object)
    for r in added.collect():  # at most one row per centroid and limb
        counts[r.cluster] += r.n
        sums[r.cluster] += np.array([r[f"c{i}"] << (LIMB_BITS * r.limb) for i in range(WIDTH)], dtype=object)
    return counts, components(sums).tolist()


def _nearest_rows(stored: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` of every vector."""
    vec_id = stored.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(centroids)
        for batch in batches:
            for start, vectors in _blocks(batch, 1):
                _, number, distance = search(vectors)
                if distance.dtype == object:
                    distance = np.array([min(int(d), MOST) for d in distance], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(vectors)), pa.array(number.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )

    return stored.select("vec_id", "v").mapInArrow(run, f"vec_id {vec_id}, cluster int, distance bigint")


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``v``: the integers floor(256 x), as doubles, of vectors with 64 finite components."""
    numbers = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE)
    finite = F.forall(numbers, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = embeddings.select("vec_id", numbers.alias("v")).where(F.size("embedding") == WIDTH).where(finite)
    # floor() makes 64-bit numbers; x - pmod(x, 1) is exact for doubles of any size
    return rows.select("vec_id", F.transform("v", lambda x: x - F.pmod(x, F.lit(1.0))).alias("v"))


def _seed_hash() -> Column:
    return F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def cluster_vectors(embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of each kept vector.

    Kept are vectors of 64 components, none null, NaN or infinite (nor infinite times 256 as a double);
    a null vector is left out. Component x becomes the integer floor(256 x). Centroids start as the kept
    vectors with the smallest SHA-256 of ``2:<vec_id>`` (a null ``vec_id`` as empty text), repeated ids
    by their components; of fewer vectors there are fewer centroids, of which equal ones lose to the smaller number.
    A round assigns each vector to the nearest centroid, ties to the smaller number, and moves
    centroids that have vectors to the floors of their means. Vectors are then assigned once
    more. Repeated rows count and give a row each. Distances and inertias past the largest long are
    given as that. An empty table gives no rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    at = scratch_path(spark, "integer-vectors")
    stored = materialise_at(integer_vectors(embeddings), at)
    start = stored.orderBy(_seed_hash(), "v").limit(centroids).collect()
    now = [[int(x) for x in r.v] for r in start]
    for _ in range(rounds if now else 0):
        counts, sums = _sums(stored, now)
        now = [[s // n for s in total] if n else old for n, total, old in zip(counts, sums, now)]
    if not now:
        empty = "CAST(NULL AS INT) AS cluster, 0L AS distance, 0L AS cluster_inertia, 0L AS inertia, '' AS centroid_sha256"
        return stored.selectExpr("vec_id", *empty.split(", "))
    found = materialise_at(_nearest_rows(stored, now), scratch_path(spark, "nearest-centroids"))
    discard(spark, at)
    sums = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]

    def of_cluster(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))

    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([min(int(sums.get(c, 0)), MOST) for c in range(len(now))]).cast("bigint").alias("cluster_inertia"),
        F.lit(min(int(sum(sums.values())), MOST)).cast("bigint").alias("inertia"),
        of_cluster(names).alias("centroid_sha256"),
    )


def _rounds_sql() -> str:
    """One table of centroids and one of assignments per round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"""d{r} AS (SELECT v.k, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{r} c USING (i) GROUP BY 1, 2),
a{r} AS (SELECT k, min(cluster) AS cluster, any_value(distance) AS distance FROM
    (SELECT *, min(distance) OVER (PARTITION BY k) AS least FROM d{r}) WHERE distance = least GROUP BY k)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""m{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (k) GROUP BY 1, 2),
c{r + 1} AS (SELECT c.cluster, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x
    FROM c{r} c LEFT JOIN m{r} m USING (cluster, i))"""
            )
    return ",\n".join(steps)


CENTROID_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS xs
    FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
v AS MATERIALIZED (SELECT k, unnest(range({WIDTH})) AS i, unnest(xs) AS x FROM e),
s AS (SELECT k, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), xs) - 1 AS cluster FROM e QUALIFY cluster < {CENTROIDS}),
c0 AS (SELECT cluster, i, x FROM s JOIN v USING (k)),
{_rounds_sql().replace(" AS (SELECT", " AS MATERIALIZED (SELECT")},
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY 1)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (k) JOIN h USING (cluster)
"""
