import hashlib
import math
import random

import numpy as np
import pytest

from rootscope.llm import centroids as C

ROW = "vec_id bigint, embedding array<float>, label int"


def kept(rows):
    out = []
    for i, v in rows:
        if v is None or len(v) != 64 or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    return out


def brute(rows, k=C.CENTROIDS, rounds=C.ROUNDS):
    vectors = kept(rows)
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    now = [v for _, v in sorted(vectors, key=lambda r: (name(r[0]), r[1]))][:k]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now)) for _, v in vectors]

    for _ in range(rounds):
        found = assign()
        for n in range(len(now)):
            mine = [v for (_, v), (_, m) in zip(vectors, found) if m == n]
            if mine:
                now[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    most = 2**63 - 1
    inertia = lambda n=None: min(sum(min(d, most) for d, m in found if n in (None, m)), most)
    sha = lambda n: hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()
    out = [(i, n, min(d, most), inertia(n), inertia(), sha(n)) for (i, _), (d, n) in zip(vectors, found)]
    return sorted(out, key=repr)


def vectors(n, seed=1, spread=0.3):
    pick = random.Random(seed)
    middles = [[pick.uniform(-1, 1) for _ in range(64)] for _ in range(7)]
    return [(i, [m + pick.gauss(0, spread) for m in pick.choice(middles)]) for i in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], ROW).repartition(parts)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_transform_is_exact_and_its_own_inverse():
    rows = np.random.default_rng(1).integers(-1000, 1000, (50, 64))
    coefs = C.coefficients(rows)
    assert (C.components(coefs) == rows).all()
    assert ((coefs**2).sum(axis=1) == 64 * (rows**2).sum(axis=1)).all()


@pytest.mark.parametrize("dtype", [np.int64, object])
def test_progressive_search_equals_all_distances_with_ties(dtype):
    pick = np.random.default_rng(2)
    for scale in (1, 3, 500):
        v, c = pick.integers(-scale, scale + 1, (300, 64)), pick.integers(-scale, scale + 1, (30, 64))
        c[7] = c[3]
        v[:40] = c[3]
        v[50] = (c[1] + c[2]) // 2
        full = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        number, distance = C.nearest(C.coefficients(v.astype(dtype)), C.coefficients(c.astype(dtype)))
        assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_against_brute_force(spark):
    rows = vectors(500)
    assert got(C.cluster_vectors(frame(spark, rows))) == brute(rows)


def test_odd_vectors(spark):
    rows = vectors(90)
    one = rows[0][1]
    rows += [(100, None), (101, []), (102, one[:63]), (103, one + [0.0]), (104, [None, *one[1:]]), (105, [math.nan, *one[1:]]),
             (106, [math.inf, *one[1:]]), (107, [-math.inf] * 64), (None, one), (None, rows[1][1]), (5, rows[5][1]), (5, rows[6][1])]
    rows += [(200 + i, one) for i in range(60)]
    want = brute(rows)
    assert got(C.cluster_vectors(frame(spark, rows))) == want and len(want) == 154
    clash = frame(spark, rows).withColumnRenamed("label", "v")
    assert got(C.cluster_vectors(clash)) == want


def test_components_of_any_size(spark):
    rows = vectors(60) + [(100 + i, [3e38 * (-1) ** i, 1e30, 5e7, 1e5] + [0.25 * i] * 60) for i in range(8)]
    assert got(C.cluster_vectors(frame(spark, rows), centroids=5)) == brute(rows, 5)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(3) + [(7, vectors(1)[0][1])]
    assert got(C.cluster_vectors(frame(spark, rows))) == brute(rows)
    empty = C.cluster_vectors(frame(spark, [(1, None)]))
    assert empty.count() == 0 and empty.columns == C.cluster_vectors(frame(spark, rows)).columns


def test_sums_do_not_depend_on_partitions(spark):
    rows = vectors(200, 5)
    assert got(C.cluster_vectors(frame(spark, rows, 1))) == got(C.cluster_vectors(frame(spark, rows, 11)))
