"""Near duplicates against brute force over all pairs."""

import random

import pytest
from odd import ODD_TEXTS

from rootscope.llm import neardup
from rootscope.llm.neardup import FINE, bands_for, connected, drop_near_duplicates, near_duplicates, shingles, signature


def brute(rows, percent=75):
    """component and set size by (doc_id): all pairs of sets."""
    sets = []
    for i, text in rows:
        words = [w for w in (text or "").encode().lower().split() if w]
        runs = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets.append((i, runs))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def check(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(rows)).collect()}
    want = brute(rows)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_chains_and_copies(docs, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(500)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 12, 60, 300]))]
        chain = base
        for _ in range(rng.randrange(1, 9)):
            chain = edited(rng, chain, max(1, len(chain) // 40))
            rows.append(" ".join(chain))
            rows.append(" ".join(edited(rng, base, max(1, len(base) // 60))).upper())
        rows += ["  ".join(base)] * 3
    rng.shuffle(rows)
    check(docs, list(enumerate(rows)))


def test_star_around_a_missing_centre(docs):
    # each copy is close to the base, no two copies are close to each other
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    copies = []
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(2, 118), 3):
            words[at] = f"c{rng.randrange(10**9)}"
        copies.append(" ".join(words))
    check(docs, list(enumerate([*copies, " ".join(base)])))
    check(docs, list(enumerate(copies)))


@pytest.mark.parametrize("with_base", [True, False])
def test_hot_group_of_near_copies(docs, with_base, monkeypatch):
    # from almost equal to far from the base; some share edits with others, so links run between members only
    met = []
    confirm = neardup._links
    monkeypatch.setattr(neardup, "_links", lambda pairs, sets, percent: met.append(pairs.count()) or confirm(pairs, sets, percent))
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = [" ".join(base)] * with_base
    families = [edited(rng, base, rng.randrange(5, 14)) for _ in range(25)]
    for k in range(500):
        rows.append(" ".join(edited(rng, rng.choice(families) if k % 3 == 0 else base, rng.randrange(0, 12))))
    check(docs, list(enumerate(rows)))
    # stars, then far fewer than all pairs
    assert len(met) == 2 and met[1] < 12_000


def test_a_difference_is_placed_once(docs, monkeypatch):
    # not once for each class of slack that may ask for it
    rows = {}
    store = neardup.materialise

    def counted(df, label):
        stored = store(df, label)
        if label in ("rare", "placed"):
            rows[label] = sum(len(r.rare) for r in stored.select("rare").collect()) if label == "rare" else stored.count()
        return stored

    monkeypatch.setattr(neardup, "materialise", counted)
    rng = random.Random(13)
    base = [f"b{i}" for i in range(150)]
    families = [edited(rng, base, rng.randrange(5, 14)) for _ in range(10)]
    texts = [" ".join(edited(rng, rng.choice(families), rng.randrange(0, 12))) for _ in range(120)]
    check(docs, list(enumerate(texts)))
    assert 0 < rows["placed"] <= rows["rare"]


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_other_percentages_in_a_hot_group(docs, percent):
    rng = random.Random(percent)
    base = [f"b{i}" for i in range(100)]
    rows = list(enumerate(" ".join(edited(rng, base, rng.randrange(0, 10))) for _ in range(200)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), percent=percent).collect()}
    assert got == brute(rows, percent)


def test_fewer_percent(docs):
    # copies of one base, and chains whose links are just over the limit
    rng = random.Random(5)
    rows = []
    for g in range(12):
        text = [f"g{g}w{i}" for i in range(200)]
        rows.append(" ".join(text))
        for _ in range(5):
            at = rng.randrange(5)
            for k in range(at, 200, 10):
                text[k] = f"n{rng.randrange(10**9)}"
            rows.append(" ".join(text))
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), percent=30).collect()}
    want = brute(rows, 30)
    assert got == want
    assert len({c for _, c in want.values()}) == 12 and len({c for _, c in brute(rows, 75).values()}) > 60


def test_numbers_follow_the_percentage():
    assert bands_for(FINE, 75) == bands_for(FINE, 90) == FINE
    for percent in (1, 10, 30, 50, 74):
        bands, rows = bands_for(FINE, percent)
        assert (1 - (percent / 100) ** rows) ** bands < 1e-6


@pytest.mark.parametrize("percent", [0, 101])
def test_percent_out_of_range(docs, percent):
    with pytest.raises(ValueError):
        near_duplicates(docs([(1, "a")]), percent=percent)


def test_odd_rows(docs):
    check(docs, [(i, t) for i, t in enumerate(ODD_TEXTS)])


def test_unknown_ids_repeated_rows_and_none(docs):
    text = "one two three four five six seven"
    got = near_duplicates(docs([(None, text), (4, text), (4, text), (None, "alone")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert sorted(r.kept for r in got) == [False, False, True, True]
    assert near_duplicates(docs([])).count() == 0


def test_stage_keeps_all_columns(docs):
    rows = docs(["a b c d e f", "a b c d e f", "g"]).withColumnRenamed("lang", "_row").withColumnRenamed("source", "node")
    kept = drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_signatures_agree_as_sets_do():
    rng = random.Random(5)
    hits = total = 0
    for _ in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        a, b = shingles(" ".join(words)), shingles(" ".join(words[:36] + ["x", "y"]))
        same = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        hits += (signature(a, 128) == signature(b, 128)).mean() - same
        total += 1
    assert abs(hits / total) < 0.02


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101)]
    found = connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(1, 61)} | {(101, 100), (102, 100)}
