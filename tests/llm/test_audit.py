import re
from itertools import permutations

from odd import ODD_TEXTS

from rootscope.llm.audit import audit_filters


def brute(rows, labels):
    """``rows``: (doc_id, text, source)."""
    facts = []
    for i, t, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search(r"[#$%&*|]", t)), copy,
        ]
        said = [(q, x) for j, q, x in labels if j is not None and j == i]
        facts.append((source or "", dict(zip("ABCDE", fails)), any(q == 1 for q, _ in said), any(x == 1 for _, x in said)))
    out = []
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        found, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                early = sum(x[1][f] for x in mine) - len(gone)
                left = [x for x in left if not x[1][f]]
                only = sum(x[1][f] and sum(x[1].values()) == 1 for x in mine)
                total[f] += len(gone)
                lost = [sum(x[k] for x in gone) for k in (2, 3)]
                found.append((part, "".join(order), step, len(left), len(gone), early, only, *lost, f))
        out += [(*r[:-1], total[r[-1]]) for r in found]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, rows, parts=4):
    schema = "doc_id bigint, text string, source string, n int, fails int, digest string"
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema).repartition(parts)


LONG = " ".join(f"w{i}" for i in range(250))


def _rows():
    texts = [*ODD_TEXTS, LONG, LONG, LONG + " #", LONG + " #", "A" * 30 + " " + LONG, LONG.upper(), "a b\x0bc\x1cd\x85e\xa0f",
             "a " * 250, "a b " * 130, "É é " * 150, LONG + " x" * 300, LONG]
    return [(i, t, ("a", "b", None, "")[i % 4]) for i, t in enumerate(texts)]


def test_against_brute_force(spark, labels):
    rows = _rows()
    rows += [(None, LONG, "a"), (None, "", "a"), (None, None, "c"), (11, LONG, "a"), (11, LONG, "b"), (11, LONG, "b"), (11, "other", "b"), (40, "", "a")]
    marks = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 24, 2)] + [(3, None, 1), (3, 1, None), (3, 0, 0), (None, 1, 1), (11, 1, 1), (999, 1, 1)]
    assert got(audit_filters(frame(spark, rows), labels(marks))) == brute(rows, marks)


def test_a_third_of_all_rows_in_one_group(spark, labels):
    rows = [(i, LONG if i % 3 else f"{LONG} {i}", "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    assert got(audit_filters(frame(spark, rows, 9), labels([(5, 1, 0)]))) == brute(rows, [(5, 1, 0)])


def test_empty_tables(spark, labels):
    assert audit_filters(frame(spark, []), labels([(1, 1, 1)])).count() == 0
    rows = [(1, "a", "s")]
    assert got(audit_filters(frame(spark, rows), labels([]))) == brute(rows, [])
    assert len(brute(rows, [])) == 600
