from odd import ODD_TEXTS

from rootscope.llm.exact import FIRST_DIGIT, GROWTH, drop_exact_duplicates, exact_duplicates


def brute(rows):
    import hashlib
    import re

    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    return sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


def test_against_brute_force(docs):
    edges = [FIRST_DIGIT, FIRST_DIGIT * GROWTH + FIRST_DIGIT, 700]
    texts = [*ODD_TEXTS, " a  b ", " a\tb\n", "\xa0a"]
    for n in edges:
        texts += ["x" * k for k in (n - 1, n, n + 1)] * 2 + ["x" * n + "\0", "y" * n + "é", "y" * n + "è"]
    rows = list(enumerate(texts))
    assert sorted(map(tuple, exact_duplicates(docs(rows)).collect())) == brute(rows)


def test_a_third_of_all_rows_in_one_group(docs):
    rows = [(i, "hot text " * 50 if i % 3 else f"text {i}") for i in range(600)]
    assert sorted(map(tuple, exact_duplicates(docs(rows)).collect())) == brute(rows)


def test_unknown_and_repeated_ids(docs):
    got = exact_duplicates(docs([(None, "a"), (7, "a"), (7, "a"), (None, "b")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == [
        ("7", "7", 3), ("7", "7", 3), ("None", "7", 3), ("None", "None", 1),
    ]
    assert sum(r.kept for r in got) == 2
    assert exact_duplicates(docs([])).count() == 0


def test_stage_keeps_columns_and_one_row_of_each_group(docs):
    rows = docs(["a", "b", "a", None, ""]).withColumnRenamed("lang", "uid").withColumnRenamed("source", "_row")
    kept = drop_exact_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3]
