import random

from odd import ODD_TEXTS

from rootscope.llm.linededup import remove_repeated_lines


def brute(rows):
    seen, out = set(), []
    for i, text in sorted(rows):
        lines, gone = (text or "").split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        left = [x for k, x in enumerate(lines) if k not in gone]
        out.append((i, "\n".join(left), len(lines) if text else 0, len(gone)))
    return out


def test_against_brute_force(docs):
    rng = random.Random(2)
    texts = [*ODD_TEXTS, "a\na\na\na\na", "p\nq\nr\ns\nt", "x\np\nq\nr\ns\nt\ny", "\n\n\n\n"]
    for _ in range(80):
        texts.append("\n".join(rng.choices("abcd", k=rng.randrange(9))))
    rows = list(enumerate(texts))
    assert sorted(map(tuple, remove_repeated_lines(docs(rows)).collect())) == brute(rows)


def test_a_window_that_most_documents_share(docs):
    rows = [(i, f"{i}\nhead\nof\nall\n{i}") for i in range(300)]
    assert sorted(map(tuple, remove_repeated_lines(docs(rows)).collect())) == brute(rows)


def test_none_unknown_ids_and_other_columns(docs):
    assert remove_repeated_lines(docs([])).count() == 0
    rows = docs([(None, "a\nb\nc"), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd")])
    rows = rows.withColumnRenamed("lang", "start").withColumnRenamed("source", "lines")
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in remove_repeated_lines(rows).collect())
    assert got == [("1", "d", 3), ("1", "d", 3), ("None", "a\nb\nc", 0)]
