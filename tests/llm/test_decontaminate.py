import hashlib
import random
import re

from odd import ODD_TEXTS

from rootscope.llm.exact import drop_exact_duplicates
from rootscope.llm.neardup import drop_near_duplicates
from rootscope.llm.quality import drop_low_quality
from rootscope.llm.decontaminate import contamination, drop_contaminated


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, ids = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    hit |= set(range(k, k + size))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def run(spark, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(map(tuple, contamination(docs(rows), bench).collect()))


def test_against_brute_force(spark, docs):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices("abcdefgh", k=rng.choice([3, 4, 9, 10, 11, 14, 30])))) for i in range(25)]
    items += [(99, None), (98, ", !"), (5, items[5][1]), (77, items[20][1])]
    texts = list(ODD_TEXTS)
    for _ in range(60):
        body = rng.choices("abcdefghijklm", k=rng.randrange(40))
        item = rng.choice(items[:25])[1].split()
        a = rng.randrange(len(item))
        texts.append(", ".join(body[:7] + [w.upper() for w in item[a : a + rng.randrange(6, 40)]] + body[7:]))
    rows = list(enumerate(texts))
    assert run(spark, docs, rows, items) == brute(rows, items)


def test_long_items_only_and_periodic_words(spark, docs):
    items = [(1, "a " * 12), (2, "a b " * 8), (3, " ".join(f"w{i}" for i in range(40)))]
    rows = list(enumerate(["a " * 9, "a " * 10, "b " + "a " * 300, "a b " * 40, " ".join(f"w{i}" for i in range(12, 29)), "w1 w2"]))
    assert run(spark, docs, rows, items) == brute(rows, items)


def test_empty_tables(spark, docs):
    assert run(spark, docs, [], [(1, "a b c")]) == []
    rows = [(1, "a b c"), (2, None)]
    assert run(spark, docs, rows, []) == brute(rows, [])


def test_unknown_ids_and_stage(spark, docs):
    bench = spark.createDataFrame([(None, "one two three four")], "item_id bigint, text string")
    rows = docs([(None, "zero one two three four"), (3, "clean text"), (3, "clean text"), (4, "ONE two, three four!")])
    rows = rows.withColumnRenamed("lang", "text_key").withColumnRenamed("source", "id_key").withColumnRenamed("n_chars", "_ID_key")
    rows = rows.withColumn("_text_key", rows["doc_id"])
    assert sorted(r.n_items for r in contamination(rows, bench).collect()) == [0, 0, 1, 1]
    kept = drop_contaminated(rows, bench)
    assert kept.columns == rows.columns
    assert [r.doc_id for r in kept.collect()] == [3, 3]


def test_stages_on_empty_tables(spark, docs, labels):
    none, some = docs([]), docs([(1, "a b c"), (None, None)])
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert drop_contaminated(none, bench).count() == drop_exact_duplicates(none).count() == 0
    assert drop_near_duplicates(none).count() == drop_low_quality(none, labels([])).count() == 0
    assert drop_contaminated(some, bench.limit(0)).count() == drop_exact_duplicates(some).count() == drop_near_duplicates(some).count() == 2
    assert drop_low_quality(some, labels([])).columns == some.columns
