"""Held-out accuracy on the test tables, and the parts on small fixtures."""

import pytest
from compare import data_dir
from odd import ODD_TEXTS
from pyspark.sql import functions as F

from rootscope.llm.quality import NAMES, compiled, drop_low_quality, score_quality, tree_rules, with_statistics
from rootscope.llm.queries import QUERIES
from rootscope.llm.toxicity import WordModel, counterfactual, features, score_toxicity, words_of

SIZE = "sf0.01"


@pytest.mark.parametrize(("key", "label", "least"), [("op3_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.9)])
def test_accuracy_on_rows_held_out(spark, key, label, least):
    d = data_dir(SIZE)
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = QUERIES[key](spark, d)
    assert rows.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    seen = rows.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.y for r in seen) / len(seen) >= least
    assert all(0 <= r.score <= 1 for r in seen)


def test_rules_are_read_from_a_printed_tree():
    shown = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 1 <= 0.5)
   If (feature 1 <= 0.25)
    Predict: 0.0
   Else (feature 1 > 0.25)
    Predict: 1.0
  Else (feature 1 > 0.5)
   Predict: 1.0
"""
    name = NAMES[1]
    assert tree_rules(shown) == [
        ((name, "<=", 0.5),), ((name, "<=", 0.25),), ((name, "<=", 0.5), (name, ">", 0.25)), ((name, ">", 0.5),),
    ]


def test_statistics_of_odd_texts_are_numbers(docs):
    rows = with_statistics(docs(ODD_TEXTS), ["doc_id"]).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert all(r[n] is not None and r[n] == r[n] for r in rows for n in NAMES)


def test_rule_columns(docs):
    rows = with_statistics(docs(["short", "a much longer text"]), ["doc_id"])
    rule = (("length", ">", 2.0), ("word_length", "<=", 100.0))
    assert {r.doc_id: r[1] for r in rows.select("doc_id", compiled(rule)).collect()} == {0: 0.0, 1: 1.0}


def test_one_label_no_label_and_odd_rows(docs, labels):
    rows = docs([*enumerate(ODD_TEXTS), (None, "x"), (1, "again")]).withColumnRenamed("lang", "score").withColumnRenamed("source", "label")
    for known in ([], [(i, 1, 1) for i in range(9)], [(1, None, None), (None, 1, 0), (2, 5, 7)]):
        for score in (score_quality, score_toxicity):
            got = score(rows, labels(known)).collect()
            assert len(got) == len(ODD_TEXTS) + 2
            assert len({r.score for r in got}) == 1 and all(r.predicted in (0, 1) for r in got)
    assert score_quality(docs([]), labels([])).count() == 0
    assert score_toxicity(docs([]), labels([])).count() == 0


def test_stage_drops_what_is_rejected_and_keeps_columns(docs, labels):
    texts = ["good words in a row, as they should be." if i % 2 else "###$$$ %%% &&& ***" for i in range(80)]
    rows = docs(texts).withColumnRenamed("lang", "n").withColumnRenamed("source", "bars")
    kept = drop_low_quality(rows, labels([(i, i % 2, 0) for i in range(80)]))
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1, 80, 2))


def test_counterfactual_penalty_frees_group_names():
    # a group's name stands in most toxic texts; another's only in neutral ones
    toxic = ["the women idiot here"] * 30 + ["the women moron"] * 30
    neutral = ["the men walk here"] * 60 + ["the women walk"] * 4
    labels = [1] * 60 + [0] * 64
    words = [words_of(t) for t in toxic + neutral]
    x, other = [features(w) for w in words], [features(counterfactual(w)) for w in words]
    plain, fair = WordModel.fit(x, other, labels, strength=0.0), WordModel.fit(x, other, labels, strength=50.0)
    gap = lambda m: abs(m.score("the women sing") - m.score("the men sing"))
    assert gap(fair) < 0.2 * gap(plain)
    assert fair.score("the men idiot") > 0.5 > fair.score("the women walk")


def test_scores_do_not_depend_on_what_was_scored_before():
    model = WordModel(-1.0, {"bad": 3.0, "stems~": 1.0, "stems~2": 0.5, "stems~%": 0.25})
    first = model.score("stemsone stemstwo bad")
    model.score("x " * 100)
    assert model.score("stemsone stemstwo bad") == first
    assert round(-__import__("math").log(1 / first - 1), 6) == 3.75
