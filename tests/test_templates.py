"""The parallel miner against a plain statement of the sequential rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rootscope.functions import scalars as S
from rootscope.operators import templates as T


def leader_rule(lists, th):
    opened, out = [], []
    for tokens in lists:
        best, best_sim = None, 0.0
        for i, t in enumerate(opened):
            if tokens and len(t) == len(tokens):
                sim = sum(a == b for a, b in zip(t, tokens)) / len(tokens)
                if sim > best_sim and sim >= th:
                    best, best_sim = i, sim
        if best is None:
            opened.append(tokens)
            best = len(opened) - 1
        out.append(best)
    return opened, out


def random_lists(seed, n, words=6, longest=6):
    r = random.Random(seed)
    return [[r.choice("abcdefgh"[:words]) for _ in range(r.randint(0, longest))] for _ in range(n)]


def frame(spark, lists, parts=3):
    rows = [(i * 3 + 1, " ".join(x)) for i, x in enumerate(lists)]
    return spark.createDataFrame(rows, "pos bigint, text string").repartition(parts)


@pytest.mark.parametrize("th,batch,parts", [(0.4, 1000, 3), (0.4, 3, 1), (0.7, 5, 17), (0.0, 4, 4), (1.0, 1000, 2)])
def test_matches_sequential_rule(spark, th, batch, parts):
    lists = random_lists(int(th * 10) + batch, 120)
    opened, ids = leader_rule(lists, th)
    rows = frame(spark, lists, parts)
    mined = T.mine_templates(rows, th, batch=batch)
    got = sorted((r.template_id, r.text) for r in mined.collect())
    assert got == [(i, " ".join(t)) for i, t in enumerate(opened)]
    assigned = T.assign_templates(rows, mined, th).orderBy("pos").collect()
    assert [r.template_id for r in assigned] == ids


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_index_sent_or_dealt_out(spark, broadcast):
    lists = random_lists(7, 80)
    opened, ids = leader_rule(lists, 0.4)
    rows = frame(spark, lists)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        mined = T.mine_templates(rows, 0.4, batch=4)
        assert sorted((r.template_id, r.text) for r in mined.collect()) == [(i, " ".join(t)) for i, t in enumerate(opened)]
        assigned = T.assign_templates(rows, mined, 0.4).orderBy("pos").collect()
        assert [r.template_id for r in assigned] == ids
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_double(spark, monkeypatch):
    rounds = []
    first = T.first_undecided
    monkeypatch.setattr(T, "first_undecided", lambda u, d, batch: rounds.append(batch) or first(u, d, batch))
    lists = [[f"a{i}", f"b{i}", f"c{i}"] for i in range(900)]
    assert T.mine_templates(frame(spark, lists), batch=10).count() == 900
    assert len(rounds) <= 10 and rounds[:4] == [10, 20, 40, 80]


def common_words(seed, n, longest=24):
    """Messages of frequent words that hardly ever match, and some that do."""
    r = random.Random(seed)
    lists = [[f"w{int(40 * r.random() ** 2)}" for _ in range(r.choice([3, 8, longest]))] for _ in range(n)]
    for _ in range(n // 5):
        copy = list(r.choice(lists))
        for at in r.sample(range(len(copy)), len(copy) // 2):
            copy[at] = "x"
        lists.insert(r.randrange(len(lists)), copy)
    return lists


@pytest.mark.parametrize("th", [0.05, 0.4, 0.8, 1.0])
@pytest.mark.parametrize("n", [1, 2, 5, 8, 17, 40])
def test_texts_that_match_agree_in_a_set_of_positions(n, th):
    r = random.Random(n)
    k = T.enough(n, th)
    assert k / n >= th and (k == 1 or (k - 1) / n < th)
    sets = [set(row) for part in T.position_sets(n, k) for row in part.tolist()]
    assert len(sets) <= 6 * n
    for _ in range(300):
        equal = set(r.sample(range(n), k))
        assert any(s <= equal for s in sets)


def test_frequent_words_bring_few_together(spark):
    messages = T.named(T.distinct_messages(frame(spark, common_words(1, 800))))
    long = messages.where("n = 24")
    templates = long.withColumnRenamed("mid", "template_id")
    met = T.met_pairs(long, templates, 0.4).count()
    # one frequent word in common brought nearly all pairs together
    assert long.count() <= met < long.count() ** 2 / 10


def test_steps_of_a_task(monkeypatch):
    monkeypatch.setattr(T, "_STEP", 5)
    monkeypatch.setattr(T, "_LARGEST_STEP", 60)
    monkeypatch.setattr(T, "_NUMBERS", 700)
    for n in (3, 8, 24):
        lists = [x for x in common_words(n, 300) if len(x) == n]
        codes = T.token_codes([" ".join(x) for x in lists], n)
        for th in (0.2, 0.4, 1.0, 1.5):
            opened, _ = leader_rule(lists, th)
            assert [lists[i] for i in T.leader_rows(codes, th)] == opened


def test_one_round_for_as_many_as_a_task_holds(spark, monkeypatch):
    rounds = []
    first = T.first_undecided
    monkeypatch.setattr(T, "first_undecided", lambda u, d, batch: rounds.append(batch) or first(u, d, batch))
    lists = common_words(2, 3000, 9)
    opened, _ = leader_rule([list(x) for x in lists], 0.4)
    got = T.mine_templates(frame(spark, lists)).orderBy("template_id").collect()
    assert [r.text for r in got] == [" ".join(t) for t in opened] and len(rounds) == 1
    monkeypatch.setattr(T, "LARGEST_TOKENS", 900)
    got = T.mine_templates(frame(spark, lists)).orderBy("template_id").collect()
    assert [r.text for r in got] == [" ".join(t) for t in opened] and len(rounds) > 3


def test_equal_positions(spark):
    rows = spark.createDataFrame([(i // 4, f"{'abcd'[i % 4]} q y{i}") for i in range(40)], "pos bigint, text string")
    mined = T.mine_templates(rows, batch=3)
    ids = {r.text: r.template_id for r in mined.collect()}
    assert len(ids) == 4 and {r.text for r in mined.where("pos = 0").collect()} == set(ids)
    got = T.assign_templates(rows, mined, assign="final").collect()
    assert {r.template_id for r in got} == set(ids.values())


def test_rounds_over_positions_far_apart(spark):
    lists = random_lists(5, 60)
    opened, _ = leader_rule(lists, 0.4)
    places = [i if i < 20 else 10**12 + i if i < 40 else 2 * 10**17 + i * 10**6 for i in range(60)]
    rows = spark.createDataFrame([(p, " ".join(x)) for p, x in zip(places, lists)], "pos bigint, text string")
    assert [r.text for r in T.mine_templates(rows, batch=2).orderBy("template_id").collect()] == [" ".join(t) for t in opened]


def test_repeat_moves_to_a_newer_template(spark):
    lists = ["a b c d e".split(), "a b x y z".split(), "a q x y w".split(), "a b x y z".split()]
    opened, ids = leader_rule(lists, 0.4)
    rows = frame(spark, lists)
    mined = T.mine_templates(rows, 0.4)
    assert [r.template_id for r in T.assign_templates(rows, mined, 0.4).orderBy("pos").collect()] == ids
    final = T.assign_templates(rows, mined, 0.4, assign="final").orderBy("pos").collect()
    assert final[1].template_id == final[3].template_id


def test_final_assignment_is_the_best_of_all(spark):
    lists = random_lists(11, 100)
    rows = frame(spark, lists)
    mined = T.mine_templates(rows, 0.4)
    opened = [r.text.split(" ") if r.text else [] for r in mined.orderBy("template_id").collect()]
    got = [r.template_id for r in T.assign_templates(rows, mined, assign="final").orderBy("pos").collect()]
    for tokens, tid in zip(lists, got):
        if tokens:
            shares = [sum(a == b for a, b in zip(t, tokens)) if len(t) == len(tokens) else 0 for t in opened]
            assert tid == shares.index(max(shares))


def test_merged_empty_messages(spark):
    rows = frame(spark, [[], ["a"], [], []])
    mined = T.mine_templates(rows, empty="merge")
    assert mined.count() == 2
    ids = [r.template_id for r in T.assign_templates(rows, mined).orderBy("pos").collect()]
    assert ids == [0, 1, 0, 0]


def test_masking_order(spark):
    lines = [
        "at 2024-01-02 03:04:05 from 10.0.0.1 id 42",
        "u abcdefab-abcd-abcd-abcd-abcdefabcdef v 12345678-abcd-abcd-abcd-abcdefabcdef",
        "٣٤ x y",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "message string")
    got = [r.text for r in T.with_text(df).select("text").collect()]
    assert got == [
        "at <TIMESTAMP> from <IP> id <NUM>",
        "u <UUID> v <NUM>-abcd-abcd-abcd-abcdefabcdef",
        "<NUM> x y",
    ]


def test_rules_that_are_skipped_change_nothing(spark, monkeypatch):
    r = random.Random(9)
    parts = ["2024-01-02 03:04:05", "10.0.0.1", "1.2.3", "7", "-", ":", ".", "a", " ", "abcdefab-abcd-abcd-abcd-abcdefabcdef", "\u0664\u0663", "\n", "x-y"]
    lines = ["".join(r.choice(parts) for _ in range(r.randrange(7))) for _ in range(400)]
    want = []
    for text in lines:
        for pattern, name in S.MASK_RULES:
            text = re.sub(pattern.replace(r"\p{Nd}", r"\d"), name, text)
        want.append(text)
    df = spark.createDataFrame(list(enumerate(lines)), "i int, message string")
    rows = df.select("i", S.mask_message("message").alias("masked"))
    assert [x.masked for x in rows.orderBy("i").collect()] == want
    # time stamps and addresses are looked for only where their marks are
    assert "contains" in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_scopes_never_meet(spark):
    a, b = random_lists(3, 60), random_lists(4, 60)
    rows = frame(spark, a).withColumn("scope", F.lit("a")).unionByName(frame(spark, b).withColumn("scope", F.lit("b")))
    mined = T.mine_templates(rows)
    ids = T.assign_templates(rows, mined)
    for name, lists in (("a", a), ("b", b)):
        opened, want = leader_rule(lists, 0.4)
        got = sorted((r.template_id, r.text) for r in mined.where(F.col("scope") == name).collect())
        assert got == [(i, " ".join(t)) for i, t in enumerate(opened)]
        assert [r.template_id for r in ids.where(F.col("scope") == name).orderBy("pos").collect()] == want


@pytest.mark.parametrize("empty", ["own", "merge"])
def test_a_dictionary_is_continued(spark, empty):
    lists = random_lists(21, 150)
    rows = frame(spark, lists)
    whole = T.mine_templates(rows, empty=empty)
    known, ids = None, {}
    for first, last in ((0, 150), (150, 300), (300, 500)):
        day = rows.where((F.col("pos") >= first) & (F.col("pos") < last))
        known = T.mine_templates(day, empty=empty, batch=7, known=known)
        ids |= {r.pos: r.template_id for r in T.assign_templates(day, known).collect()}
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, whole.collect()))
    assert ids == {r.pos: r.template_id for r in T.assign_templates(rows, whole).collect()}


def test_days_that_count_from_zero(spark):
    first, second = frame(spark, [["a", "b"], ["c", "d"]]), frame(spark, [["c", "d"], ["e", "f"], ["a", "b"]])
    known = T.mine_templates(first)
    day = T.positions_after(second, known)
    more = T.mine_templates(day, known=known)
    assert [r.text for r in more.orderBy("template_id").collect()] == ["a b", "c d", "e f"]
    assert [r.template_id for r in T.assign_templates(day, more).orderBy("pos").collect()] == [1, 2, 0]
