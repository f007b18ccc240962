"""Rules, their corner cases and the documented choices."""

import math
import statistics
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rootscope.functions import scalars as S
from rootscope.functions import vectors as V
from rootscope.operators import align, cube, evaluate, graph, logs, metrics, scoring
from rootscope.operators.spread import block_chunk, grouped_quantiles, time_chunk, with_ordinal
from rootscope.operators.traces import parse_spans


def one(spark, column, **values):
    df = spark.createDataFrame([Row(**values)])
    return df.select(column.alias("x")).first().x


def ts(text):
    return datetime.fromisoformat(text)


# --- scalars


@pytest.mark.parametrize(
    "raw,want",
    [
        ("0", None),
        ("", None),
        ("NaN", None),
        ("x", None),
        ("1625133600", "2021-07-01T10:00:00"),
        ("1625133600000", "2021-07-01T10:00:00"),
        ("1625133600.25", "2021-07-01T10:00:00.250000"),
        ("1000000000000", "33658-09-27T01:46:40"),
        ("2021-07-01T10:00:00", "2021-07-01T10:00:00"),
    ],
)
def test_span_time(spark, raw, want):
    got = one(spark, S.ts_normalise("raw").cast("string"), raw=raw)
    assert (got or None) == (want and want.replace("T", " ").replace(".250000", ".25").replace("33658", "+33658"))


def test_span_time_zone(spark):
    assert one(spark, S.ts_normalise("raw", "Asia/Shanghai"), raw="1625133600") == ts("2021-07-01T18:00:00")


def test_log_lines(spark):
    lines = [
        "2024-01-02 03:04:05 up 2024-01-02 03:04:05 again",
        "x 2024/01/02 03:04:05 y",
        "01-02-2024 03:04:05 z",
        "Jan 15 10:30:45 sys",
        "2024-13-02 03:04:05 bad 2024/01/02 03:04:05 good",
        "no stamp",
        "   ",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r.line: (r.timestamp, r.message, r.ts_ok) for r in S.parse_log_lines(df).collect()}
    at = ts("2024-01-02T03:04:05")
    assert got == {
        lines[0]: (at, "up  again", True),
        lines[1]: (at, "x  y", True),
        lines[2]: (at, "z", True),
        lines[3]: (None, "sys", False),
        lines[4]: (at, "2024-13-02 03:04:05 bad  good", True),
        lines[5]: (None, "no stamp", False),
    }
    dated = S.parse_log_lines(df, year=2024).where("line LIKE 'Jan%'").first()
    assert (dated.timestamp, dated.ts_ok) == (ts("2024-01-15T10:30:45"), True)


def test_ip_flag_is_per_file(spark):
    rows = [("a", "| 10.0.0.1 | x", "f1"), ("a", "plain", "f1"), ("a", "plain", "f2")]
    df = spark.createDataFrame(rows, "service string, message string, file string")
    got = sorted((r.file, r.instance_id) for r in logs.with_instance(df).collect())
    assert got == [("f1", "a_10.0.0.1"), ("f1", "a_NA"), ("f2", "a")]


def test_vectors(spark):
    assert one(spark, V.parse_vector("v"), v="[1, -2, 2.5e3]") == [1.0, -2.0, 2500.0]
    assert one(spark, V.parse_vector("v"), v="7") == [7.0]
    assert one(spark, V.fit_vector("v", 3), v=[1.0, 2.0]) == [1.0, 2.0, 0.0]
    assert one(spark, V.fit_vector("v", 1), v=[1.0, 2.0]) == [1.0]
    assert one(spark, V.mask_range("v", 1, 2), v=[1.0, 2.0, 3.0]) == [1.0, 0.0, 3.0]
    assert one(spark, V.span_mse(F.col("v"), F.col("w"), [(0, 0), (1, 2)]), v=[1.0, 2.0, 3.0], w=[2.0, 2.0, 1.0]) == 3.0
    assert cube.modal_spans([2, 3]) == [(0, 1), (2, 4)]


def test_direct_instance_is_an_option(spark):
    schema = """start_time string, end_time string, trace_id string, span_id string, parent_span_id string, service_name string,
        operation_name string, duration string, status_code string, instance_id string, tags map<string,string>,
        process struct<serviceName: string, tags: map<string,string>>"""
    df = spark.createDataFrame([("5", None, "t", "1", None, "s", None, None, "200.0", "i1", None, None)], schema)
    row = parse_spans(df).first()
    assert (row.instance_id, row.status_code, row.request_type, row.duration) == ("s_instance", "200", "unknown", 0.0)
    assert parse_spans(df, use_direct_fields=True).first().instance_id == "i1"


# --- ordered work


def series(spark, values, keys=("a",), step=60, parts=4):
    rows = [(k, "m", datetime(2024, 1, 1) .fromtimestamp(1704067200 + i * step), v) for k in keys for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "instance_id string, feature string, timestamp timestamp_ntz, value double")
    return df.repartition(parts)


VALUES = [None, 1.0, None, None, 4.0, None, 7.0, None, None]


@pytest.mark.parametrize("parts", [1, 4, 17])
@pytest.mark.parametrize("chunk", [60, 120, 86_400])
def test_fills_do_not_depend_on_chunks(spark, chunk, parts):
    df = series(spark, VALUES, parts=parts)

    def run(method):
        return [r.value for r in metrics.fill_missing(df, method, 0.0, chunk).orderBy("timestamp").collect()]

    assert run("forward") == [0, 1, 1, 1, 4, 4, 7, 7, 7]
    assert run("backward") == [1, 1, 4, 4, 4, 7, 7, 0, 0]
    assert run("interpolate") == [0, 1, 2, 3, 4, 5.5, 7, 7, 7]
    assert run("constant") == [0, 1, 0, 0, 4, 0, 7, 0, 0]


def test_fill_of_an_empty_series(spark):
    got = [r.value for r in metrics.fill_missing(series(spark, [None, None]), "interpolate", 5.0).collect()]
    assert got == [5.0, 5.0]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_quantiles_are_exact(spark, levels):
    import random

    r = random.Random(levels)
    groups = {
        "wide": [r.uniform(-1e6, 1e6) for _ in range(301)],
        "close": [1.7e9 + r.random() for _ in range(200)],
        "ties": [float(r.randint(-2, 2)) for _ in range(150)],
        "single": [3.5],
        "zeros": [0.0] * 10,
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("wide", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {x.k: x for x in grouped_quantiles(df, ["k"], "v", probs, levels).collect()}
    for k, vs in groups.items():
        vs = sorted(vs)
        for name, p in probs.items():
            at = p * (len(vs) - 1)
            lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
            assert got[k][name] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_row_numbers(spark, block):
    df = spark.range(0, 100).where("id % 3 <> 0").repartition(5)
    got = [r.n for r in with_ordinal(df, [], ["id"], block_chunk("id", block), "n", start=0).orderBy("id").collect()]
    assert got == list(range(len(got)))


# --- metrics


def test_outlier_rule_with_and_without_gaps(spark):
    whole = [1.0] * 20 + [100.0]
    df = series(spark, whole)
    assert metrics.outlier_mask(df).where("is_outlier").count() == 1
    gap = series(spark, whole + [None])
    assert metrics.outlier_mask(gap).where("is_outlier").count() == 0
    assert metrics.outlier_mask(gap, skip_null=True).where("is_outlier").count() == 1
    assert metrics.outlier_mask(series(spark, [2.0] * 5)).where("is_outlier").count() == 0
    fixed = metrics.outlier_replace(df).agg(F.max("value")).first()[0]
    assert fixed == statistics.median(whole)


def test_resample_fills_gaps_with_null(spark):
    df = series(spark, [1.0, None, None, 5.0], step=300)
    got = [r.value for r in metrics.resample(df.where("value IS NOT NULL"), 300).orderBy("timestamp").collect()]
    assert got == [1.0, None, None, 5.0]


def test_tumbling_windows_leave_out_a_last_point_on_the_edge(spark):
    df = series(spark, [1.0] * 3)
    assert metrics.tumbling_windows(df, 60).count() == 2
    assert metrics.tumbling_windows(df.limit(1), 60).count() == 0


def test_intersection_is_part_of_union(spark):
    df = series(spark, [1.0, 2.0], keys=("a", "b")).unionByName(series(spark, [3.0] * 3, keys=("c",)))
    inner, outer = align.align_intersection(df), align.align_union(df)
    assert inner.count() == 6 and outer.count() == 9
    assert inner.select("instance_id", "timestamp").subtract(outer.select("instance_id", "timestamp")).count() == 0


def test_rare_templates_keep_totals(spark):
    df = series(spark, [float(i) for i in range(5)]).withColumn("value", F.col("value").cast("bigint"))
    assert logs.merge_rare(df, 100).agg(F.sum("value")).first()[0] == 10
    assert logs.merge_rare(df, 100).select("feature").distinct().first()[0] == logs.RARE
    assert logs.merge_rare(df, 1).where(F.col("feature") == logs.RARE).count() == 0


# --- graph


def spans(spark, rows):
    return spark.createDataFrame(
        rows, "trace_id string, span_id string, parent_span_id string, service_name string, timestamp bigint, file string"
    )


def test_call_pairs_by_scope_and_latest_duplicate(spark):
    df = spans(
        spark,
        [
            ("t1", "1", None, "old", 1, "f1"),
            ("t1", "1", None, "new", 2, "f1"),
            ("t1", "2", "1", "b", 3, "f2"),
            ("t2", "9", "1", "c", 4, "f1"),
            ("t2", "8", "missing", "d", 5, "f1"),
        ],
    )

    def pairs(scope):
        return sorted((r.caller, r.callee) for r in graph.call_pairs(df, scope).collect())

    assert pairs("trace") == [("new", "b")]
    assert pairs("file") == [("new", "c")]
    assert pairs("global") == [("new", "b"), ("new", "c")]


def test_neighbour_maxima(spark):
    scores = spark.createDataFrame([(1, 0, 5.0), (1, 1, 7.0), (1, 2, 1.0)], "case_id int, node_id int, score double")
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 0), (0, 1)], "src int, dst int")
    got = {r.node_id: (r.successor_max, r.predecessor_max) for r in graph.neighbour_max(scores, edges, ["case_id"]).collect()}
    assert got == {0: (7.0, 0.0), 1: (0.0, 5.0), 2: (0.0, 5.0)}


# --- scoring


def test_window_is_half_open(spark):
    cases = spark.createDataFrame([(1, 1000, "a")], "case_id int, timestamp bigint, cmdb_id string")
    loss = spark.createDataFrame([(700, "a", 1.0), (1299, "a", 3.0), (1300, "a", 99.0), (699, "a", 99.0)], "ts bigint, node string, loss double")
    assert scoring.case_window_mean(loss, cases, 10).first().score == 2.0


def test_series_repeats_its_first_value_and_empty_cases_are_reported(spark):
    cases = spark.createDataFrame([(1, 1000, "a"), (2, 9_000_000, "a")], "case_id int, timestamp bigint, cmdb_id string")
    loss = spark.createDataFrame([(900, "a", 1.0), (1000, "a", 2.0)], "ts bigint, node string, loss double")
    assert scoring.series_window(loss, cases, 10, 4).first().series == [1.0, 1.0, 1.0, 2.0]
    assert scoring.series_window(loss, cases, 10, 1).first().series == [2.0]
    assert [r.case_id for r in scoring.cases_without_samples(loss, cases, 10).collect()] == [2]


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(1, 1000.0), (1, 999.0), (2, -5.0)], "case_id int, score double")
    got = scoring.softmax(df).groupBy("case_id").agg(F.sum("score").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in got)


def ranked(spark):
    rows = [(1, "adservice2-0", 0, 9.0, 1), (1, "adservice", 1, 8.0, 2), (2, "x", 0, 42.0, 1), (2, "y", 1, None, 2)]
    return spark.createDataFrame(rows, "case_id int, node string, node_id int, score double, rank int")


def test_match_modes(spark):
    cases = spark.createDataFrame([(1, "adservice"), (2, "42")], "case_id int, cmdb_id string")

    def top1(match):
        return evaluate.topk_accuracy(ranked(spark), cases, 2, match).orderBy("k").first().accuracy

    assert (top1("exact"), top1("prefix"), top1("substring")) == (0.0, 0.5, 1.0)
    assert evaluate.mrr(ranked(spark), cases, 10, "exact").first().mrr == 0.25


def test_topk_is_monotone_and_ties_follow_node_id(spark):
    scores = spark.createDataFrame([(1, "b", 1, 2.0), (1, "a", 0, 2.0), (1, "c", 2, None)], "case_id int, node string, node_id int, score double")
    assert [r.node for r in scoring.rank_nodes(scores).orderBy("rank").collect()] == ["a", "b", "c"]
    cases = spark.createDataFrame([(1, "b")], "case_id int, cmdb_id string")
    acc = [r.accuracy for r in evaluate.topk_accuracy(scoring.rank_nodes(scores), cases).orderBy("k").collect()]
    assert acc == sorted(acc) == [0.0, 1.0, 1.0, 1.0, 1.0]


def test_ranking_loss(spark):
    rows = [(1, 0, 3.0, 0), (1, 1, 2.0, 1), (1, 2, 1.0, 0)]
    df = spark.createDataFrame(rows, "case_id int, node_id int, score double, label int")
    # scaled 1, .5, 0; less .5; weights 1, 1/2, 1/3
    assert scoring.ranking_loss(df).first().loss == pytest.approx(0.5)


def test_case_split_rules(spark):
    cases = spark.createDataFrame([(i,) for i in range(7)], "case_id int")
    got = evaluate.case_split(cases, 0.5, block=2)
    assert sorted(r.case_id for r in got.where("split = 'feedback'").collect()) == [0, 1, 2]
    assert got.where("split = 'test'").count() == 7
    assert evaluate.case_split(cases, 2, disjoint=True).where("split = 'test'").count() == 5
    with pytest.raises(ValueError):
        evaluate.case_split(cases, 1.5)


# --- cube


def points(spark, rows):
    return spark.createDataFrame(rows, "t_idx bigint, node_id int, vec array<double>")


def test_dense_cube_fills_absent_and_empty(spark):
    vec = points(spark, [(0, 0, [1.0, 2.0]), (0, 1, []), (2, 1, [3.0, 4.0])])
    axis = cube.default_axis(vec)
    nodes = spark.createDataFrame([(0,), (1,)], "node_id int")
    got = {(r.ts - cube.AXIS_START, r.node_id): r.vec for r in cube.dense_cube(vec, axis, nodes).collect()}
    assert got == {(0, 0): [1, 2], (0, 1): [0, 0], (300, 0): [0, 0], (300, 1): [0, 0], (600, 0): [0, 0], (600, 1): [3, 4]}


def test_times_short_and_repeated(spark):
    vec = points(spark, [(0, 0, [1.0]), (1, 0, [2.0]), (2, 0, [3.0]), (3, 0, [4.0])])
    truth = spark.createDataFrame([(50, 1), (50, 2)], "timestamp bigint, n bigint")
    dated = sorted((r.t_idx, r.ts) for r in cube.attach_timestamps(vec, truth, ["n"]).collect())
    assert dated == [(0, 50), (1, 50), (2, 0), (3, 0)]
    last = sorted((r.ts, r.vec) for r in cube.attach_timestamps(vec, truth, ["n"], dedupe="last").collect())
    assert last == [(0, [4.0]), (50, [2.0])]


def test_augment_is_repeatable(spark):
    vec = points(spark, [(t, n, [1.0] * 20) for t in range(10) for n in range(5)]).withColumn("ts", F.col("t_idx"))
    a = cube.augment(vec, 0.3, 2, seed=1).orderBy("copy_id", "t_idx", "node_id").collect()
    b = cube.augment(vec.repartition(7), 0.3, 2, seed=1).orderBy("copy_id", "t_idx", "node_id").collect()
    assert a == b
    zero = sum(x == 0 for r in a for x in r.vec) / (len(a) * 20)
    assert 0.3 < zero < 0.75
    assert cube.uneven_instances(vec).count() == 0


def test_time_chunk_is_monotone(spark):
    df = series(spark, [1.0] * 50, step=7000)
    chunks = [r.c for r in df.withColumn("c", time_chunk("timestamp", 3600)).orderBy("timestamp").collect()]
    assert chunks == sorted(chunks)
