"""Readers on small hand-made files."""

import json
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootscope.operators import cube, metrics, model, scoring
from rootscope.operators.spread import block_chunk, previous_in_group
from rootscope.operators.traces import parse_spans
from rootscope.sources import files as R
from rootscope.sources import sinks as W
from rootscope.plans import diagnose
from rootscope.queries import adapters as A
from rootscope.sources.cases import project_cases


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_metrics_long_wide_and_stem(spark, tmp_path):
    long = put(f"{tmp_path}/a/long.csv", "timestamp,instance_id,metric_name,value\n60,i1,cpu,1.5\n120.5,i1,cpu,\n")
    wide = put(f"{tmp_path}/b/host7.cpu.csv", "timestamp,cpu,mem\n2024-01-01 00:00:00,1,2\n")
    listed = put(f"{tmp_path}/c/x.json", [{"timestamp": 60, "instance_id": "i2", "metric_name": "cpu", "value": 3}])
    put(f"{tmp_path}/d/x.txt", "nothing")
    timeless = put(f"{tmp_path}/e/x.csv", "a,b\n1,2\n")
    with pytest.warns(UserWarning):
        df = R.read_metrics(spark, [long, wide, listed, f"{tmp_path}/d/x.txt", timeless])
    got = sorted((r.instance_id, str(r.timestamp), r.metric_name, r.value) for r in df.collect() if r.value is not None)
    assert got == [
        ("host7", "2024-01-01 00:00:00", "cpu", 1.0),
        ("host7", "2024-01-01 00:00:00", "mem", 2.0),
        ("i1", "1970-01-01 00:01:00", "cpu", 1.5),
        ("i2", "1970-01-01 00:01:00", "cpu", 3.0),
    ]


def test_each_file_of_a_glob_has_its_own_header(spark, tmp_path):
    put(f"{tmp_path}/h1.cpu.csv", "timestamp,cpu\r\n60,1\r\n120,\r\n")
    put(f"{tmp_path}/h1.mem.csv", "mem,timestamp\n5,60\n\n")
    put(f"{tmp_path}/x.csv", '\ufeff"timestamp","instance_id","metric_name","value"\n60,h2,"a,""b""",7\n')
    df = R.read_metrics(spark, f"{tmp_path}/*.csv")
    got = sorted((r.instance_id, r.timestamp.minute, r.metric_name, r.value) for r in df.collect() if r.value is not None)
    assert got == [("h1", 1, "cpu", 1.0), ("h1", 1, "mem", 5.0), ("h2", 1, 'a,"b"', 7.0)]
    kept = metrics.average_cells(df, keep_empty=True).where("feature = 'cpu'").orderBy("timestamp").collect()
    assert [r.value for r in kept] == [1.0, None]


def test_logs_are_numbered_in_file_order(spark, tmp_path):
    put(f"{tmp_path}/b.csv", "timestamp,service,message\n5,s,m3\n6,s,m4\n")
    put(f"{tmp_path}/a.csv", "timestamp,service,message\n9,s,m1\n1,s,m2\n")
    logs = R.read_logs(spark, f"{tmp_path}/*.csv")
    assert [(r.pos, r.message) for r in logs.orderBy("pos").collect()] == [(0, "m1"), (1, "m2"), (2, "m3"), (3, "m4")]
    text = put(f"{tmp_path}/t/web.log", "2024-01-01 00:00:00 hello\n\nplain\n")
    rows = R.read_logs(spark, text).orderBy("pos").collect()
    assert [(r.service, r.message, r.ts_ok) for r in rows] == [("web", "hello", True), ("web", "plain", False)]


def test_instances_follow_each_other(spark):
    rows = [("b", "f1", 0), ("a", "f1", 1), ("b", "f2", 2), ("c", "f2", 3)]
    df = spark.createDataFrame(rows, "instance_id string, file string, pos bigint")
    assert [r.instance_id for r in R.order_by_instance(df).orderBy("pos").collect()] == ["a", "b", "b", "c"]


def test_span_documents(spark, tmp_path):
    span = {"traceId": "t", "spanId": "1", "startTime": 1625133600000, "operationName": "budget.refresh", "tags": {"error": True}}
    snake = {"trace_id": "t", "span_id": "2", "parent_span_id": "1", "start_time": 1625133600, "end_time": 1625133601, "service_name": "s"}
    missing = {"spanId": "3"}
    paths = [
        put(f"{tmp_path}/1.json", [span, missing]),
        put(f"{tmp_path}/2.json", {"spans": [snake]}),
        put(f"{tmp_path}/3.json", {"traces": [{"spans": [span]}, {}]}),
        put(f"{tmp_path}/4.json", snake),
        put(f"{tmp_path}/5.csv", "trace_id,span_id,parent_id,service_name,start_time,status_code\nt,5,1,c,1625133600,404.0\n"),
    ]
    raw = R.read_spans(spark, paths)
    assert raw.count() == 6
    got = sorted((r.span_id, r.parent_span_id, r.service_name, r.request_type, r.is_error, r.duration) for r in parse_spans(raw).collect())
    assert got == [
        ("1", None, "unknown", "http", True, 0.0),
        ("1", None, "unknown", "http", True, 0.0),
        ("2", "1", "s", "unknown", False, 1000.0),
        ("2", "1", "s", "unknown", False, 1000.0),
        ("5", "1", "c", "unknown", True, 0.0),
    ]


def test_folders(spark, tmp_path):
    for rel in ("2024-01-01/log/a.log", "2024-01-01/log/a.bin", "2024-01-01/metric/m.csv", "2024-01-02/trace/t.json",
                "2024-01-02/trace/deep/t.json", "2024-01-02/groundtruth.csv", "groundtruth.csv"):
        put(f"{tmp_path}/{rel}", "x")
    got = sorted((r.modality, r.date) for r in R.discover_files(spark, str(tmp_path)).collect())
    assert got == [("groundtruth", "2024-01-02"), ("log", "2024-01-01"), ("metric", "2024-01-01"), ("trace", "2024-01-02")]


def test_traces_by_service_and_ground_truth(spark, tmp_path):
    put(f"{tmp_path}/svc/2024-01-01/trace/trace.csv", "service_name,span_id,parent_id\na,1,\nb,2,1\n")
    put(f"{tmp_path}/svc/2024-01-01/groundtruth.csv", "st_time,instance,anomaly_type,more\n2021-07-01 10:00:00.5,i,cpu,z\n")
    rows = R.read_trace_by_service(spark, str(tmp_path)).orderBy("span_id").collect()
    assert [(r.folder_service, r.date, r.parent_span_id) for r in rows] == [("svc", "2024-01-01", None), ("svc", "2024-01-01", "1")]
    case = project_cases(R.read_groundtruth(spark, str(tmp_path))).first()
    assert (case.timestamp, case.level, case.cmdb_id, case.failure_type) == (1625133600, "WARNING", "i", "cpu")
    with pytest.warns(UserWarning):
        assert R.read_groundtruth(spark, f"{tmp_path}/none").count() == 0


def test_vector_documents(spark, tmp_path):
    put(f"{tmp_path}/w/n1/v.json", {"X": [[1, 2], [3, 4]]})
    put(f"{tmp_path}/w/n2/v.json", [[5, 6]])
    put(f"{tmp_path}/w/n3/v.json", "broken")
    got = sorted((r.instance, r.t_idx, r.vec) for r in R.read_window_vectors(spark, f"{tmp_path}/w/*/v.json").collect())
    assert got == [("n1", 0, [1, 2]), ("n1", 1, [3, 4]), ("n2", 0, [5, 6])]
    metric = put(f"{tmp_path}/m.json", {"X": [[[1], [2], [3]]]})
    assert R.read_metric_cube(spark, metric, 2).count() == 2
    feature = put(f"{tmp_path}/f.json", {"20": [[1.0]], "10": [[2.0]]})
    assert [r.ts for r in R.read_feature_json(spark, feature).orderBy("ts").collect()] == [10, 20]
    put(f"{tmp_path}/s/n1/LOG.csv", 'timestamp,value\n60.0,"[1.0, -2]"\n')
    row = R.read_vector_csv(spark, f"{tmp_path}/s/*/LOG.csv").first()
    assert (row.instance, row.ts, row.vec) == ("n1", 60, [1.0, -2.0])


def test_path_date(spark):
    df = spark.createDataFrame([("/x/2024-01-02/log/a.csv",), ("/x/a.csv",)], "p string")
    assert [r[0] for r in df.select(W.path_date("p")).collect()] == ["2024-01-02", "unknown_date"]


def test_csv_files_of_one_glob_with_different_headers(spark, tmp_path):
    put(f"{tmp_path}/l/a.csv", "timestamp,service,message\n60,s1,one\n\n61,s1,\" two, 2\"\n")
    put(f"{tmp_path}/l/b.csv", "message,level,timestamp, service\nthree,INFO,62,s2\n")
    put(f"{tmp_path}/l/c.csv", "text,timestamp\nno,63\n")
    with pytest.warns(UserWarning, match="c.csv"):
        logs = R.read_logs(spark, f"{tmp_path}/l/*.csv").orderBy("pos").collect()
    assert [(r.service, r.message, r.pos) for r in logs] == [("s1", "one", 0), ("s1", " two, 2", 1), ("s2", "three", 2)]
    put(f"{tmp_path}/t/a.csv", "traceId,spanId,serviceName,duration\nt,1,s,5\n")
    put(f"{tmp_path}/t/b.csv", "service_name,trace_id,span_id,parent_span_id\ns,t,2,1\n")
    spans = R.read_spans(spark, f"{tmp_path}/t/*.csv").orderBy("span_id").collect()
    assert [(r.trace_id, r.span_id, r.parent_span_id, r.service_name, r.duration) for r in spans] == [
        ("t", "1", None, "s", "5"), ("t", "2", "1", "s", None),
    ]
    put(f"{tmp_path}/g/d1/x/groundtruth.csv", "st_time,instance,anomaly_type\n2024-01-01 00:00:00,a,cpu\n")
    put(f"{tmp_path}/g/d2/x/groundtruth.csv", "instance,level,st_time,anomaly_type\nb,1,2024-01-02 00:00:00,mem\n")
    truth = R.read_groundtruth(spark, f"{tmp_path}/g").orderBy("instance").collect()
    assert [tuple(r) for r in truth] == [("2024-01-01 00:00:00", "a", "cpu"), ("2024-01-02 00:00:00", "b", "mem")]
    put(f"{tmp_path}/v/s1/a.csv", 'timestamp,value\n60,"[1, 2]"\n')
    put(f"{tmp_path}/v/s2/a.csv", 'value,note,timestamp\n"[3]",x,120\n')
    vectors = R.read_vector_csv(spark, f"{tmp_path}/v/*/a.csv").orderBy("ts").collect()
    assert [tuple(r) for r in vectors] == [("s1", 60, [1.0, 2.0]), ("s2", 120, [3.0])]


# --- models


def toy(spark):
    rows = [(t, n, [float(t % 5 + n), float((t * 3 + n) % 7), 1.0]) for t in range(40) for n in range(3)]
    return spark.createDataFrame(rows, "ts bigint, node_id int, vec array<double>")


def test_graph_layers_against_matrices(spark):
    """Degrees and sums of a time see only the nodes of that time."""
    pairs = [(0, 1), (1, 2), (2, 2), (0, 2), (2, 1)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    layers = [model.Layer([[0.5, -1.0], [0.25, 1.0], [-0.5, 0.0]], [0.1, -0.2], "both"), model.Layer([[1.0], [-1.0]])]
    cube = toy(spark).where("ts % 3 <> node_id")
    got = {(r.ts, r.node_id): r.vec for r in model.graph_conv(cube, edges, layers).collect()}
    want, times = {}, {}
    for r in cube.collect():
        times.setdefault(r.ts, {})[r.node_id] = np.array(r.vec)
    for ts, h in times.items():
        here = [(a, b) for a, b in pairs if a in h and b in h]
        sent, into = Counter(a for a, _ in here), Counter(b for _, b in here)
        for x in layers:
            both = x.norm == "both"
            near = {n: sum((h[a] / (sent[a] ** 0.5 if both else 1) for a, b in here if b == n), np.zeros_like(v)) for n, v in h.items()}
            near = {n: v / (max(into[n], 1) ** 0.5 if both else 1) for n, v in near.items()}
            h = {n: v @ np.array(x.weight) + (0 if x.bias is None else np.array(x.bias)) for n, v in near.items()}
            h = {n: np.where(v > 0, v, 0.01 * v) for n, v in h.items()}
        want |= {(ts, n): v.tolist() for n, v in h.items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_writing_a_day_keeps_other_days(spark, tmp_path):
    kind = "date string, instance_id string, timestamp string, feature string, value double"
    for day, value in (("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-02", 3.0)):
        rows = spark.createDataFrame([(day, "a", f"{day} 10:00:00", "f", value)], kind)
        W.write_features(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), f"{tmp_path}/f")
    assert sorted(r.value for r in spark.read.parquet(f"{tmp_path}/f").collect()) == [1.0, 3.0]


def test_all_ranks_are_written(spark, tmp_path):
    ranked = spark.createDataFrame([(1, i, f"n{i}", 1.0 / i) for i in range(1, 9)], "case_id int, rank int, node string, score double")
    cases = spark.createDataFrame([(1, "n3"), (2, "n1")], "case_id int, cmdb_id string")
    W.write_results(ranked, cases, ranked.limit(1), f"{tmp_path}/r")
    back = spark.read.option("header", True).csv(f"{tmp_path}/r/ranked").collect()
    assert sorted((r.case_id, r["rank"] or "") for r in back) == [("1", str(i)) for i in range(1, 9)] + [("2", "")]


def test_a_node_with_losses_outside_all_windows_is_ranked(spark):
    loss = spark.createDataFrame([(100, "a", 1.0), (101, "b", 2.0), (9000, "c", 9.0)], "ts bigint, node string, loss double")
    cases = spark.createDataFrame([(1, 100, "a"), (2, 5000, "b")], "case_id int, timestamp bigint, cmdb_id string")
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "node string, node_id int")
    edges = spark.createDataFrame([(0, 1)], "src int, dst int")
    ranked = scoring.score_cases(loss, cases, nodes, edges, 10).collect()
    assert sorted((r.case_id, r.node) for r in ranked) == [(i, n) for i in (1, 2) for n in "abc"]
    assert all(r.score is None for r in ranked if r.case_id == 2)


def test_previous_row_may_be_null(spark):
    rows = spark.createDataFrame([("g", 1, "x"), ("g", 2, None), ("g", 3, "y"), ("g", 12, "z")], "k string, t int, v string")
    got = previous_in_group(rows, ["k"], ["t"], "v", block_chunk("t", 10), "p").orderBy("t").collect()
    assert [r.p for r in got] == [None, "x", None, "y"]


def test_injected_fault_has_the_largest_loss(spark):
    from pyspark.sql import functions as F

    edges = spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int")
    odd = (F.col("ts") == 20) & (F.col("node_id") == 2)
    broken = toy(spark).withColumn("vec", F.when(odd, F.array(F.lit(40.0), F.lit(-30.0), F.lit(1.0))).otherwise(F.col("vec")))
    top = model.reconstruct(broken, edges, 2, train=toy(spark)).orderBy(F.desc("loss")).first()
    assert (top.ts, top.node_id) == (20, 2)


def feedback_case(spark):
    cases = spark.createDataFrame([(1, 600, "n1"), (2, 1200, "n2"), (3, 900, "other")], "case_id int, timestamp bigint, cmdb_id string")
    rows = [(t, f"n{n}", float((t // 60 * (n + 1)) % 11) / 10) for t in range(0, 2400, 60) for n in range(4)]
    loss = spark.createDataFrame(rows, "ts bigint, node string, loss double")
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(4)], "node string, node_id int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 2), (2, 2)], "src int, dst int")
    return loss, cases, nodes, edges


def test_gradient_of_the_ranking_loss(spark):
    given = feedback_case(spark)
    rows = model.feedback_rows(*given, 10, 4)
    at = np.array([0.1, 0.2, 0.3, 0.4, 0.3, 0.2])
    least, slope = model.feedback_gradient(rows, at[:4].tolist(), *at[4:])
    step = 1e-5
    moved = [at + sign * step * np.eye(6)[k] for k in range(6) for sign in (1, -1)]
    candidates = [(i, m[:4].tolist(), *m[4:]) for i, m in enumerate([at, *moved])]
    got = {r.candidate: r.loss for r in model.feedback_losses(*given, candidates, 10, 4).collect()}
    assert abs(got[0] - least) < 1e-12
    assert slope == pytest.approx([(got[2 * k + 1] - got[2 * k + 2]) / (2 * step) for k in range(6)], abs=1e-5)
    assert np.abs(slope).max() > 0.01


def test_fit_goes_below_the_grid(spark):
    given = feedback_case(spark)
    grid = model.weight_candidates(4, [1.0, 0.5], [0.0, 0.5], [0.0])
    best = model.best_candidate(model.feedback_losses(*given, grid, 10, 4), grid).first()
    weights, pre, suc, least = model.fit_feedback_weights(*given, 10, 4, steps=8, grid=grid)
    assert least < best.loss and len(weights) == 4
    again = model.feedback_losses(*given, [(0, weights, pre, suc)], 10, 4).first()
    assert abs(again.loss - least) < 1e-9
    none = given[0].where("false")
    assert model.fit_feedback_weights(none, *given[1:], 10, 4, grid=grid)[3] is None


def test_directions_equal_principal_components(spark):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    points = A.vectors(spark, "/root/testdata/sf0.01").select("ts", "node_id", "vec")
    fitted = model.fit_reconstruction(points, 8)
    rows = model._standardised(points, fitted.mean, fitted.std)
    pca = PCA(k=8, inputCol="features", outputCol="out").fit(rows.select(array_to_vector("vec").alias("features")))
    exact = model.Reconstruction(fitted.mean, fitted.std, np.asarray(pca.pc.toArray()))
    both = fitted.loss(points).join(exact.loss(points).withColumnRenamed("loss", "want"), ["ts", "node_id"])
    assert both.count() == points.count() and both.where("abs(loss - want) > 1e-6").count() == 0


def test_wide_vectors_are_reconstructed(spark):
    from pyspark.sql import functions as F

    # three directions in 20,000 features: nothing is left after three components
    width = 20_000
    part = lambda k: F.sin(F.col("id") * (k + 1) + k)
    vec = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: sum(part(k) * F.cos(i * (0.01 * k + 0.002)) for k in range(3)))
    points = spark.range(0, 60).select(F.col("id").alias("ts"), F.lit(0).alias("node_id"), vec.alias("vec"))
    fitted = model.fit_reconstruction(points, 3)
    assert fitted.components.shape == (width, 3)
    assert fitted.loss(points).agg(F.max("loss")).first()[0] < 1e-6
    assert model.fit_reconstruction(points, 1).loss(points).agg(F.max("loss")).first()[0] > 1e-3


def test_cube_of_very_many_features(spark):
    from pyspark.sql import functions as F

    n = 150_000
    cells = spark.range(0, n).select(
        (F.col("id") % 2).cast("int").alias("k"), F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("feature"), F.col("id").cast("double").alias("value")
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    times = spark.range(0, 4).select((start + F.expr("make_dt_interval(0, 0, id, 0)")).alias("timestamp"), F.col("id").alias("t"))
    metric = cells.join(times).select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("instance_id"), "timestamp", "feature", (F.col("value") + F.col("t")).alias("value"))
    small = metric.where("feature < 'f000010'").withColumn("feature", F.concat(F.lit("x"), "feature"))
    nodes = spark.createDataFrame([("n0", 0), ("n1", 1)], "node string, node_id int")
    cube_ = diagnose.build_cube(metric, small, small, nodes)
    assert cube_.spans == [(0, n - 1), (n, n + 9), (n + 10, n + 19)] and cube_.layout.count() == n + 20
    row = cube_.points.where("node_id = 1").orderBy("ts").first()
    assert len(row.vec) == n + 20 and row.vec[:4] == [0.0, 1.0, 0.0, 3.0] and row.vec[n : n + 4] == [0.0, 1.0, 0.0, 3.0]
    edges = spark.createDataFrame([(0, 1)], "src int, dst int")
    cases = spark.createDataFrame([(1, 1_704_067_260, "n1")], "case_id int, timestamp bigint, cmdb_id string")
    ranked = diagnose.diagnose(cube_, cases, nodes, edges, 2, 10)
    assert sorted(r.node for r in ranked.collect()) == ["n0", "n1"]


def test_json_arrays_are_read_in_pieces(spark, tmp_path):
    r = np.random.default_rng(4)
    vectors = [[round(float(x), 3) for x in r.normal(size=r.integers(0, 5))] for _ in range(400)]
    vectors[7] = None
    vectors[399] = None
    faults = [[vectors[(i * 5 + k) % 400] or [] for k in range(r.integers(0, 6))] for i in range(120)]
    times = {str(1000 + 60 * i): faults[i] for i in range(120)}
    put(f"{tmp_path}/w/i1/a.json", {"meta": [[9, 9]], "X": vectors, "y": [[1]]})
    put(f"{tmp_path}/w/i2/a.json", vectors[:50])
    put(f"{tmp_path}/w/i3/a.json", json.dumps({"X": vectors})[:-20])
    put(f"{tmp_path}/w/i4/a.json", '{"X": [[1, x], [2]]}')
    put(f"{tmp_path}/c.json", {"other": [[[1]], [[2]]], "X": faults})
    put(f"{tmp_path}/f.json", json.dumps(times, indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = R.read_window_vectors(spark, f"{tmp_path}/w/*/a.json")
        assert spark.read.option("lineSep", "]").text(f"{tmp_path}/w/i1/a.json").rdd.getNumPartitions() > 5
        rows = {(x.instance, x.t_idx): x.vec for x in got.collect()}
        assert rows == {("i1", i): v for i, v in enumerate(vectors)} | {("i2", i): v for i, v in enumerate(vectors[:50])}
        cube_rows = {(x.t_idx, x.node_id): x.vec for x in R.read_metric_cube(spark, f"{tmp_path}/c.json").collect()}
        assert cube_rows == {(i, k): v for i, fault in enumerate(faults) for k, v in enumerate(fault)}
        found = {(x.ts, x.node_id): x.vec for x in R.read_feature_json(spark, f"{tmp_path}/f.json").collect()}
        assert found == {(int(t), k): v for t, fault in times.items() for k, v in enumerate(fault)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
