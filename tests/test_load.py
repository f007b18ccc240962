"""What keeps tasks small: shared work, stored small sides, bounded matrices."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rootscope.operators import logs, model, scoring, templates
from rootscope.queries import logs as queries


def many_cases(spark):
    cases = spark.createDataFrame([(i, 600 + 300 * (i % 2), f"n{i % 2}") for i in range(40)], "case_id int, timestamp bigint, cmdb_id string")
    rows = [(t, f"n{n}", float((t // 60 * (n + 1)) % 11) / 10) for t in range(0, 2400, 60) for n in range(3)]
    loss = spark.createDataFrame(rows, "ts bigint, node string, loss double")
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(3)], "node string, node_id int")
    return loss, cases, nodes, spark.createDataFrame([(0, 1), (1, 2)], "src int, dst int")


def test_equal_cases_are_graded_once(spark):
    rows = model.feedback_rows(*many_cases(spark), 10, 4)
    assert sorted(r["cases"] for r in rows.collect()) == [20, 20]


def test_equal_cases_share_a_unit(spark):
    cases = many_cases(spark)[1].unionByName(spark.createDataFrame([(None, 600, "n0")], "case_id int, timestamp bigint, cmdb_id string"))
    got = scoring.distinct_cases(cases, ["timestamp"]).collect()
    assert len(got) == 41 and len({r.unit for r in got}) == 3


def test_few_files_do_not_gather_rows(spark):
    wide = spark.range(1_000_000).select(
        F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.lit("svc").alias("service"), F.repeat(F.lit("x"), 200).alias("message"), "id"
    )
    plan = logs.with_instance(wide)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("assign", ["pos", "final"])
def test_few_texts_do_not_gather_rows(spark, assign):
    text = F.concat(F.lit("order <NUM> line <NUM> status s"), F.col("id") % 3)
    rows = spark.range(100_000).select(F.col("id").alias("pos"), text.alias("text"))
    done = templates.assign_templates(rows, templates.mine_templates(rows), assign=assign)
    plan = done._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [tuple(r) for r in done.groupBy("template_id").count().collect()] == [(0, 100_000)]


def test_texts_are_masked_once(spark, monkeypatch):
    calls, real = [], queries._texts
    monkeypatch.setattr(queries, "_texts", lambda s, d: calls.append(1) or real(s, d))
    queries.QUERIES["template_text"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_matrices_are_bounded():
    vec = pa.array(list(np.ones((20_000, 128))))
    sizes = [x.size for _, x in model._blocks([pa.RecordBatch.from_arrays([vec], ["vec"])])]
    assert sum(sizes) == 20_000 * 128 and max(sizes) <= model._NUMBERS
