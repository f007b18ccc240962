"""The stages on a small corpus with planted cases, and the entry without the subpackage."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from compare import data_dir
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_windows
from test_exact import brute as brute_exact
from test_neardup import brute as brute_near

from rootscope.session import scratch_root

ROOT = Path(__file__).resolve().parents[2]


def test_stages_one_by_one_against_brute_force(spark, tmp_path):
    d = data_dir("sf0.001")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, d).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name == "packing":
            assert {r.doc_id for r in after.select("doc_id").collect()} == {i for i, _ in rows}
            break
        assert after.columns == docs.columns
        kept = sorted(r.doc_id for r in after.select("doc_id").collect())
        if name == "quality":
            labels = spark.read.parquet(f"{d}/labels.parquet")
            lost = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
            assert lost.where("quality = 1").count() <= 0.02 * labels.where("quality = 1").count()
            assert after.join(labels.where("quality = 0"), "doc_id").count() <= 0.4 * labels.where("quality = 0").count()
        elif name == "exact":
            assert kept == [r[0] for r in brute_exact(rows) if r[3]]
        elif name == "near":
            assert kept == sorted(i for i, (_, c) in brute_near(rows).items() if i == c)
        elif name == "decontaminate":
            assert kept == [r[0] for r in brute_windows(rows, items) if not r[5]]
        before = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "decontaminate", "packing"]


def test_run_gives_the_last_stage(spark):
    root = Path(scratch_root(spark).removeprefix("file:"))
    before = set(root.iterdir()) if root.exists() else set()
    rows = corpus_pipeline.run(spark, data_dir("sf0.001"))
    # nothing stays but the table of the last stage
    assert [p.name.split("-")[:2] for p in set(root.iterdir()) - before] == [["stage", "packing"]]
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.agg(F.max("length")).first()[0] <= 4096 and rows.count() > 0


def test_entry_without_the_subpackage(tmp_path):
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (tmp_path / "rootscope").mkdir()
    for part in (ROOT / "rootscope").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "rootscope" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})



def test_run_on_odd_documents(spark, tmp_path, docs):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data_dir('sf0.001')}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = docs([(None, "a b c"), (1, None), (2, ""), (2, ""), (None, None), (3, " word " * 50)])
    for clash in ("_row", "uid", "bucket"):
        rows = rows.withColumn(clash, F.lit("x"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.run(spark, str(tmp_path)).count()
    rows.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_chained_without_writing(spark):
    d = data_dir("sf0.001")
    chained = corpus_pipeline.exact(spark, corpus_pipeline.quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d), d)
    assert chained.count() > 0
