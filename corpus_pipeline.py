"""From documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept, written as Parquet and read again. What a stage
stores on the way is deleted when the next one starts on rows that no longer read it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rootscope.llm.common import table
from rootscope.llm.decontaminate import drop_contaminated
from rootscope.llm.exact import drop_exact_duplicates
from rootscope.llm.neardup import drop_near_duplicates
from rootscope.llm.packing import pack
from rootscope.llm.quality import drop_low_quality
from rootscope.session import discard, materialise_at, scratch_folder, scratch_path


#: Scratch folders of stages that ran in this process.
_used: list[str] = []


def _stage(label: str):
    """A stage whose stored tables go below one folder."""

    def wrap(stage):
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            read = docs.inputFiles() if _used else []
            for folder in [f for f in _used if not any(f.rpartition("/")[2] in file for file in read)]:
                discard(spark, folder)
                _used.remove(folder)
            with scratch_folder(spark, f"work-{label}") as folder:
                _used.append(folder)
                return stage(spark, docs, sf_dir)

        return run_stage

    return wrap


@_stage("quality")
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


@_stage("exact")
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


@_stage("near")
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links join."""
    return drop_near_duplicates(docs)


@_stage("decontaminate")
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage("packing")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Shingle links and learnt rules are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from ``documents`` to the rows of the last.

    Only the table of the last stage stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = scratch_path(spark, f"stage-{name}")
        docs = materialise_at(stage(spark, docs, sf_dir), at)
        if before:
            discard(spark, before)
        before = at
    discard(spark, *_used)
    _used.clear()
    return docs
