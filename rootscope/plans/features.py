"""Whole feature chains, raw rows to aligned long features.

``scope='file'`` keeps files apart, as a batch per file would: template ids, rare
templates, shared metrics and shared times are those of one file.  It is still one job;
the file becomes part of the instance name, ``file/instance``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.operators import align, logs, metrics, templates, traces
from rootscope.session import materialise

SEPARATOR = "/"


def _scope_of(scope: str) -> Column | None:
    return F.substring_index("instance_id", SEPARATOR, 1) if scope == "file" else None


def by_file(table: DataFrame, file: str = "file") -> DataFrame:
    """Instances named ``file/instance``; slashes in the file name are replaced."""
    plain = F.replace(F.col(file), F.lit(SEPARATOR), F.lit("\\"))
    return table.withColumn("instance_id", F.concat(plain, F.lit(SEPARATOR), "instance_id"))


def split_scope(features: DataFrame) -> DataFrame:
    """``file`` and ``instance_id`` of scoped instances as two columns again."""
    return features.withColumn("file", F.substring_index("instance_id", SEPARATOR, 1)).withColumn(
        "instance_id", F.regexp_replace("instance_id", "^[^/]*/", "")
    )


def metric_features(
    cells: DataFrame,
    seconds: int = 60,
    schema: str = "intersection",
    threshold: float | None = 3.0,
    skip_null: bool = False,
    fill: float = 0.0,
    scope: str = "all",
) -> DataFrame:
    """Averaged cells to aligned features.

    Filling comes before resampling, so bins that resampling adds stay NULL.  The two
    tables that several later steps read are stored once instead of being recomputed.
    """
    within = _scope_of(scope)
    dense = materialise(metrics.dense_cells(cells, schema, fill, within), "dense")
    cleaned = materialise(metrics.clean(dense, threshold, skip_null, fill), "cleaned")
    return align.align_ranges(metrics.resample(cleaned, seconds), within)


def log_features(
    rows: DataFrame,
    seconds: int = 60,
    sim_th: float = templates.SIM_TH,
    minimum: int = logs.MIN_FREQUENCY,
    assign: str = "pos",
    empty: str = "own",
    scope: str = "all",
    known: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Log rows with ``instance_id`` and ``pos`` to ``(aligned counts, templates)``.

    ``known`` are the stored templates of the days before, which are continued; the positions of a day
    start anew.
    """
    within = _scope_of(scope)
    # masked once; nothing else of a row goes through the matching
    texts = templates.with_text(rows)
    names = F.lit("") if within is None else within
    texts = materialise(texts.select(names.alias("scope"), "instance_id", "timestamp", "pos", "text"), "texts")
    if known is not None:
        texts = templates.positions_after(texts, known)
    mined = templates.mine_templates(texts, sim_th, empty, known=known)
    assigned = templates.assign_templates(texts, mined, sim_th, assign)
    counts = materialise(logs.template_counts(assigned, seconds, zeros=False), "counts")
    # rare templates are merged while the table is sparse
    merged = materialise(logs.with_zeros(logs.merge_rare(counts, minimum)), "merged")
    return align.align_intersection(merged, within), mined


def trace_features(parsed: DataFrame, seconds: int = 60, accuracy: str = "exact", scope: str = "all") -> DataFrame:
    """Parsed spans to aligned features, wide with nineteen columns."""
    features = materialise(traces.trace_features(parsed, seconds, accuracy), "trace-features")
    return align.align_intersection(features, _scope_of(scope))
