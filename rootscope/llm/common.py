"""What several of the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootscope.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def held_out() -> Column:
    """The fifth of the rows that no model learns from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def map_texts(
    df: DataFrame, keep: list[str], rule: Callable[[list[str]], dict[str, list]], schema: str, batch_chars: int = 4_000_000
) -> DataFrame:
    """``rule`` on slices of the texts, in Arrow batches without a shuffle.

    ``df`` has the columns ``keep`` and ``text`` (no nulls). A slice ends at
    ``batch_chars`` characters, so memory is bounded by one slice or one text.
    ``rule`` returns the new columns; the columns ``keep`` pass unchanged.
    """
    kept = df.select(*keep).schema
    full = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept)}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start, size = 0, 0
            for i in range(batch.num_rows):
                size += len(texts[i].as_buffer() or b"")
                if size >= batch_chars or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    new = rule(part.column(part.num_columns - 1).to_pylist())
                    columns = [part.column(k) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(
                        columns + [v if isinstance(v, pa.Array) else pa.array(v) for v in new.values()], [*keep, *new]
                    )
                    start, size = i + 1, 0

    return df.select(*keep, "text").mapInArrow(run, full)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_number(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` stored with a column that tells repeated rows apart, and that column's name."""
    row = free_name(docs, "_row")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), label), row
