"""Operator 5, exact duplicates: distributed MSD radix partitioning.

Texts are compared by their bytes, from the first on. Every round splits each group by its
next bytes, a *digit*; a group with one row is settled, and so are rows that end. Digits grow
fourfold, so a text of n bytes takes log4(n / 24) rounds, and most texts leave in the first.
Only rows that still share everything read so far are carried on, without the bytes read.
Equality rests on all bytes; no digest is compared.

A round first deals out digits only: they are counted before the shuffle, and rows of a (group, digit)
that others have too learn its number. The rest of a text is then dealt out by row number, so that
one group that holds a third of all rows is spread as evenly as any. The plan is the same at every size. Each
round is written below ``spark.checkpoint.dir`` and deleted once read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.llm.common import whole_text, with_row_number
from rootscope.session import discard, materialise, materialise_at, scratch_path

#: Bytes of the first digit, and the factor of the next ones.
FIRST_DIGIT, GROWTH = 32, 4


def one_space(text: Column) -> Column:
    """Runs of ASCII white space as one space."""
    return F.regexp_replace(F.translate(text, "\t\n\x0b\x0c\r", "     "), " {2,}", " ")


def _first() -> Column:
    """The row that stays: smallest doc_id, null last; of repeated rows any one."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid"))


def _digits(rest: Column, width: int) -> list[Column]:
    """The next digit, whether the text ends in it, and what follows it."""
    after = F.substr(rest, F.lit(width + 1))
    return [F.substring(rest, 1, width).alias("digit"), (F.octet_length(rest) <= width).alias("ended"), after.alias("rest")]


def _shared(rows: DataFrame) -> DataFrame:
    """Rows that share group and digit with another row: ``uid``, ``doc_id``, their new ``group``, ``keep_id``, ``n``, ``ended``."""
    key = ["group", "digit", "ended"]
    often = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), _first().alias("first")).where("n > 1")
    often = materialise(often, "radix-often")  # so that the join reads plain exchanges, which can be split
    return rows.select("uid", "doc_id", *key).join(often.hint("merge"), key).select(
        "uid", "doc_id", F.col("first.uid").alias("group"), F.col("first.doc_id").alias("keep_id"), "n", "ended"
    )


def exact_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of every row.

    Texts are equal when identical after each run of ASCII white space became one space; a
    null text is empty. The row with the smallest ``doc_id`` stays, a null ``doc_id`` only if
    the group has no other; of repeated rows with that ``doc_id`` one stays. An empty table
    gives no rows; other columns are not read. ``row`` names a column that numbers the rows
    and is returned as well; ``docs`` must then be a stored table.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", whole_text().alias("text"), (F.col(row) if row else F.monotonically_increasing_id()).alias("uid"))
    read = []
    if not row:  # else the rows are stored already
        read = [scratch_path(spark, "radix-texts")]
        texts = materialise_at(texts, read[0])
    body, width = one_space(F.col("text")).cast("binary"), FIRST_DIGIT
    heads = texts.select("uid", "doc_id", body.alias("body")).withColumn("text_sha256", F.sha2("body", 256))
    heads = materialise(heads.select("uid", "doc_id", "text_sha256", *_digits(F.col("body"), width)[:2]), "radix-heads")

    rows, groups = heads.withColumn("group", F.lit(0).cast("bigint")), None
    source, first = texts.select("uid", "text"), True
    while True:
        at = scratch_path(spark, "radix-shared")
        shared = materialise_at(_shared(rows), at)
        ended = shared.where("ended").select("uid", "keep_id", F.col("group").alias("keep_uid"), "n")
        groups = ended if groups is None else groups.unionAll(ended)
        going = shared.where("NOT ended").select("uid", "doc_id", "group")
        if going.isEmpty():
            break
        met = source.join(going.hint("merge"), "uid")
        if first:  # the texts themselves are read once more, after the join
            met = met.withColumn("rest", F.substr(body, F.lit(width + 1)))
        first, width = False, width * GROWTH
        next_at = scratch_path(spark, "radix-open")
        rows = materialise_at(met.select("uid", "doc_id", "group", *_digits(F.col("rest"), width)), next_at)
        discard(spark, *read)
        read, source = [next_at], rows.select("uid", "rest")
    discard(spark, *read)

    found = heads.select("uid", "doc_id", "text_sha256").join(groups, "uid", "left")
    return found.select(
        *([F.col("uid").alias(row)] if row else []),
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("keep_uid") == F.col("uid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The smallest ``doc_id`` stays, null last, of repeated rows one; null and empty texts are one group.
    An empty table gives no rows.
    """
    rows, row = with_row_number(docs, "exact-rows")
    kept = exact_duplicates(rows, row).where("kept").select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
    g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (body)
"""
