"""Operator 2, repeated lines: overlapping windows of three lines. DataFrame functions only.

Each run of three consecutive lines is hashed to 128 bits. Windows are counted globally; of a
repeated window every occurrence but the first, by document and line, covers its three lines.
Covered lines are removed. A removed line always has an equal earlier one.

The counts combine before the shuffle. Occurrences and repeated windows are stored before they
are joined, so that Spark knows their sizes and splits a window that a third of all documents
share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.llm.common import whole_text
from rootscope.session import materialise

LINES = 3
#: ``doc_id`` and the hash of the text name a document.
KEY = ["id_key", "text_key"]


def _documents(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.withColumn("id_key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))).withColumn(
        "text_key", F.xxhash64("text")
    )


def _windows(lines: Column) -> Column:
    """Two hashes of each run of lines; none if there are fewer."""
    starts = F.slice(lines, 1, F.greatest(F.size(lines) - (LINES - 1), F.lit(0)))

    def hashes(line: Column, i: Column) -> Column:
        run = [line, *[F.get(lines, i + k) for k in range(1, LINES)]]
        return F.struct(F.xxhash64(*run).alias("a"), F.xxhash64(F.lit(LINES), *run).alias("b"))

    return F.transform(starts, hashes)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """For documents that repeat lines: ``id_key``, ``text_key`` and ``starts`` of the windows that go."""
    rows = _documents(docs).select(*KEY, F.split("text", "\n").alias("lines"))
    # outer, as for the inner form Spark works out the windows twice
    seen = rows.select(*KEY, F.posexplode_outer(_windows(F.col("lines"))).alias("start", "w"))
    seen = seen.where("w IS NOT NULL").select(*KEY, "start", "w.*")
    seen = materialise(seen, "line-windows")
    place = F.struct(*KEY, "start")
    often = seen.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    often = materialise(often.select("a", "b", "first"), "repeated-windows")
    later = seen.join(often, ["a", "b"]).where(place != F.col("first"))
    return later.groupBy(*KEY).agg(F.collect_set("start").alias("starts"))


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` without repeated lines, ``n_lines``, ``n_removed`` of every row.

    Lines stand between line feeds. Documents go by ``doc_id``, null first, and of equal ids by a
    hash of the text; rows of equal ``doc_id`` and text are one document and are treated alike.
    Texts of fewer than three lines stay as they are. A null text is empty; an empty text has
    no lines. An empty table gives no rows; other columns are not read.
    """
    found = materialise(repeated_lines(docs), "repeated-lines")
    lines = F.split("text", "\n")
    all_ = F.sequence(F.lit(0), F.size("lines") - 1)
    gone = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (LINES - 1))))
    # the texts are dealt out by document at every size, as they must be once many repeat lines
    rows = _documents(docs).join(found.hint("merge"), KEY, "left").withColumn("lines", lines)
    rows = rows.withColumn("stay", F.when(F.col("starts").isNotNull(), F.array_except(all_, gone)))
    left = F.concat_ws("\n", F.transform("stay", lambda i: F.get("lines", i)))
    return rows.select(
        "doc_id",
        F.when(F.col("stay").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.when(F.col("text") == "", 0).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("stay"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, s, array_to_string(lines[s:s + 2], chr(10)) AS w
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS s FROM d)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, unnest([s, s + 1, s + 2]) AS i FROM r WHERE k > 1),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (gone.i IS NULL) AS text, count(gone.i) AS n_removed
    FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(k.text, '') AS text, CASE WHEN d.text = '' THEN 0 ELSE len(lines) END AS n_lines, n_removed
FROM d JOIN k USING (doc_id)
"""
