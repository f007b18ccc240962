"""Operator 6, benchmark decontamination by winnowing. DataFrame functions only.

Of each window of ``WINDOW`` words, the smallest hash of its ``GRAM``-word grams is its
fingerprint. Equal windows have equal fingerprints, so a document that holds an item's window
shares one with it: joining fingerprints loses nothing. In a document, neighbouring windows
mostly choose the same gram, so about two of seven grams are sent. A hit is then extended to
every window that holds its gram, and those windows are compared word by word with the items'.

Items of fewer words than a window have no fingerprint that documents are sure to choose.
For the lengths (at most nine) that the benchmark has, documents send the hashes of all their
grams of that length.

No join is hinted: the benchmark's fingerprints are stored first, so that Spark knows their
size and broadcasts them while they are small, or else joins by shuffle and splits what is
skewed. A window that many documents and many items share is joined once as a window; items
are added to distinct (document, window) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.llm.common import ascii_lower, free_name, whole_text
from rootscope.session import materialise

WINDOW, GRAM = 10, 5
GRAMS = WINDOW - GRAM + 1
#: What stands between words after A-Z became a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; only the first and last part of a split can be empty."""
    parts = F.split(ascii_lower(text), BETWEEN)
    return F.transform(F.array(parts), _trimmed)[0]


def _trimmed(parts: Column) -> Column:
    first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def _from(array: Column, i: Column, n: int) -> list[Column]:
    return [F.get(array, i + k) for k in range(n)]


def _grams(size: int, number) -> Column:
    """``number(words of a gram, place)`` for each gram; none if there are fewer words."""
    starts = F.slice("words", 1, F.greatest(F.col("n_words") - (size - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: number([w, *_from(F.col("words"), i + 1, size - 1)], i))


def _placed(gram: list[Column], i: Column) -> Column:
    """A hash whose low three bits are the gram's position modulo 8, which tells the grams of a window apart."""
    return F.xxhash64(*gram).bitwiseAND(F.lit(-8)).bitwiseOR(i.bitwiseAND(F.lit(7)).cast("bigint"))


def _with_fingerprints(rows: DataFrame) -> DataFrame:
    """Adds ``chosen``: for each window its smallest gram hash. The minimum of six neighbours comes
    from that of two."""
    hashed = rows.withColumn("grams", _grams(GRAM, _placed))
    pairs = F.transform("grams", lambda h, i: F.least(h, F.get(F.col("grams"), i + 1)))
    two = hashed.withColumn("grams", pairs)
    starts = F.slice("grams", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)))
    six = F.transform(starts, lambda h, i: F.least(h, F.get(F.col("grams"), i + 2), F.get(F.col("grams"), i + 4)))
    return two.withColumn("chosen", six).drop("grams")


def _with_words(rows: DataFrame) -> DataFrame:
    return rows.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows of equal ``doc_id`` and text have equal results, so the two name a row."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.withColumn("id_key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))).withColumn(
        "text_key", F.xxhash64("text")
    )


KEY = ["id_key", "text_key"]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item``, ``size``, ``window`` (its words) and ``mark``: fingerprint, or hash of a short item."""
    items = _with_words(
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), whole_text().alias("text"))
    )
    long = _with_fingerprints(items.where(f"n_words >= {WINDOW}"))
    long = _exploded(long, ["item", "words"], F.col("chosen"), "start", "chosen")
    text = lambda start, size: F.concat_ws(" ", F.slice("words", start + 1, size))
    long = long.select(
        "item", F.lit(WINDOW).alias("size"), text(F.col("start"), WINDOW).alias("window"), F.shiftright("chosen", 3).alias("mark")
    )
    short = items.where(f"n_words BETWEEN 1 AND {WINDOW - 1}").select(
        "item", F.col("n_words").alias("size"), F.concat_ws(" ", "words").alias("window"), F.xxhash64("words").alias("mark")
    )
    return long.unionAll(short).distinct()


def _exploded(rows: DataFrame, keep: list[str], array: Column, place: str, value: str) -> DataFrame:
    """The elements that are not null. The outer form, since for the inner one Spark asks for the
    array's size first and works the whole expression out again inside its own lambdas."""
    return rows.select(*keep, F.posexplode_outer(array).alias(place, value)).where(F.col(value).isNotNull())


def _hits(docs: DataFrame, marks: DataFrame, short: list[int]) -> DataFrame:
    """Runs of window starts (``low`` to ``high``) to look at: those whose windows hold a shared gram."""
    rows = _with_words(docs)
    chosen = _with_fingerprints(rows)
    # a gram counts once, in the first of the windows in a row that choose it
    once = F.transform("chosen", lambda h, i: F.when((i == 0) | (h != F.get(F.col("chosen"), i - 1)), h))
    sent = (
        _exploded(chosen, KEY, once, "start", "chosen").select(
            *KEY,
            F.shiftright("chosen", 3).alias("mark"),
            F.lit(WINDOW).alias("size"),
            (F.col("start") + F.expr("pmod((chosen & 7) - start, 8)")).cast("int").alias("high"),
        )
        .withColumn("low", F.col("high") - (GRAMS - 1))
    )
    for size in short:
        grams = _exploded(rows, KEY, _grams(size, lambda gram, _: F.xxhash64(F.array(*gram))), "low", "mark")
        sent = sent.unionByName(grams.withColumn("size", F.lit(size)).withColumn("high", F.col("low")))
    return sent.join(marks, ["size", "mark"], "left_semi").select(*KEY, "size", "low", "high")


def shared_windows(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with ``n_words``; the windows that they share (``start``, ``size``, ``window``); the items' windows."""
    rows = _keyed(docs)
    items = materialise(item_windows(benchmark), "items")
    short = sorted(r[0] for r in items.where(f"size < {WINDOW}").select("size").distinct().collect())
    marks = materialise(items.select("size", "mark").distinct(), "marks")
    hits = _hits(rows, marks, short).groupBy(*KEY).agg(F.collect_set(F.struct("size", "low", "high")).alias("hits"))
    hits = materialise(hits, "hits")
    # the texts are dealt out by document at every size, as they must be once many have hits
    read = _with_words(rows.join(hits.hint("merge"), KEY, "left"))
    starts = lambda x: F.sequence(
        F.greatest(x["low"], F.lit(0)), F.least(x["high"], F.col("n_words") - x["size"])
    )
    window = lambda x: F.transform(
        starts(x),
        lambda s: F.struct(
            s.alias("start"), x["size"].alias("size"), F.concat_ws(" ", F.slice("words", s + 1, x["size"])).alias("window")
        ),
    )
    read = materialise(
        read.select("doc_id", *KEY, "n_words", F.flatten(F.transform("hits", window)).alias("windows")), "windows"
    )
    seen = read.where("windows IS NOT NULL").select(*KEY, F.inline("windows")).distinct()
    known = items.select("size", "window").distinct()
    shared = materialise(seen.join(known, ["size", "window"], "left_semi"), "shared")
    return read.select("doc_id", *KEY, "n_words"), shared, items


def _covered() -> Column:
    """Number of words in the union of a document's windows."""
    spans = F.array_sort(F.collect_list(F.struct("start", "size")))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(seen: Column, span: Column) -> Column:
        end = span["start"] + span["size"]
        new = F.greatest(end - F.greatest(seen["end"], span["start"]), F.lit(0))
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["n"] + new).alias("n"))

    return F.aggregate(spans, zero, add, lambda x: x["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` of every row.

    A-Z become a-z; words are runs of other than ASCII control, punctuation and space. A window
    is ten consecutive words of an item, or the whole of a shorter item; a document word inside
    an occurrence of any window is hit. Null and empty texts have no words: documents with none
    are clean and items with none match nothing. Items with one id count once, an unknown id
    is the empty string. Repeated documents have repeated rows. An empty table of documents gives no
    rows, an empty benchmark leaves all clean. Other columns are not read.
    """
    read, shared, items = shared_windows(docs, benchmark)
    words = shared.groupBy(*KEY).agg(_covered().alias("n_hit"))
    pairs = shared.select(*KEY, "size", "window").distinct().join(items.select("item", "size", "window"), ["size", "window"])
    ids = pairs.groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("ids"))
    return (
        read.join(words, KEY, "left")
        .join(ids, KEY, "left")
        .select(
            "doc_id",
            F.col("n_words").cast("bigint").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", F.coalesce("ids", F.array().cast("array<string>"))).cast("binary"), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark, all columns kept.

    Null and empty texts stay, repeated rows stay or go together; with an empty benchmark all rows
    stay, an empty table gives none.
    """
    _, shared, _ = shared_windows(docs, benchmark)
    id_key, text_key = free_name(docs, "_id_key"), free_name(docs, "_text_key")
    bad = shared.select(F.col("id_key").alias(id_key), F.col("text_key").alias(text_key)).distinct()
    same_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))) == F.col(id_key)
    return docs.join(bad, same_id & (F.xxhash64(whole_text()) == F.col(text_key)), "left_anti")


DECONTAMINATE_SQL = rf"""
WITH w AS (
    SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT DISTINCT id AS item, least(len(words), {WINDOW}) AS size,
    array_to_string(words[s:s + least(len(words), {WINDOW}) - 1], ' ') AS text
    FROM (SELECT *, unnest(range(1, greatest(len(words) - {WINDOW - 1}, 1) + 1)) AS s FROM w WHERE side = 'b' AND len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
grams AS (SELECT id, size, s, array_to_string(words[s:s + size - 1], ' ') AS text
    FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS s FROM w CROSS JOIN sizes WHERE side = 'd')),
hits AS (SELECT g.id, g.s, g.size, i.item FROM grams g JOIN items i USING (size, text)),
n AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY id),
i AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item::VARCHAR, ',' ORDER BY item::VARCHAR) AS ids
    FROM hits GROUP BY id)
SELECT w.id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN n USING (id) LEFT JOIN i USING (id) WHERE side = 'd'
"""
