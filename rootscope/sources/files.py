"""Readers for raw telemetry files.

Each call reads one glob or several.  CSV columns go by the header, and every file has its own, so
that a folder may hold a file per metric or files of several versions of an exporter.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootscope.functions import scalars as S
from rootscope.functions.vectors import parse_vector
from rootscope.session import materialise

FILE_STEM = r"^([^.]*)"


def _paths(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _kind(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _fields(line: Column) -> Column:
    """Fields of a CSV line; quoted ones may hold commas and doubled quotes."""
    plain = F.split(line, ",")
    quoted = F.transform(
        F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'),
        lambda f: F.replace(F.regexp_replace(f, r'^\s*"(.*)"\s*$', "$1"), F.lit('""'), F.lit('"')),
    )
    return F.transform(F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain), lambda f: F.trim(f))


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines of CSV files with their place, and ``(_file, _head)``, the first line of each file.

    Blank lines do not count.  The header table has one row per file and is stored.
    """
    lines = _with_file(spark.read.text(path)).withColumn("value", F.regexp_replace("value", "^\ufeff|\r$", ""))
    lines = _in_file_order(lines.where(F.trim("value") != ""))
    heads = lines.where("_block = 0").groupBy("_file").agg(F.min_by("value", "_id").alias("_head"))
    return lines, materialise(heads, "headers")


def _csv_by_file(spark: SparkSession, path: str) -> DataFrame:
    """``names``, ``fields``, ``_stem`` of every line of CSV files, each file by its own header.

    One plan for any number of files and headers: the first line of each file is joined to
    its lines.
    """
    lines, heads = _lines(spark, path)
    rows = lines.join(heads, "_file").where(F.col("value") != F.col("_head"))
    return rows.select(_fields(F.col("_head")).alias("names"), _fields(F.col("value")).alias("fields"), "_file", "_stem")


def _csv(spark: SparkSession, path: str, wanted: list[str], complete: bool = False) -> DataFrame:
    """The wanted columns as text, each file by its own header, with ``_file``, ``_stem``, ``_block`` and ``_id``.

    A column that no file has is left out; where some lack it, it is NULL there.  With ``complete``
    files that lack one are left out with a warning.  Lines are read by Spark's CSV parser.
    """
    lines, heads = _lines(spark, path)
    width = heads.agg(F.max(F.size(F.split("_head", ",")))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))

    def fields(rows: DataFrame, line: str, out: str) -> DataFrame:
        parsed = rows.withColumn("_parsed", F.from_csv(F.col(line), schema))
        return parsed.withColumn(out, F.array(*[F.col(f"_parsed.c{i}") for i in range(width)])).drop("_parsed")

    heads = fields(heads, "_head", "_names").withColumn("_names", F.transform("_names", lambda n: F.trim(n)))
    if complete:
        whole = F.size(F.array_intersect("_names", F.array(*[F.lit(n) for n in wanted]))) == len(wanted)
        for r in heads.where(~whole).select("_file").limit(3).collect():
            warnings.warn(f"file without {', '.join(wanted[:-1])} or {wanted[-1]}: {r[0]}", stacklevel=3)
        heads = heads.where(whole)
    known = {r[0] for r in heads.select(F.explode("_names")).distinct().collect()}  # names of columns
    rows = fields(lines.join(heads, "_file").where(F.col("value") != F.col("_head")), "value", "_fields")
    picks = [F.get("_fields", F.array_position("_names", F.lit(n)).cast("int") - 1).alias(n) for n in wanted if n in known]
    return rows.select(*picks, "_file", "_stem", "_block", "_id")


def _cells_by_header(rows: DataFrame, instance_col: str) -> DataFrame:
    """Metric rows of lines with names: long files as they are, wide ones melted."""
    field = lambda name: F.nullif(F.get("fields", F.array_position("names", F.lit(name)).cast("int") - 1), F.lit(""))
    long = F.array_contains("names", "metric_name") & F.array_contains("names", "value")
    cell = lambda name, value: F.struct(name.alias("metric_name"), value.try_cast("double").alias("value"))
    melted = F.filter(
        F.transform("names", lambda n, i: cell(n, F.get("fields", i))),
        lambda c: ~c["metric_name"].isin("timestamp", instance_col),
    )
    instance = F.when(F.array_contains("names", instance_col), field(instance_col)).otherwise(F.col("_stem"))
    timed = rows.where(F.array_contains("names", "timestamp"))
    cells = timed.select(
        instance.alias("instance_id"),
        event_time(field("timestamp")).alias("timestamp"),
        F.inline(F.when(long, F.array(cell(field("metric_name"), field("value")))).otherwise(melted)),
    )
    return cells.select("instance_id", "timestamp", "metric_name", S.missing_to_null("value").alias("value"))


def _json(spark: SparkSession, path: str, lines: bool, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        return reader.schema(schema).json(path)
    return reader.option("primitivesAsString", True).json(path)


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_stem": F.regexp_extract("_metadata.file_name", FILE_STEM, 1)})


def event_time(raw: Column | str) -> Column:
    """Seconds since 1970 when the value is a number, else parsed text."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    number = raw.try_cast("double")
    return F.coalesce(S.seconds_to_ts(number), F.try_to_timestamp(raw.cast("string")).cast("timestamp_ntz"))


def _timed(df: DataFrame) -> DataFrame:
    kind = dict(df.dtypes)["timestamp"]
    ts = F.col("timestamp").cast("timestamp_ntz") if kind.startswith("timestamp") else event_time("timestamp")
    return df.withColumn("timestamp", ts)


def read_metrics(
    spark: SparkSession,
    paths: str | list[str],
    instance_col: str = "instance_id",
    json_lines: bool = False,
    kind: str | None = None,
) -> DataFrame:
    """``(instance_id, timestamp, metric_name, value)`` from csv, json or parquet.

    Wide files are melted; their empty fields are rows without a value.  Files without a ``timestamp`` or of another kind are left
    out with a warning.  Without an instance column the file stem is the instance.
    ``kind`` overrides the extension, for folders.
    """
    parts = []
    for path in _paths(paths):
        ext = kind or _kind(path)
        if ext == "csv":
            rows = _csv_by_file(spark, path)
            timeless = rows.where(~F.array_contains("names", "timestamp")).select("_file").first()
            if timeless:
                warnings.warn(f"no timestamp column: {timeless[0]}", stacklevel=2)
            parts.append(_cells_by_header(rows, instance_col))
            continue
        if ext == "json":
            df = _json(spark, path, json_lines)
        elif ext == "parquet":
            df = spark.read.parquet(path)
        else:
            warnings.warn(f"unsupported metric file: {path}", stacklevel=2)
            continue
        if "timestamp" not in df.columns:
            warnings.warn(f"no timestamp column: {path}", stacklevel=2)
            continue
        parts.append(_metric_rows(_timed(_with_file(df)), instance_col))
    return _union(spark, parts, "instance_id string, timestamp timestamp_ntz, metric_name string, value double")


def _metric_rows(df: DataFrame, instance_col: str) -> DataFrame:
    instance = F.col(instance_col).cast("string") if instance_col in df.columns else F.col("_stem")
    df = df.withColumn("_instance", instance)
    if {"metric_name", "value"} <= set(df.columns):
        long = df.select("_instance", "timestamp", "metric_name", F.col("value").try_cast("double").alias("value"))
    else:
        names = [c for c in df.columns if c not in ("timestamp", instance_col, "_instance", "_file", "_stem")]
        wide = df.select("_instance", "timestamp", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names])
        long = wide.unpivot(["_instance", "timestamp"], [f"`{c}`" for c in names], "metric_name", "value")
    return long.select(
        F.col("_instance").alias("instance_id"), "timestamp", "metric_name", S.missing_to_null("value").alias("value")
    )


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# --- logs ------------------------------------------------------------------------


def read_logs(
    spark: SparkSession,
    paths: str | list[str],
    json_lines: bool = False,
    year: int | None = None,
    kind: str | None = None,
) -> DataFrame:
    """``(timestamp, service, message, file, pos, ts_ok)`` from csv, json or text files.

    ``pos`` numbers the rows in file order.  Text files have no service column: the
    file stem stands in.  CSV files without a time, message or service are left out with a warning.
    """
    parts = []
    for path in _paths(paths):
        ext = kind or _kind(path)
        if ext == "csv":
            df = _csv(spark, path, ["timestamp", "message", "service"], complete=True)
        else:
            df = _in_file_order(_with_file(_json(spark, path, json_lines) if ext == "json" else spark.read.text(path)))
        if ext not in ("csv", "json"):
            df = S.parse_log_lines(df, "value", year).withColumn("service", F.col("_stem"))
        elif {"timestamp", "message", "service"} <= set(df.columns):
            df = _timed(df).withColumn("ts_ok", F.col("timestamp").isNotNull())
        else:
            warnings.warn(f"log file without timestamp, message or service: {path}", stacklevel=2)
            continue
        parts.append(
            df.select("timestamp", F.col("service").cast("string").alias("service"), "message", F.col("_file").alias("file"),
                      "_block", "_id", "ts_ok")
        )
    schema = "timestamp timestamp_ntz, service string, message string, file string, _block bigint, _id bigint, ts_ok boolean"
    return _numbered(_union(spark, parts, schema))


def _in_file_order(df: DataFrame) -> DataFrame:
    """Block and running id: within a block the ids rise by one per row."""
    return df.withColumns({"_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})


def _numbered(rows: DataFrame) -> DataFrame:
    """``pos`` from (file, block, row), by one small row per file block and no sort of rows.

    A union gives its inputs their own partitions, so blocks never share an id range.
    """
    blocks = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), (F.max("_id") - F.min("_id") + 1).alias("_n"))
    earlier = Window.orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        rows.join(starts, ["file", "_block"])
        .withColumn("pos", F.col("_start") + F.col("_id") - F.col("_first"))
        .select("timestamp", "service", "message", "file", "pos", "ts_ok")
    )


def order_by_instance(rows: DataFrame) -> DataFrame:
    """Replaces ``pos`` so that instances follow each other by first file, then name.

    This is the order in which a reader that groups files by instance meets the rows.
    """
    firsts = rows.groupBy("instance_id").agg(F.min("file").alias("_file"))
    ranks = firsts.select("instance_id", F.row_number().over(Window.orderBy("_file", "instance_id")).alias("_rank"))
    return rows.join(ranks, "instance_id").withColumn("pos", F.shiftleft(F.col("_rank").cast("bigint"), 40) + F.col("pos")).drop("_rank")


# --- spans -----------------------------------------------------------------------

# The two spellings of span fields; the first one wins.
SPAN_FIELDS = {
    "trace_id": ["traceId", "trace_id"],
    "span_id": ["spanId", "span_id"],
    "parent_span_id": ["parentSpanId", "parent_span_id", "parent_id"],
    "operation_name": ["operationName", "operation_name"],
    "service_name": ["serviceName", "service_name"],
    "start_time": ["startTime", "start_time"],
    "end_time": ["endTime", "end_time"],
    "duration": ["duration"],
    "status_code": ["statusCode", "status_code"],
}
_TAGS = "map<string,string>"
_SPAN = ", ".join(f"{n} string" for names in SPAN_FIELDS.values() for n in names) + (
    f", instance_id string, tags {_TAGS}, process struct<serviceName: string, tags: {_TAGS}>"
)


def normalise_spans(raw: DataFrame) -> DataFrame:
    """Raw spans in either spelling to one set of columns."""
    have = set(raw.columns)

    def pick(name: str) -> Column:
        found = [F.col(n).cast("string") for n in SPAN_FIELDS[name] if n in have]
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name)

    tags = F.col("tags") if "tags" in have else F.lit(None).cast(_TAGS).alias("tags")
    process = F.col("process") if "process" in have else F.lit(None).cast(f"struct<serviceName: string, tags: {_TAGS}>").alias("process")
    extra = [c for c in ("instance_id", "host", "hostname", "file") if c in have]
    return raw.select(*[pick(n) for n in SPAN_FIELDS], tags, process, *extra)


def _csv_spans(spark: SparkSession, path: str) -> DataFrame:
    names = [n for both in SPAN_FIELDS.values() for n in both]
    raw = _csv(spark, path, [*dict.fromkeys(names), "instance_id", "host", "hostname"])
    return raw.withColumnRenamed("_file", "file").drop("_stem", "_block", "_id")


def read_spans(spark: SparkSession, paths: str | list[str], json_lines: bool = False, kind: str | None = None) -> DataFrame:
    """Normalised spans from JSON or CSV, with their ``file``.

    A JSON document is a list of spans, ``{"spans": […]}``, ``{"traces": [{"spans": […]}]}``
    or one span.
    """
    schema = f"{_SPAN}, spans array<struct<{_SPAN}>>, traces array<struct<spans array<struct<{_SPAN}>>>>"
    parts = []
    for path in _paths(paths):
        if (kind or _kind(path)) == "csv":
            df = _csv_spans(spark, path)
        else:
            df = _json(spark, path, json_lines, schema).withColumn("file", F.col("_metadata.file_path"))
            own = F.struct(*[c for c in df.columns if c not in ("spans", "traces", "file")])
            nested = F.flatten(F.transform("traces", lambda t: F.coalesce(t.getField("spans"), F.array().cast(f"array<struct<{_SPAN}>>"))))
            listed = F.when(F.col("spans").isNotNull(), F.col("spans")).when(F.col("traces").isNotNull(), nested).otherwise(F.array(own))
            df = df.select("file", F.inline(listed))
        parts.append(normalise_spans(df))
    return _union(spark, parts, ", ".join(f"{n} string" for n in SPAN_FIELDS))


# --- folders ---------------------------------------------------------------------

# File extensions per kind of telemetry.
MODALITY_FILES = {"log": "csv|json|log|txt", "metric": "csv|json|parquet", "trace": "csv|json"}


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """``(modality, date, path)`` of ``root/<date>/{log,metric,trace}/*`` and ground truth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    # folders may carry a column name, as in ``date=2024-01-01``
    folder = r"/(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?(log|metric|trace)/[^/]+$"
    truth = F.col("path").rlike(r"/groundtruth\.csv$")
    modality = F.when(truth, F.lit("groundtruth")).otherwise(F.regexp_extract("path", folder, 2))
    date = F.when(truth, F.regexp_extract("path", r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1)).otherwise(
        F.regexp_extract("path", folder, 1)
    )
    fits = modality == "groundtruth"
    for name, ext in MODALITY_FILES.items():
        fits = fits | ((modality == name) & F.col("path").rlike(rf"\.({ext})$"))
    depth = F.size(F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/"))
    base = len(("/" + root.split(":", 1)[-1].strip("/")).split("/"))
    level = F.when(modality == "groundtruth", base + 2).otherwise(base + 3)
    return files.where(fits & (depth == level)).select(modality.alias("modality"), date.alias("date"), "path")


_BY_SERVICE = r"/(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?([^/]+)/(?:trace/)?[^/]+$"


def read_trace_by_service(spark: SparkSession, root: str, pattern: str = "*/*/trace/trace.csv") -> DataFrame:
    """Spans of ``root/<service>/<date>/trace/trace.csv`` with the folder's service and date."""
    raw = _csv_spans(spark, f"{root.rstrip('/')}/{pattern}")
    return normalise_spans(raw).withColumns(
        {"folder_service": F.regexp_extract("file", _BY_SERVICE, 1), "date": F.regexp_extract("file", _BY_SERVICE, 2)}
    )


# Columns of ground-truth files.
TRUTH = ["st_time", "instance", "anomaly_type"]


def read_groundtruth(spark: SparkSession, root: str, pattern: str = "*/*/groundtruth.csv") -> DataFrame:
    """All ground-truth files below a root as one table; empty if there are none."""
    try:
        raw = _csv(spark, f"{root.rstrip('/')}/{pattern}", TRUTH)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        warnings.warn(f"no ground truth below {root}", stacklevel=2)
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in TRUTH))
    return raw.select(*TRUTH)


# --- vectors ---------------------------------------------------------------------


def _vectors(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """``(_path, key, t, k, vec)``: the innermost lists of JSON documents, ``depth`` lists deep.

    ``key`` names the top-level list (NULL of a bare one), ``t`` counts the lists one level up in it,
    ``k`` the vectors in such a list.  Documents are cut at every closing bracket and so are
    read by as many tasks as their size asks for; how deep a piece is, and what came before it, follows from running
    sums, one small row per file block.  Keys hold no brackets.  A document that cannot be read gives no rows.
    """
    pieces = _in_file_order(spark.read.option("lineSep", "]").text(path).withColumn("_path", F.col("_metadata.file_path")))
    opens = F.length("value") - F.length(F.replace("value", F.lit("["), F.lit("")))
    text = F.substring_index("value", "[", -1)
    before = F.when(opens > 0, F.left("value", F.length("value") - F.length(text))).otherwise(F.col("value"))
    key = F.regexp_extract("value", r'"([^"]*)"\s*:\s*\[', 1)
    pieces = pieces.select(
        "_path", "_block", "_id", "value", opens.alias("_opens"), text.alias("_text"),
        F.regexp_count(before, F.lit("null")).alias("_nulls"), F.nullif(key, F.lit("")).alias("_key"),
    )
    # the closing bracket that ends a piece is the one that the piece's own depth counts
    pieces = _running(pieces, "_block", {"_opened": F.col("_opens"), "_pieces": F.lit(1)})
    pieces = pieces.withColumn("_depth", F.col("_opened") - F.col("_pieces") + 1)
    inner, outer = F.col("_depth") == depth, F.col("_depth") == depth - 1
    nulls = F.when((inner & (F.col("_opens") == 1)) | (outer & (F.col("_opens") == 0)), F.col("_nulls")).otherwise(0)
    vec = F.from_json(F.concat(F.lit("["), "_text", F.lit("]")), "array<double>")
    pieces = pieces.withColumns({"_none": nulls, "_vec": F.when(inner, vec), "_inner": inner, "_outer": outer, "_top": F.col("_depth") == 1})
    pieces = _running(pieces, "_block", {"_elements": F.col("_none") + inner.cast("int"), "_lists": outer.cast("int")})
    upto = {"_from": F.when(F.col("_outer"), F.col("_elements")), "_first": F.when(F.col("_top"), F.col("_lists"))}
    pieces = _last_known(pieces, "_block", {**upto, "_named": F.col("_key")})
    here = F.col("_none") + F.col("_inner").cast("int")
    rows = pieces.where(here > 0).select(
        "_path",
        F.col("_named").alias("key"),
        (F.col("_lists") - F.col("_outer").cast("int") - F.coalesce("_first", F.lit(0))).alias("t"),
        (F.col("_elements") - here - F.coalesce("_from", F.lit(0))).alias("_k"),
        F.posexplode(
            F.concat(F.array_repeat(F.lit(None).cast("array<double>"), F.col("_none").cast("int")), F.when(F.col("_inner"), F.array("_vec")).otherwise(F.array().cast("array<array<double>>")))
        ).alias("_i", "vec"),
    )
    rest = F.regexp_replace("value", r"\s+", "")
    broken = (F.col("_inner") & F.col("_vec").isNull()) | ((F.col("_opens") == 0) & F.endswith(rest, F.lit(",")))
    place = F.struct("_block", "_id")
    whole = pieces.groupBy("_path").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_opens").alias("_all"), F.min_by(rest, place).alias("_head"),
        F.max_by(rest, place).alias("_tail"), (F.count_if(broken) > 0).alias("_broken"),
    )
    # what follows the last closing bracket is a piece of its own, if there is anything
    in_object = F.startswith("_head", F.lit("{")) & (F.col("_n") == F.col("_all") + 1) & F.endswith("_tail", F.lit("}"))
    bare = F.startswith("_head", F.lit("[")) & ((F.col("_n") == F.col("_all")) | ((F.col("_n") == F.col("_all") + 1) & (F.col("_tail") == "")))
    whole = whole.withColumn("_even", in_object | bare)
    good = materialise(whole.where("_even AND NOT _broken").select("_path"), "documents")
    return rows.join(good, "_path").select("_path", "key", F.col("t").cast("bigint").alias("t"), (F.col("_k") + F.col("_i")).cast("bigint").alias("k"), "vec")


def _running(rows: DataFrame, block: str, sums: dict[str, Column]) -> DataFrame:
    """Adds sums over the rows of a file up to and with each row."""
    order = Window.partitionBy("_path", block).orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_path").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_path", block).agg(*[F.sum(c).alias(f"{n}_in") for n, c in sums.items()])
    starts = blocks.select("_path", block, *[F.coalesce(F.sum(f"{n}_in").over(earlier), F.lit(0)).alias(f"{n}_at") for n in sums])
    rows = rows.select("*", *[F.sum(c).over(order).alias(n) for n, c in sums.items()]).join(starts, ["_path", block])
    return rows.withColumns({n: F.col(n) + F.col(f"{n}_at") for n in sums}).drop(*[f"{n}_at" for n in sums])


def _last_known(rows: DataFrame, block: str, values: dict[str, Column]) -> DataFrame:
    """Adds the last value that is not NULL: counts of rows before, keys of rows up to each row."""
    in_block = Window.partitionBy("_path", block).orderBy("_id")
    earlier = Window.partitionBy("_path").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = {n: F.max_by(c, F.when(c.isNotNull(), F.col("_id"))) for n, c in values.items()}
    blocks = rows.groupBy("_path", block).agg(*[c.alias(f"{n}_in") for n, c in ends.items()])
    carried = blocks.select("_path", block, *[F.last(f"{n}_in", ignorenulls=True).over(earlier).alias(f"{n}_at") for n in values])
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = [F.last(c, ignorenulls=True).over(upto if n == "_named" else before).alias(n) for n, c in values.items()]
    rows = rows.select("*", *local).join(carried, ["_path", block])
    return rows.withColumns({n: F.coalesce(n, f"{n}_at") for n in values}).drop(*[f"{n}_at" for n in values])


_LISTED = "key IS NULL OR key = 'X'"


def read_window_vectors(
    spark: SparkSession, path: str, instance: str = r"/([^/]+)/[^/]+$", first: Column | None = None
) -> DataFrame:
    """``(instance, t_idx, vec)`` from JSON documents of an instance: ``{"X": [[…]]}`` or a bare list.

    A file that cannot be read gives no rows.  ``instance`` finds the name in the path.  A
    history may be many documents: ``first`` is the number of a document's first step, from ``_path``.
    """
    start = F.lit(0) if first is None else first
    rows = _vectors(spark, path, 2).where(_LISTED)
    return rows.select(F.regexp_extract("_path", instance, 1).alias("instance"), (F.col("k") + start).cast("bigint").alias("t_idx"), "vec")


def read_metric_cube(spark: SparkSession, path: str, instances: int | None = None, first: Column | None = None) -> DataFrame:
    """``(t_idx, node_id, vec)`` from ``{"X": [fault][instance][feature]}``, of all or the first ``instances``.

    ``first`` as for ``read_window_vectors``.
    """
    start = F.lit(0) if first is None else first
    rows = _vectors(spark, path, 3).where(_LISTED)
    points = rows.select((F.col("t") + start).cast("bigint").alias("t_idx"), F.col("k").cast("int").alias("node_id"), "vec")
    return points if instances is None else points.where(F.col("node_id") < instances)


def read_feature_json(spark: SparkSession, path: str) -> DataFrame:
    """``(ts, node_id, vec)`` from ``{"<epoch seconds>": [[…] per instance]}``."""
    return _vectors(spark, path, 2).select(F.col("key").try_cast("bigint").alias("ts"), F.col("k").cast("int").alias("node_id"), "vec")


def read_vector_csv(spark: SparkSession, path: str, instance: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """``(instance, ts, vec)`` from CSV ``(timestamp, value="[…]")`` in one folder per service."""
    raw = _csv(spark, path, ["timestamp", "value"])
    return raw.select(
        F.regexp_extract("_file", instance, 1).alias("instance"),
        F.col("timestamp").cast("double").cast("bigint").alias("ts"),
        parse_vector("value").alias("vec"),
    )


def load_features_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A CSV feature table by name; pass ``schema`` to spare the pass that guesses types."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(f"{folder.rstrip('/')}/{name}")
