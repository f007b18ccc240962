"""Log and template queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootscope.functions import scalars as S
from rootscope.operators import logs as L
from rootscope.operators import templates as T
from rootscope.operators.spread import block_chunk, with_ordinal
from rootscope.session import materialise
from rootscope.queries.adapters import MONTH, logs_long, logs_short, rounded, table, with_sql

RARE_BELOW = 400


def _texts(s, d):
    """Masked once: messages and rows are read apart."""
    rows = T.with_text(L.with_instance(logs_short(s, d))).select("instance_id", "timestamp", "pos", "text")
    return materialise(rows, "texts")


def _parts(s, d):
    """Part descriptions of three or four words as messages: many templates of each length."""
    more = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit(" "), "p_brand")).otherwise("")
    return table(s, d, "part").select(F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" "), "p_type", more).alias("message"))


def _dictionary(texts):
    """All distinct masked messages as given templates, numbered by first position."""
    return T.number_templates(materialise(T.distinct_messages(texts), "dictionary"))


def _assigned(s, d):
    texts = _texts(s, d)
    return T.assign_templates(texts, _dictionary(texts), assign="final")


def _template_text(s, d):
    """Half of the ids are moved, so that some are unknown."""
    texts = _texts(s, d)
    dictionary = _dictionary(texts)
    ids = T.assign_templates(texts, dictionary, assign="final")
    return L.template_text(ids.select("pos", (F.col("template_id") + F.col("pos") % 2 * 100).alias("template_id")), dictionary)


def _counts(s, d):
    return L.template_counts(_assigned(s, d), MONTH)


def _by_day(s, d):
    """Part descriptions mined in three runs, each continuing the dictionary of the one before."""
    rows = materialise(T.with_text(_parts(s, d)), "texts")
    low, high = rows.agg(F.min("pos"), F.max("pos")).first()
    known = None
    for k in range(3):
        first, last = low + (high - low + 1) * k // 3, low + (high - low + 1) * (k + 1) // 3
        known = T.mine_templates(rows.where((F.col("pos") >= first) & (F.col("pos") < last)), known=known)
    return known.select("template_id", "pos", "text")


def _line_rows(s, d):
    """Text lines with one of the time stamps, an impossible date or none."""
    li = table(s, d, "lineitem")
    body = F.concat(F.lit(" item "), F.col("l_partkey").cast("string"), F.lit(" shipped "))
    form = F.col("l_orderkey") % 6
    stamp = (
        F.when(form == 0, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
        .when(form == 1, F.date_format("l_shipdate", "yyyy/MM/dd HH:mm:ss"))
        .when(form == 2, F.date_format("l_shipdate", "MM-dd-yyyy HH:mm:ss"))
        .when(form == 3, F.date_format("l_shipdate", "MMM d HH:mm:ss"))
        .when(form == 4, F.concat(F.lit("2024-13-45 00:00:00 "), F.date_format("l_shipdate", "yyyy/MM/dd HH:mm:ss")))
        .otherwise(F.lit(""))
    )
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("  "), stamp, body, stamp).alias("line")
    )


_LINES = {
    "stamped": """SELECT l_orderkey * 8 + l_linenumber AS pos, ' item ' || l_partkey || ' shipped ' AS body,
        CASE l_orderkey % 6 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(l_shipdate, '%Y/%m/%d %H:%M:%S')
        WHEN 2 THEN strftime(l_shipdate, '%m-%d-%Y %H:%M:%S') WHEN 3 THEN strftime(l_shipdate, '%b %-d %H:%M:%S')
        WHEN 4 THEN '2024-13-45 00:00:00 ' || strftime(l_shipdate, '%Y/%m/%d %H:%M:%S') ELSE '' END AS stamp FROM lineitem""",
    "lines": "SELECT pos, trim('  ' || stamp || body || stamp) AS line FROM stamped",
    "found": r"""SELECT pos, line,
        try_strptime(nullif(regexp_extract(line, '(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})', 1), ''), '%Y-%m-%d %H:%M:%S') AS t0,
        regexp_extract(line, '(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})', 1) AS m0,
        try_strptime(nullif(regexp_extract(line, '(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})', 1), ''), '%Y/%m/%d %H:%M:%S') AS t1,
        regexp_extract(line, '(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})', 1) AS m1,
        try_strptime(nullif(regexp_extract(line, '(\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2})', 1), ''), '%m-%d-%Y %H:%M:%S') AS t2,
        regexp_extract(line, '(\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2})', 1) AS m2,
        regexp_extract(line, '(\w{3} \d{1,2} \d{2}:\d{2}:\d{2})', 1) AS m3 FROM lines""",
}

_SP = S.SPACE


def _mask_sql(column: str) -> str:
    out = column
    for pattern, name in S.MASK_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{name}', 'g')"
    return f"array_to_string(regexp_extract_all({out}, '[^{_SP}]+'), ' ')"


_WITH = {
    "flags": r"""SELECT *, nullif(regexp_extract(message, '\|\s*([\d\.]+)\s*\|', 1), '') AS ip FROM logs_short""",
    "files": "SELECT file, bool_or(ip IS NOT NULL) AS has_ip FROM flags GROUP BY 1",
    "texts": f"""SELECT CASE WHEN has_ip THEN service || '_' || coalesce(ip, 'NA') ELSE service END AS instance_id,
        "timestamp", pos, message, ip, {_mask_sql('message')} AS text FROM flags JOIN files USING (file)""",
    "dictionary": """SELECT text, min(pos) AS pos, row_number() OVER (ORDER BY min(pos), text) - 1 AS template_id FROM texts GROUP BY text""",
    "assigned": """SELECT t.*, b.template_id FROM texts t JOIN (SELECT a.text, arg_min(d.template_id, (-sim, d.template_id)) AS template_id
        FROM (SELECT m.text, x.template_id, list_sum([CAST(p[1] = p[2] AS INTEGER) FOR p IN list_zip(string_split(m.text, ' '), string_split(x.text, ' '))])
            / len(string_split(m.text, ' ')) AS sim FROM dictionary m JOIN dictionary x
            ON len(string_split(m.text, ' ')) = len(string_split(x.text, ' '))) a JOIN dictionary d USING (template_id)
        WHERE sim >= 0.4 GROUP BY a.text) b USING (text)""",
    "counts": """SELECT instance_id, time_bucket(INTERVAL '30 days', "timestamp", TIMESTAMP '1970-01-01') AS "timestamp",
        'template_' || template_id AS feature, count(*) AS value FROM assigned GROUP BY 1, 2, 3""",
    "dense": """SELECT w.instance_id, w."timestamp", o.feature, coalesce(c.value, 0) AS value
        FROM (SELECT DISTINCT instance_id, "timestamp" FROM counts) w
        JOIN (SELECT DISTINCT instance_id, feature FROM counts) o ON w.instance_id = o.instance_id
        LEFT JOIN counts c ON c.instance_id = w.instance_id AND c."timestamp" = w."timestamp" AND c.feature = o.feature""",
    "merged": f"""SELECT instance_id, "timestamp", CASE WHEN total < {RARE_BELOW} THEN 'RARE_TEMPLATES' ELSE feature END AS feature,
        CAST(sum(value) AS BIGINT) AS value FROM dense JOIN (SELECT instance_id, feature, sum(value) AS total FROM dense GROUP BY 1, 2)
        USING (instance_id, feature) GROUP BY 1, 2, 3""",
}


# the sequential rule itself, on (pos, text): the distinct messages of a length in order, each looks at the templates so far
_LEADERS = """w AS (SELECT len(t) AS n, row_number() OVER (PARTITION BY len(t) ORDER BY pos, text) AS k, pos, text, t
            FROM (SELECT text, min(pos) AS pos, string_split(text, ' ') AS t FROM m WHERE text <> '' GROUP BY text)),
        r AS (SELECT DISTINCT n, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(t VARCHAR[], pos BIGINT)[]) AS found FROM w
            UNION ALL SELECT w.n, w.k, CASE WHEN len(list_filter(found, lambda x:
                list_sum([CAST(p[1] = p[2] AS INTEGER) FOR p IN list_zip(x.t, w.t)]) / w.n >= 0.4)) > 0 THEN found
                ELSE list_append(found, {'t': w.t, 'pos': w.pos}) END FROM r JOIN w ON w.n = r.n AND w.k = r.k + 1),
        opened AS (SELECT u.pos AS pos, array_to_string(u.t, ' ') AS text
            FROM (SELECT unnest(arg_max(found, k)) AS u FROM r GROUP BY n))"""


def _sql(body: str, upto: str) -> str:
    names = list(_WITH)
    return with_sql("logs_short", body, {n: _WITH[n] for n in names[: names.index(upto) + 1]})


QUERIES = {
    "parse_log_line": lambda s, d: S.parse_log_lines(_line_rows(s, d)).drop("line"),
    "log_instance_id": lambda s, d: L.with_instance(logs_short(s, d)).select("pos", "ip", "instance_id"),
    "mask_message": lambda s, d: T.with_text(logs_long(s, d)).select("pos", "text"),
    "mask_message_short": lambda s, d: T.with_text(logs_short(s, d)).select("pos", "text"),
    "mine_templates": lambda s, d: T.mine_templates(T.with_text(logs_short(s, d))).select("template_id", "pos", "text"),
    "mine_templates_documents": lambda s, d: T.mine_templates(T.with_text(logs_long(s, d))).select("template_id", "pos", "text"),
    "mine_templates_parts": lambda s, d: T.mine_templates(T.with_text(_parts(s, d))).select("template_id", "pos", "text"),
    "mine_templates_by_day": _by_day,
    "assign_templates": lambda s, d: _assigned(s, d).select("pos", "instance_id", "template_id"),
    "template_counts": lambda s, d: _counts(s, d),
    "merge_rare": lambda s, d: L.merge_rare(_counts(s, d), RARE_BELOW),
    "template_stats": lambda s, d: rounded(L.template_statistics(L.merge_rare(_counts(s, d), RARE_BELOW))),
    "template_text": _template_text,
    "row_position": lambda s, d: with_ordinal(
        logs_short(s, d).select("pos").distinct(), [], ["pos"], block_chunk("pos", 8192), "row_no"
    ),
}

ORACLE = {
    "parse_log_line": with_sql(
        "",
        """SELECT pos, coalesce(t0, t1, t2) AS "timestamp", coalesce(t0, t1, t2) IS NOT NULL AS ts_ok,
        trim(CASE WHEN t0 IS NOT NULL THEN replace(line, m0, '') WHEN t1 IS NOT NULL THEN replace(line, m1, '')
        WHEN t2 IS NOT NULL THEN replace(line, m2, '') WHEN m3 <> '' THEN replace(line, m3, '') ELSE line END) AS message FROM found""",
        _LINES,
    ),
    "log_instance_id": _sql("SELECT pos, ip, instance_id FROM texts", "texts"),
    "mask_message": f"""SELECT doc_id * 1000000 + i - 1 AS pos, {_mask_sql('line')} AS text FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "mask_message_short": _sql("SELECT pos, text FROM texts", "texts"),
    # any two messages of one length share all tokens but the status, so the first of
    # each length is the template
    "mine_templates": _sql(
        """SELECT row_number() OVER (ORDER BY pos, text) - 1 AS template_id, pos, text FROM (
        SELECT min(pos) AS pos, arg_min(text, (pos, text)) AS text FROM dictionary GROUP BY len(string_split(text, ' ')))""",
        "dictionary",
    ),
    "mine_templates_documents": f"""WITH RECURSIVE m AS (SELECT doc_id * 1000000 + i - 1 AS pos, {_mask_sql('line')} AS text FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
        {_LEADERS}
        SELECT row_number() OVER (ORDER BY pos, text) - 1 AS template_id, pos, text
        FROM (SELECT pos, text FROM opened UNION ALL SELECT pos, text FROM m WHERE text = '')""",
    "mine_templates_parts": f"""WITH RECURSIVE m AS (SELECT {_mask_sql('message')} AS text, pos FROM (SELECT p_partkey AS pos,
        p_name || ' ' || p_type || CASE WHEN p_partkey % 2 = 1 THEN ' ' || p_brand ELSE '' END AS message FROM part)),
        {_LEADERS}
        SELECT row_number() OVER (ORDER BY pos) - 1 AS template_id, pos, text FROM opened""",
    "assign_templates": _sql("SELECT pos, instance_id, template_id FROM assigned", "assigned"),
    "template_counts": _sql('SELECT instance_id, "timestamp", feature, value FROM dense', "dense"),
    "merge_rare": _sql('SELECT instance_id, "timestamp", feature, value FROM merged', "merged"),
    "template_stats": _sql(
        """SELECT instance_id, feature, CAST(sum(value) AS DOUBLE) AS total_frequency, round(avg(value), 6) AS mean_frequency,
        CAST(max(value) AS DOUBLE) AS max_frequency, count(*) FILTER (value > 0) AS non_zero_count FROM merged GROUP BY 1, 2""",
        "merged",
    ),
    "template_text": _sql(
        """SELECT a.pos, a.tid AS template_id, coalesce(d.text, 'TEMPLATE_' || a.tid) AS template_text
        FROM (SELECT pos, template_id + pos % 2 * 100 AS tid FROM assigned) a LEFT JOIN dictionary d ON d.template_id = a.tid""",
        "assigned",
    ),
    "row_position": with_sql(
        "logs_short", "SELECT pos, row_number() OVER (ORDER BY pos) AS row_no FROM (SELECT DISTINCT pos FROM logs_short)"
    ),
}
# three runs in turn give what one run gives
ORACLE["mine_templates_by_day"] = ORACLE["mine_templates_parts"]
