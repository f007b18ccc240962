"""Operator 12, URL filters: host suffixes and path prefixes looked up by short hash prefixes. DataFrame functions only.

A rule names a host and the beginning of a path. It is filed under its host with the part of its
path that ends at the last slash. A URL is expanded into the expressions it could be filed
under: each run of last labels of its host with each part of its path that ends at a slash. Rules
say how many labels and slashes are needed; longer expressions match none and are not made.

Expressions meet rules on the first 32 bits of their SHA-256, then the full digest and the rest of
the rule's path are confirmed. Of the rules that fit the longest wins; its precedence is one number, so
that the best rule of a URL is a maximum, taken before the shuffle as well as after it.

The rules are stored first: Spark knows their exact size, sends them to all tasks when that size allows
it and otherwise deals both sides out, splitting a hash prefix that a third of all URLs share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootscope.llm.common import ascii_lower, whole_text
from rootscope.session import materialise

#: The production rules: host, path, action.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: What holds where no rule fits.
DEFAULT = "allow"
PREFIX_HEX = 8
#: Precedence: characters of the rule, then characters of its host, then block before allow.
_LENGTH, _HOST = 2**32, 2


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as a table ``host``, ``path``, ``action``."""
    schema = "array<struct<host:string,path:string,action:string>>"
    listed = F.array(*[F.struct(*[F.lit(v) for v in rule]) for rule in rules]).cast(schema)
    return spark.range(1).select(F.inline(listed))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/")))


def _first_parts(text: Column, mark: str, n: Column) -> Column:
    """What stands before the nth mark; of negative numbers, after the nth mark from the end."""
    return F.call_function("substring_index", text, F.lit(mark), n)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, folder), 256)


def _filed(rules: DataFrame) -> DataFrame:
    """Rules that can fit a URL, with the digest that they are filed under and their precedence."""
    host = ascii_lower(F.col("host"))
    folder = F.regexp_extract("path", r"^([^?#]*/)?", 0)
    can_fit = ~host.rlike("[/?#]") & (F.col("path").rlike("^/[^?#]*$") | (F.col("path") == ""))
    rank = (F.length(host) + F.length("path")).cast("bigint") * _LENGTH + F.length(host) * _HOST
    rows = rules.where("action IN ('allow', 'block')").where(can_fit).select(
        _digest(host, folder).alias("rule_digest"),
        F.col("path").alias("rule_path"),
        (rank + (F.col("action") == "block").cast("int")).alias("rank"),
        _labels(host).alias("labels"),
        _slashes(F.col("path")).alias("slashes"),
    )
    return rows.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))


def _expressions(labels: int, slashes: int) -> Column:
    """Digests of the host's last 1 to ``labels`` labels with its path up to 0 to ``slashes`` slashes."""

    def up_to(limit: int, least: int, count: Column) -> Column:
        most = F.least(F.lit(limit), count)
        return F.when(most >= least, F.sequence(F.lit(least), most)).otherwise(F.array().cast("array<int>"))

    def part(path: Column, n: Column) -> Column:
        return F.when(n == 0, "").otherwise(F.concat(_first_parts(path, "/", n), F.lit("/")))

    hosts = F.transform(up_to(labels, 1, _labels(F.col("host"))), lambda n: _first_parts(F.col("host"), ".", -n))
    folders = F.transform(up_to(slashes, 0, _slashes(F.col("path"))), lambda n: part(F.col("path"), n))
    return F.flatten(F.transform(hosts, lambda h: F.transform(folders, lambda f: _digest(h, f))))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every row of ``pages``.

    The host stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    the path after it up to ``?``, ``#`` or the end. A null URL and one without ``://`` have an empty host
    and path. A rule (``host``, ``path``, ``action`` of ``allow`` or ``block``) fits its host and all
    subdomains if the path of the URL starts with the rule's; an empty path starts with the empty one
    only. The longest rule wins, host and path counted together; of equal length the one with the longer host; of
    equal rules block. Without a fitting rule ``rule`` is null and ``default`` holds. Rules with
    a null or another action fit nothing. Repeated rows are judged alike, each gives a row; empty tables
    of pages give no rows, empty tables of rules leave all to ``default``. Other columns are not read.
    """
    filed = materialise(_filed(rules), "url-rules")
    labels, slashes = filed.agg(F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.max("slashes"), F.lit(0))).first()
    host, path = host_and_path(whole_text("url"))
    key = ["row", "page_id", "host", "path"]
    urls = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"))
    tried = urls.select(*key, F.explode_outer(_expressions(labels, slashes)).alias("digest"))
    tried = tried.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    near = filed.select("prefix", "rule_digest", "rule_path", "rank")
    met = tried.join(near, "prefix", "left").withColumn("rank", F.when(fits, F.col("rank")))
    best = met.groupBy(*key).agg(F.max("rank").alias("rank"))
    size = F.floor(F.col("rank") / F.lit(_LENGTH)).cast("int")
    of_host = F.floor(F.pmod("rank", F.lit(_LENGTH)) / F.lit(_HOST)).cast("int")
    text = F.concat(F.when(of_host == 0, "").otherwise(F.substr("host", -of_host)), F.left("path", size - of_host))
    verdict = F.when(F.pmod("rank", F.lit(_HOST)) == 1, "block").otherwise("allow")
    return best.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("rank").isNotNull(), text).alias("rule"),
        F.when(F.col("rank").isNull(), F.lit(default)).otherwise(verdict).alias("verdict"),
    )


def filter_pages(pages: DataFrame) -> DataFrame:
    """``judge_urls`` with the production rules."""
    return judge_urls(pages, rule_table(pages.sparkSession))


_VALUES = ", ".join(str(rule) for rule in RULES)
URL_SQL = rf"""
WITH rules(h, p, action) AS (VALUES {_VALUES}),
r AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT k, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
    FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, '{DEFAULT}') AS verdict FROM u LEFT JOIN f USING (k)
"""
