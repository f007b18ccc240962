"""Row-wise rules as native column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that Python's str.split() treats as white space, as a
# Java character class.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# the ASCII part of it
ASCII_SPACE = r"\t-\r\x1c-\x20"

# Message masking rules, applied in this order.
MASK_RULES = [
    (r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2} \p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}", "<TIMESTAMP>"),
    (r"\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+", "<IP>"),
    (r"\p{Nd}+", "<NUM>"),
    (
        r"[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}",
        "<UUID>",
    ),
]

# what every match of a rule holds
_MASK_HOLDS = ["-:", ".", "", ""]

# Time stamps looked for in a text log line, in this order, with the
# groups that make up an ISO date and time.
LINE_TIME_RULES = [
    (r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", r"^(\d{4})-(\d{2})-(\d{2}) (.*)$", "$1-$2-$3 $4"),
    (r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})", r"^(\d{4})/(\d{2})/(\d{2}) (.*)$", "$1-$2-$3 $4"),
    (r"(\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2})", r"^(\d{2})-(\d{2})-(\d{4}) (.*)$", "$3-$1-$2 $4"),
]
# fixed value: the time stamp of syslog lines, which has no year
SYSLOG_TIME = r"([\p{L}\p{Nd}_]{3} \d{1,2} \d{2}:\d{2}:\d{2})"

# fixed value: how a message names an address
LOG_IP = r"\|\s*([\d\.]+)\s*\|"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of an event time (wall time in UTC)."""
    return F.unix_seconds(_col(ts).cast("timestamp"))


def epoch_micros(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def seconds_to_ts(seconds: Column | str) -> Column:
    """Epoch seconds (fractions kept to the microsecond) to event time."""
    micros = F.round(_col(seconds).cast("double") * 1e6).try_cast("bigint")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def missing_to_null(c: Column | str) -> Column:
    """NaN is how the input files spell "missing"; the library only knows NULL."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def time_floor(ts: Column | str, seconds: int = 60) -> Column:
    """Start of the sampling interval a time falls in."""
    return F.window(_col(ts), f"{int(seconds)} seconds").getField("start")


def ts_normalise(raw: Column | str, tz: str = "UTC") -> Column:
    """Time stamp of a span: epoch seconds, epoch milliseconds (above 1e12) or text.

    Zero, blank and unreadable values give NULL.  Numbers written as text count as
    numbers.  ``tz`` shifts numbers to the wall time of a zone.
    """
    raw = _col(raw)
    number = missing_to_null(raw.try_cast("double"))
    micros = F.when(number > 1e12, number * 1e3).otherwise(number * 1e6)
    moment = F.timestamp_micros(F.round(micros).try_cast("bigint"))
    if tz != "UTC":
        moment = F.from_utc_timestamp(moment, tz)
    text = F.try_to_timestamp(raw.cast("string")).cast("timestamp_ntz")
    return F.when(number != 0, moment.cast("timestamp_ntz")).when(number.isNull(), text)


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def parse_log_lines(lines: DataFrame, column: str = "line", year: int | None = None) -> DataFrame:
    """Adds ``timestamp``, ``message`` and ``ts_ok``; blank lines are dropped.

    The first pattern that matches and reads as a date wins; every copy of the
    matched text is removed.  A syslog stamp has no year: it is removed too, but only
    read when ``year`` is given.  The steps are columns of their own so that no pattern
    runs twice.
    """
    staged = lines.withColumn("_line", strip(column)).where(F.col("_line") != "")
    texts = [F.regexp_extract("_line", pattern, 1) for pattern, _, _ in LINE_TIME_RULES]
    syslog = F.nullif(F.regexp_extract("_line", SYSLOG_TIME, 1), F.lit(""))
    staged = staged.withColumns({**{f"_m{i}": t for i, t in enumerate(texts)}, "_syslog": syslog})
    # a cast reads ISO text without the cost of failed format parsing
    times = {
        f"_t{i}": F.regexp_replace(f"_m{i}", parts, iso).try_cast("timestamp_ntz")
        for i, (_, parts, iso) in enumerate(LINE_TIME_RULES)
    }
    staged = staged.withColumns(times)
    count = range(len(LINE_TIME_RULES))
    matched = F.coalesce(*[F.when(F.col(f"_t{i}").isNotNull(), F.col(f"_m{i}")) for i in count], "_syslog")
    moments = [F.col(f"_t{i}") for i in count]
    if year is not None:
        spaced = F.concat(F.lit(f"{year} "), F.col("_syslog"))
        moments.append(F.try_to_timestamp(spaced, F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz"))
    staged = staged.withColumns({"timestamp": F.coalesce(*moments), "_matched": matched})
    rest = strip(F.replace(F.col("_line"), F.col("_matched"), F.lit("")))
    helpers = ["_line", "_syslog", "_matched", *[f"_m{i}" for i in count], *times]
    return staged.withColumns(
        {"message": F.coalesce(rest, "_line"), "ts_ok": F.col("timestamp").isNotNull()}
    ).drop(*helpers)


def _once(value: Column, rule) -> Column:
    """``rule(value)`` with the value computed once, however often the rule names it.

    The optimizer copies column definitions into filters; a lambda keeps long chains
    from being copied many times over.
    """
    return F.element_at(F.transform(F.array(value), rule), 1)


def _mask(message: Column) -> Column:
    def rule(pattern: str, name: str, holds: str):
        def apply(text: Column) -> Column:
            masked = F.regexp_replace(text, pattern, name)
            return F.when(reduce(and_, [text.contains(c) for c in holds]), masked).otherwise(text) if holds else masked

        return apply

    stamps, addresses, numbers, ids = [rule(*r, holds) for r, holds in zip(MASK_RULES, _MASK_HOLDS)]
    masked = numbers(_once(_once(message, stamps), addresses))
    return _once(F.when(message.rlike(r"\p{Nd}"), masked).otherwise(message), lambda text: F.when(text.like("%-%-%-%-%"), ids(text)).otherwise(text))


def mask_message(message: Column | str) -> Column:
    """Time stamps, addresses, numbers and ids replaced by their names.

    Rules that need a digit, or the marks of a time, an address or an id, are skipped where there is none.
    """
    return _once(_col(message), _mask)


def tokens(message: Column | str) -> Column:
    return F.regexp_extract_all(_col(message), F.lit(f"[^{SPACE}]+"), F.lit(0))


def _blanks(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)
    short = F.regexp_replace(text, f"[{ASCII_SPACE}]+", " ")
    return F.when(ascii_only, short).otherwise(F.regexp_replace(text, f"[{SPACE}]+", " "))


def masked_text(message: Column | str) -> Column:
    """Masked tokens joined by one blank: equal token lists have equal text.

    Plain ASCII text takes a shorter class of white space.
    """
    return F.trim(_once(mask_message(message), _blanks))


def log_ip(message: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(message), LOG_IP, 1), F.lit(""))


def date_to_epoch(day: Column | str, tz: str = "UTC") -> Column:
    moment = F.to_timestamp(_col(day), "yyyy-MM-dd")
    return F.unix_seconds(F.to_utc_timestamp(moment, tz))


def error_rate(errors: Column | str, requests: Column | str) -> Column:
    return F.coalesce(F.try_divide(_col(errors), _col(requests)), F.lit(0.0))


# --- spans -----------------------------------------------------------------------


def _first_tag(tags: Column, names: list[str]) -> list[Column]:
    return [F.try_element_at(tags, F.lit(name)) for name in names]


def span_service(service: Column, process_service: Column, process_tags: Column, tags: Column) -> Column:
    return F.coalesce(
        F.nullif(service, F.lit("")),
        process_service,
        *_first_tag(process_tags, ["service.name"]),
        *_first_tag(tags, ["service.name", "service", "component"]),
        F.lit("unknown"),
    )


def span_instance(
    service: Column, process_tags: Column, tags: Column, direct: list[Column] | None = None
) -> Column:
    """``direct`` lists instance columns of the span itself, tried first when given."""
    return F.coalesce(
        *[F.nullif(c.cast("string"), F.lit("")) for c in direct or []],
        *_first_tag(process_tags, ["hostname", "host.name", "instance_id"]),
        *_first_tag(tags, ["hostname", "host.name", "instance_id", "pod.name"]),
        F.concat(service, F.lit("_instance")),
    )


def span_status(status: Column, tags: Column) -> Column:
    """Status as text; ``200.0`` and ``200`` are the same status."""
    raw = F.coalesce(
        status.cast("string"),
        *_first_tag(tags, ["http.status_code", "status_code", "response.status"]),
        F.lit("200"),
    )
    whole = raw.try_cast("double").try_cast("int")
    return F.coalesce(whole.cast("string"), raw)


def span_is_error(status: Column, tags: Column) -> Column:
    flag = F.lower(F.coalesce(*_first_tag(tags, ["error"]), F.lit("")))
    return status.rlike("^[45]") | ~flag.isin("", "0", "0.0", "false", "none", "null")


# Words looked for in an operation name or a component tag.
REQUEST_WORDS = {
    "operation": [("http", ["http", "get", "post"]), ("rpc", ["rpc"]), ("db", ["db", "sql", "database"])],
    "component": [("http", ["http"]), ("rpc", ["rpc"]), ("db", ["sql", "db"])],
}


def _by_words(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    out = None
    for kind, words in rules:
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def span_request_type(operation: Column, tags: Column) -> Column:
    component = F.lower(F.coalesce(*_first_tag(tags, ["component"]), F.lit("")))
    return F.coalesce(
        _by_words(F.lower(F.coalesce(operation, F.lit(""))), REQUEST_WORDS["operation"]),
        _by_words(component, REQUEST_WORDS["component"]),
        F.lit("unknown"),
    )


def span_duration(duration: Column, start: Column, end: Column) -> Column:
    elapsed = (epoch_micros(end) - epoch_micros(start)) / 1000.0
    return F.coalesce(missing_to_null(duration.cast("double")), elapsed, F.lit(0.0))
