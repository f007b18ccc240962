"""Operator 10, personal data by weak supervision. DataFrame functions only.

Base spans come from fixed patterns and checks and always stay. Looser patterns propose further
spans. Labelers look at every span, base or proposed, and vote for, against or not at all:

* ``strict``: the span is a base span;
* ``check``: its digits or parts pass the kind's arithmetic;
* ``gazetteer``: its ending, calling code or issuer is in a list of known ones;
* ``context``: words before it name the kind;
* ``number``: words before it name another kind of number.

Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability
by kind, and from them each pattern's probability. A logistic regression on votes and kind is
fitted to these probabilities; it becomes a column expression and decides on the proposals.

Counts are summed by Spark over all spans; as five labelers with three votes and four kinds
have at most 972 patterns, what the driver sees is bounded. The text is read once; the spans of
each text are stored, with their votes, and read for counting and for the result.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootscope.llm.common import ascii_lower, whole_text
from rootscope.session import materialise

KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["strict", "check", "gazetteer", "context", "number"]

# The patterns of the base spans, written so that a match is never retried from inside a run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Proposals: spelled-out addresses, long addresses, spaced or failing cards, numbers without a plus.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[a-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9+.-])(?<![0-9+] )\(?[0-9]{3,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])(?! [0-9])",
}
TRIGGER = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_TRIGGER = {
    "email": r"(?i)[\[(]at[\])]", "ip": r"(?i)[0-9a-f]:[0-9a-f]", "card": TRIGGER["card"], "phone": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-]",
}

# fixed values: known endings, calling codes, issuers, and words by which texts name a kind
ENDINGS = r"\.(?:com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|eu|uk|us|ca|au|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|pt|br|mx|ar|jp|cn|in|ru)$"
CODES = r"^\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]?"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6)"
CUES = {
    "email": r"e-?mail|mailto|contact|write|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|adresse|direcci",
    "card": r"card|visa|master|amex|credit|carte|karte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|cell|whatsapp|anruf|llam|appel",
}
OTHER_NUMBER = r"(?:version|release|isbn|issn|doi|invoice|order|token|serial|build|page)[ :#=\"]*$"
BEFORE = 30


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    digits = F.reverse(_digits(text))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _octets(text: Column) -> Column:
    part = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False))
    return F.forall(F.split(text, r"\."), part)


def _dialled(text: Column) -> Column:
    return F.length(_digits(text)).between(9, 15)


CHECK = {"email": lambda t: F.length(t) <= 254, "ip": _octets, "card": _luhn, "phone": _dialled}
BASE_CHECK = CHECK | {"email": lambda t: F.lit(True)}
GAZETTEER = {
    "email": lambda t: ascii_lower(t).rlike(ENDINGS),
    "ip": lambda t: ~t.rlike(r"^(?:0|127|255)\."),
    "card": lambda t: t.rlike(ISSUERS),
    "phone": lambda t: t.rlike(CODES),
}


def _found(text: Column, pattern: str, trigger: str) -> Column:
    """Matches as ``(start, end, text)`` in code points: what stands between them gives the places."""
    between = F.split(text, pattern, -1)
    steps = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        between,
        lambda m, g: F.struct(F.length(g).alias("skip"), F.length(m).alias("size"), m.alias("text")),
    )
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(seen: Column, step: Column) -> Column:
        first = seen["at"] + step["skip"]
        last = first + step["size"]
        span = F.struct(first.alias("start"), last.alias("end"), step["text"].alias("text"))
        return F.struct(last.alias("at"), F.concat(seen["spans"], F.array(span)).alias("spans"))

    matched = F.filter(steps, lambda s: s["text"].isNotNull())
    return F.when(text.rlike(trigger), F.aggregate(matched, start, add, lambda x: x["spans"])).otherwise(none)


def _vote(good: Column | None = None, bad: Column | None = None) -> Column:
    vote = F.lit(0)
    if bad is not None:
        vote = F.when(bad, -1).otherwise(vote)
    return F.when(good, 1).otherwise(vote) if good is not None else vote


def _voted(kind: str, spans: Column, text: Column, base: bool) -> Column:
    """Spans with one vote of each labeler."""

    def votes(s: Column) -> Column:
        first = F.greatest(s["start"] - BEFORE, F.lit(0))
        before = F.lower(F.substring(text, first + 1, s["start"] - first))
        check, known = CHECK[kind](s["text"]), GAZETTEER[kind](s["text"])
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(1 if base else 0).alias("strict"),
            _vote(check, ~check).alias("check"),
            _vote(known, ~known).alias("gazetteer"),
            _vote(before.rlike(CUES[kind])).alias("context"),
            _vote(None, before.rlike(OTHER_NUMBER)).alias("number"),
        )

    return F.transform(spans, votes)


def _passing(kind: str):
    return lambda span: BASE_CHECK[kind](span["text"])


def _apart_from(base: Column):
    return lambda span: ~F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def _accepted(model: SpanClassifier, kind: str):
    return lambda span: model.accepts(kind, span)


def _named(kind: str):
    return lambda span: F.concat_ws(":", F.lit(kind), span["start"].cast("string"), span["end"].cast("string"))


def find_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, and for each kind ``base_<kind>`` and ``more_<kind>``: spans with their votes."""
    rows = docs.select(*keep, whole_text().alias("text"))
    text = F.col("text")
    for kind in KINDS:
        rows = rows.withColumn(f"b_{kind}", F.filter(_found(text, BASE[kind], TRIGGER[kind]), _passing(kind)))
        rows = rows.withColumn(f"m_{kind}", _found(text, LOOSE[kind], LOOSE_TRIGGER[kind]))
    # of one kind, a proposal that meets a base span is dropped
    for kind in KINDS:
        rows = rows.withColumn(f"m_{kind}", F.filter(f"m_{kind}", _apart_from(F.col(f"b_{kind}"))))
    return rows.select(
        *keep,
        *[_voted(k, F.col(f"b_{k}"), text, True).alias(f"base_{k}") for k in KINDS],
        *[_voted(k, F.col(f"m_{k}"), text, False).alias(f"more_{k}") for k in KINDS],
    )


Votes = tuple[int, ...]


def reliabilities(counts: dict[tuple[str, Votes], float], steps: int = 50) -> dict[tuple[str, Votes], float]:
    """Probability of each (kind, votes) that the span is personal data, by expectation-maximisation.

    Labelers are taken as independent given the truth. The start trusts the majority of votes.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([v for _, v in keys], int).reshape(len(keys), len(LABELERS))
    p = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    kinds = np.array([KINDS.index(k) for k, _ in keys])
    for _ in range(steps):
        log_odds = np.zeros(len(keys))
        for kind in range(len(KINDS)):
            here = kinds == kind
            if not here.any():
                continue
            good, bad = n[here] * p[here], n[here] * (1 - p[here])
            log_odds[here] = math.log((good.sum() + 1) / (bad.sum() + 1))
            for j in range(len(LABELERS)):
                for vote in (-1, 0, 1):
                    cast = votes[here, j] == vote
                    # a labeler starts out a little better than chance, so that classes keep their meaning
                    lean = 4 + 3 * vote, 4 - 3 * vote
                    ratio = math.log((good[cast].sum() + lean[0]) / (good.sum() + 12)) - math.log(
                        (bad[cast].sum() + lean[1]) / (bad.sum() + 12)
                    )
                    log_odds[np.flatnonzero(here)[cast]] += ratio
        p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return dict(zip(keys, p.tolist()))


class SpanClassifier:
    """Logistic weights of kinds and of (labeler, vote)."""

    def __init__(self, kinds: dict[str, float], votes: dict[tuple[str, int], float]):
        self.kinds, self.votes = kinds, votes

    @classmethod
    def fit(cls, counts: dict[tuple[str, Votes], float], steps: int = 3000) -> SpanClassifier:
        soft = reliabilities(counts)
        keys = sorted(counts)
        names = [*KINDS, *product(LABELERS, (-1, 0, 1))]
        x = np.zeros((len(keys), len(names)))
        for i, (kind, votes) in enumerate(keys):
            x[i, KINDS.index(kind)] = 1
            for labeler, vote in zip(LABELERS, votes):
                x[i, names.index((labeler, vote))] = 1
        y = np.array([soft[k] for k in keys])
        n = np.array([math.log1p(counts[k]) for k in keys])
        w = np.zeros(len(names))
        for _ in range(steps if len(keys) else 0):
            off = n * (1 / (1 + np.exp(-x @ w)) - y)
            w -= (x.T @ off + 0.01 * w) / (n.sum() * 1.5 + 0.01)
        weight = dict(zip(names, w.tolist()))
        return cls({k: weight[k] for k in KINDS}, {k: weight[k] for k in names[len(KINDS) :]})

    def accepts(self, kind: str, span: Column) -> Column:
        total = F.lit(self.kinds[kind])
        for labeler in LABELERS:
            vote = span[labeler]
            total = total + F.when(vote > 0, self.votes[(labeler, 1)]).when(vote < 0, self.votes[(labeler, -1)]).otherwise(
                self.votes[(labeler, 0)]
            )
        return total > 0


def learn_spans(found: DataFrame) -> SpanClassifier:
    counted = None
    for column in [f"{side}_{k}" for k in KINDS for side in ("base", "more")]:
        rows = found.select(F.lit(column.split("_")[1]).alias("kind"), F.explode(column).alias("s")).select("kind", "s.*")
        counted = rows if counted is None else counted.unionByName(rows)
    counts = counted.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    return SpanClassifier.fit({(r["kind"], tuple(r[x] for x in LABELERS)): float(r["n"]) for r in counts})


def _listed(parts: list[Column]) -> Column:
    return F.concat_ws(",", F.flatten(F.array(*parts)))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` of every row.

    Counts and checksum are of the base spans; ``spans`` holds those and accepted proposals, as
    ``kind:start:end`` in code points, by kind and start. A null or empty text has none. Repeated
    rows give repeated results; an empty table gives no rows; other columns are not read.
    """
    found = materialise(find_spans(docs, ["doc_id"]), "spans")
    model = learn_spans(found)
    base, all_ = [], []
    for kind in KINDS:
        added = F.filter(f"more_{kind}", _accepted(model, kind))
        both = F.array_sort(F.concat(F.col(f"base_{kind}"), added))
        base.append(F.transform(f"base_{kind}", _named(kind)))
        all_.append(F.transform(both, _named(kind)))
    return found.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(all_).alias("spans"),
    )
