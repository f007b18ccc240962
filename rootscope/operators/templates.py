"""Log template mining: the sequential leader rule, in parallel and exact.

The rule reads messages in order; a message joins the template of equal length that
shares the largest part of its tokens by position (at least ``sim_th``, oldest on a
tie) or opens a new one.  What makes it parallel:

* only the first copy of a distinct message can open a template, and messages of
  different length never meet;
* once the templates opened before some position are known, every message they match
  can be struck out at once.  So each round takes the first undecided messages per
  length, runs the rule on them, and strikes out all matches of the
  new templates on the whole table.  The order of decisions is the order of the rule;
* a round takes as many messages of a length as one task holds (``LARGEST_BATCH``, ``LARGEST_TOKENS``), or twice as
  many as the round before if the caller asks for fewer at first.

Messages and templates meet by an index: where k of n tokens are equal, all tokens of one of a few small sets of
positions are (``position_sets``).  Two or three tokens together are rare even if each is frequent, so few
pairs meet that do not match.  One path at every size; Spark sends a small index to all tasks and deals a large one
out.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootscope.functions.scalars import masked_text
from rootscope.operators.spread import block_chunk, with_ordinal
from rootscope.session import discard, materialise, materialise_at, scratch_path

SIM_TH = 0.4
# the most undecided messages, and tokens of them, that a round takes per length
LARGEST_BATCH = 1 << 20
LARGEST_TOKENS = 1 << 24
# messages in the first step of a task, how much steps grow, and the largest
_STEP, _STEPS_GROW, _LARGEST_STEP = 1000, 8, 65_536
# numbers that a matrix of keys or tokens of pairs holds at most
_NUMBERS = 1 << 22
# steps of the histogram of positions per doubling
_FINE = 16


def with_text(logs: DataFrame) -> DataFrame:
    """Adds ``text``, the masked tokens joined by a blank.  NULL messages are dropped."""
    return logs.where(F.col("message").isNotNull()).withColumn("text", masked_text("message"))


def token_count(text: str) -> Column:
    """Number of tokens; an empty text has none."""
    blanks = F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit("")))
    return F.when(F.col(text) == "", 0).otherwise(blanks + 1)


def scoped(rows: DataFrame) -> DataFrame:
    """Rows with a ``scope``: messages of different scopes never meet (default: one scope)."""
    return rows if "scope" in rows.columns else rows.withColumn("scope", F.lit(""))


def distinct_messages(rows: DataFrame) -> DataFrame:
    """``(scope, text, n, pos)``: distinct messages at their first position; ``n`` is 0 for empty."""
    return scoped(rows).groupBy("scope", "text").agg(F.min("pos").alias("pos")).withColumn("n", token_count("text"))


def named(messages: DataFrame) -> DataFrame:
    """Messages stored with a number ``mid``; positions may tie."""
    return materialise(messages.withColumn("mid", F.monotonically_increasing_id()), "messages")


# --- leader rule on one bounded batch --------------------------------------------


def enough(n: int, sim_th: float) -> int | None:
    """The least number k of equal tokens, of ``n``, with k / n >= ``sim_th``; none if all are too few."""
    near = int(n * sim_th)
    return next((k for k in (near - 1, near, near + 1) if 1 <= k <= n and k / n >= sim_th), None)


@lru_cache(256)
def position_sets(n: int, k: int) -> list[np.ndarray]:
    """Sets of positions such that, where k of n tokens are equal, all tokens of one set are; matrices, a set a row.

    With m blocks of positions and (t - 1) * m < k one block has t equal tokens: the sets are all t positions of a
    block.  t is 3 or 2 unless that makes too many sets, else single positions do.
    """
    for together in (3, 2):
        blocks = (k - 1) // (together - 1)
        if blocks:
            sizes = [len(range(b, n, blocks)) for b in range(blocks)]
            ways = [x * (x - 1) * (x - 2) // 6 if together == 3 else x * (x - 1) // 2 for x in sizes]
            if sum(ways) <= 6 * n:
                found = [np.array(list(combinations(range(b, n, blocks), together))) for b, w in enumerate(ways) if w]
                return np.array_split(np.concatenate(found), -(-sum(ways) // 64))
    return np.array_split(np.arange(n - k + 1)[:, None], -(-(n - k + 1) // 64))


def _set_keys(spots: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """One key per row of ``spots`` and set of positions."""
    keys = np.repeat(sets.astype(np.uint64).dot(np.array([1, 1 << 20, 1 << 40][: sets.shape[1]], np.uint64))[None], len(spots), 0)
    for j in range(sets.shape[1]):
        keys = (keys ^ spots[:, sets[:, j]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _pieces(sets: list[np.ndarray], rows: int):
    """The sets, so few at a time that their keys for ``rows`` rows are a small matrix."""
    for part in sets:
        yield from np.array_split(part, min(len(part), -(-rows * len(part) // _NUMBERS)))


def _in_turn(codes: np.ndarray, k: int, sets: list[np.ndarray]) -> np.ndarray:
    """Rows that share k tokens with no such row before them."""
    rows, keys, known = [], [], 0
    for part in _pieces(sets, len(codes)):
        _, number, times = np.unique(_set_keys(codes, part), return_inverse=True, return_counts=True)
        row, at = np.nonzero((times > 1)[number := number.reshape(len(codes), -1)])
        rows.append(row)
        keys.append(number[row, at] + known)
        known += len(times)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    keys, ends = keys[order], np.searchsorted(rows[order], np.arange(len(codes) + 1))
    filed: dict[int, list[int]] = {}
    chosen = []
    for r in range(len(codes)):
        mine = keys[ends[r] : ends[r + 1]].tolist()
        met = set().union(*[filed[key] for key in mine if key in filed]) if mine else ()
        if met and ((codes[list(met)] == codes[r]).sum(axis=1) >= k).any():
            continue
        for key in mine:
            filed.setdefault(key, []).append(r)
        chosen.append(r)
    return np.array(chosen, np.int64)


def _left(codes: np.ndarray, leaders: np.ndarray, rest: np.ndarray, k: int, sets: list[np.ndarray]) -> np.ndarray:
    """Of the rows ``rest`` those that share k tokens with none of the rows ``leaders``."""
    for part in _pieces(sets, max(len(leaders), len(rest))):
        theirs = _set_keys(codes[leaders], part).ravel()
        order = np.argsort(theirs)
        theirs, whose = theirs[order], leaders[order // len(part)]
        mine = _set_keys(codes[rest], part).ravel()
        first = np.searchsorted(theirs, mine)
        times = np.searchsorted(theirs, mine, "right") - first
        ask = np.flatnonzero(times)
        upto = np.cumsum(times[ask])
        struck = np.zeros(len(rest), bool)
        size, at, done = max(1, _NUMBERS // codes.shape[1]), 0, 0
        while at < len(ask):
            end = max(at + 1, np.searchsorted(upto, done + size, "right"))
            some, n = ask[at:end], times[ask[at:end]]
            row = np.repeat(some // len(part), n)
            spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[some], n)
            fresh = np.flatnonzero(~struck[row])
            for i in range(0, len(fresh), size):
                one = fresh[i : i + size]
                like = (codes[rest[row[one]]] == codes[whose[spot[one]]]).sum(axis=1) >= k
                struck[row[one][like]] = True
            at, done = end, upto[end - 1]
        rest = rest[~struck]
    return rest


def token_codes(texts, n: int) -> np.ndarray:
    """Texts of n tokens as a matrix of numbers, equal for equal tokens."""
    tokens = pc.list_flatten(pc.split_pattern(pa.array(texts, pa.large_string()), " "))
    return tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False).reshape(-1, n)


def leader_rows(codes: np.ndarray, sim_th: float) -> np.ndarray:
    """Rows that match no leader before them, in steps like those of the rounds."""
    n = codes.shape[1]
    k = enough(n, sim_th)
    rest, found, step = np.arange(len(codes)), [], _STEP
    if k is None:
        return rest
    sets = position_sets(n, k)
    while len(rest):
        now, rest = rest[:step], rest[step:]
        new = now[_in_turn(codes[now], k, sets)]
        found.append(new)
        if len(rest):
            rest = _left(codes, new, rest, k, sets)
        step = min(step * _STEPS_GROW, _LARGEST_STEP)
    return np.concatenate(found)


def _leaders(sim_th: float):
    def lead(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["pos", "text"], kind="stable")
        chosen = leader_rows(token_codes(batch["text"], int(batch["n"].iloc[0])), sim_th)
        return batch.iloc[chosen][["scope", "text", "n", "pos", "mid"]]

    return lead


def first_undecided(undecided: DataFrame, decided: DataFrame, batch: int) -> DataFrame:
    """``(scope, n, cut)``: per length the position up to which about ``batch`` messages are undecided.

    Of long messages fewer are taken, with ``LARGEST_TOKENS`` tokens in all.
    ``decided`` holds ``(scope, n, start)``: all messages up to ``start`` are decided.  Distances from it
    are counted on a log scale, so no length is sorted; a cut holds one message at least
    and more than ``batch`` only if that one stands alone.
    """
    step = F.floor(F.log2((F.col("pos") - F.col("start")).cast("double")) * _FINE)
    hist = undecided.join(decided, ["scope", "n"]).groupBy("scope", "n", step.alias("_step"))
    hist = hist.agg(F.count(F.lit(1)).alias("_in"), F.min("pos").alias("_low"), F.max("pos").alias("_high"))
    in_order = Window.partitionBy("scope", "n").orderBy("_step")
    running = F.sum("_in").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = hist.withColumn("_upto", running).withColumn("_first", F.row_number().over(in_order) == 1)
    most = F.least(F.lit(batch), F.greatest(F.lit(1), F.floor(LARGEST_TOKENS / F.col("n"))))
    # of a first step that is too full only the first message is taken
    cut = F.when(F.col("_upto") <= most, F.col("_high")).when(F.col("_first"), F.col("_low"))
    return held.groupBy("scope", "n").agg(F.max(cut).alias("cut"))


def _open_templates(undecided: DataFrame, cuts: DataFrame, sim_th: float) -> DataFrame:
    return (
        undecided.join(cuts, ["scope", "n"])
        .where(F.col("pos") <= F.col("cut"))
        .select("scope", "text", "n", "pos", "mid")
        .groupBy("scope", "n")
        .applyInPandas(_leaders(sim_th), "scope string, text string, n int, pos bigint, mid bigint")
    )


# --- matching messages with templates --------------------------------------------


def spot_keys() -> Column:
    """One key per token, from scope, length, position and token."""
    return F.transform(F.split("text", " "), lambda token, i: F.xxhash64("scope", "n", i, token))


def needed(sim_th: float) -> Column:
    """The least number k of equal tokens, of ``n``, with k / n >= ``sim_th``."""
    near = F.floor(F.col("n") * sim_th)
    enough = [F.when((k >= 1) & (k / F.col("n") >= sim_th), k) for k in (near - 1, near, near + 1)]
    return F.coalesce(*enough, near + 2)


def template_index(templates: DataFrame, sim_th: float) -> DataFrame:
    """``(key, scope, template_id)``: each template under the keys of its n-k+1 rarest tokens.

    k tokens of n have to be equal, so a message that matches shares one of these keys.  Frequent
    tokens bring few partners together.
    """
    spots = templates.select("scope", "template_id", (F.col("n") - needed(sim_th) + 1).alias("_keep"), F.explode(spot_keys()).alias("key"))
    rarity = spots.groupBy("key").agg(F.count(F.lit(1)).alias("_freq"))
    # one partition per template: as many rows as it has tokens
    rank = F.row_number().over(Window.partitionBy("scope", "template_id").orderBy("_freq", "key"))
    filed = spots.join(rarity, "key").withColumn("_rank", rank).where(F.col("_rank") <= F.col("_keep"))
    return filed.select("key", "scope", "template_id")


def equal_tokens(a: Column, b: Column) -> Column:
    pairs = F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: (x == y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def with_set_keys(rows: DataFrame, ids: list[str], sim_th: float) -> DataFrame:
    """``ids`` and ``key``, one row for each of the ``position_sets`` of a text."""
    rows = rows.select(*ids, "n", spot_keys().alias("_spots"))
    schema = rows.select(*ids).withColumn("keys", F.array(F.lit(0).cast("bigint"))).schema

    def run(batches):
        for batch in batches:
            ns = batch.column("n").to_numpy()
            for n in np.unique(ns).tolist():
                k = enough(n, sim_th)
                if k is None:
                    continue
                part = batch.filter(pa.array(ns == n))
                spots = pc.list_flatten(part.column("_spots")).to_numpy().reshape(-1, n)
                rows_at_once = max(1, _NUMBERS // (6 * n))
                for at in range(0, len(spots), rows_at_once):
                    keys = np.hstack([_set_keys(spots[at : at + rows_at_once], s) for s in position_sets(n, k)]).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                    some = part.slice(at, rows_at_once)
                    yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ids], lists], [*ids, "keys"])

    return rows.mapInArrow(run, schema).select(*ids, F.explode("keys").alias("key"))


def met_pairs(messages: DataFrame, templates: DataFrame, sim_th: float) -> DataFrame:
    """``(mid, scope, template_id)`` of all pairs that may match, each once."""
    index = materialise(with_set_keys(templates, ["scope", "template_id"], sim_th), "template-index")
    return with_set_keys(messages, ["mid"], sim_th).join(index, "key").select("mid", "scope", "template_id").distinct()


def match_pairs(messages: DataFrame, templates: DataFrame, sim_th: float) -> DataFrame:
    """``(mid, template_id, template_pos, equal)`` of all pairs over the limit.

    ``messages`` are distinct and ``named``.  What is dealt out are pairs of numbers; texts are
    looked up for pairs, and every pair is confirmed on them.
    """
    met = met_pairs(messages, templates, sim_th)
    theirs = templates.select("scope", "template_id", "n", F.col("text").alias("_template"), F.col("pos").alias("template_pos"))
    both = met.join(messages.select("mid", "scope", "n", "text"), ["mid", "scope"]).join(theirs, ["scope", "template_id", "n"])
    pairs = both.withColumn("equal", equal_tokens(F.col("text"), F.col("_template")))
    pairs = pairs.where("equal > 0").where(F.col("equal") / F.col("n") >= sim_th)
    return pairs.select("mid", "template_id", "template_pos", "equal")


# --- public operators ------------------------------------------------------------


def mine_templates(
    rows: DataFrame, sim_th: float = SIM_TH, empty: str = "own", batch: int = LARGEST_BATCH, known: DataFrame | None = None
) -> DataFrame:
    """``(scope, template_id, pos, n, text)`` from rows with ``text`` and a unique ``pos``.

    With a ``scope`` column every scope is mined on its own and numbered from 0.

    An empty message never matches, so each opens a template of its own; with
    ``empty='merge'`` they share one.

    ``known`` is the stored result of an earlier run, whose rows all lie before these
    (``positions_after`` sees to that).  It is continued: its ids stay, its templates match first, and new ones are
    numbered after them, as one run over both would.
    """
    spark = rows.sparkSession
    messages = named(distinct_messages(rows))
    undecided, at = messages.where("n > 0"), None
    found = messages.where("n = 0").drop("mid")
    if empty == "own" and not found.isEmpty():
        found = scoped(rows).where(F.col("text") == "").select("scope", "text", "pos", F.lit(0).alias("n"))
    if known is not None:
        known = materialise(scoped(known).select("scope", "template_id", "pos", "n", "text"), "known")
        if empty == "merge":
            have = known.where("n = 0").select("scope").distinct()
            found = found.join(have, "scope", "left_anti")
        met = match_pairs(undecided, known.where("n > 0"), sim_th).select("mid")
        undecided = materialise(undecided.join(met, "mid", "left_anti"), "messages")
    decided = materialise(undecided.groupBy("scope", "n").agg((F.min("pos") - 1).alias("start")), "decided")
    while True:
        cuts = materialise(first_undecided(undecided, decided, batch), "cuts")
        if cuts.isEmpty():
            break
        new = materialise(_open_templates(undecided, cuts, sim_th), "templates")
        found = found.unionByName(new.drop("mid"))
        left = undecided.join(cuts, ["scope", "n"]).where(F.col("pos") > F.col("cut")).drop("cut")
        if left.isEmpty():
            break
        # lengths without further messages are done
        wanted = new.join(left.select("scope", "n").distinct(), ["scope", "n"], "left_semi").withColumnRenamed("mid", "template_id")
        matched = match_pairs(left, wanted, sim_th).select("mid")
        rest_at = scratch_path(spark, "messages")
        undecided = materialise_at(left.join(matched, "mid", "left_anti").select(*undecided.columns), rest_at)
        if at:
            discard(spark, at)
        at, decided, batch = rest_at, cuts.withColumnRenamed("cut", "start"), min(2 * batch, LARGEST_BATCH)
    new = number_templates(materialise(found, "templates"))
    if known is None:
        return new
    last = known.groupBy("scope").agg(F.max("template_id").alias("_last"))
    after = new.join(last, "scope", "left").withColumn("template_id", F.col("template_id") + F.coalesce(F.col("_last") + 1, F.lit(0)))
    return materialise(known.unionByName(after.drop("_last")), "templates")


def positions_after(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with every ``pos`` moved behind the positions of ``known`` templates."""
    ends = known.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).scalar()
    starts = rows.agg(F.coalesce(F.min("pos"), F.lit(0))).scalar()
    return rows.withColumn("pos", F.col("pos") + F.greatest(ends - starts, F.lit(0)))


def number_templates(found: DataFrame) -> DataFrame:
    """Template ids from 0 in order of position; ``found`` is a stored table."""
    low, high, count = found.agg(F.min("pos"), F.max("pos"), F.count(F.lit(1))).first()
    width = max(1, (high - low + 1) // max(1, count // 50_000 + 1)) if count else 1
    numbered = with_ordinal(found, ["scope"], ["pos", "text"], block_chunk("pos", width), "template_id", start=0)
    return materialise(numbered.select("scope", "template_id", "pos", "n", "text"), "templates")


def assign_templates(rows: DataFrame, templates: DataFrame, sim_th: float = SIM_TH, assign: str = "pos") -> DataFrame:
    """Adds ``template_id`` to every row.

    ``assign='pos'`` lets a row see the templates opened up to its position, as the
    sequential rule does; ``'final'`` takes the best of all templates, so equal
    messages always agree.  Distinct messages are matched; rows then look up theirs.
    """
    columns = [*rows.columns, "template_id"]
    rows = scoped(rows)
    messages = named(distinct_messages(rows).where("n > 0"))
    found = best_templates(messages, templates.where(F.col("text") != ""), sim_th, assign)
    # stored: few distinct messages do not gather the rows in few tasks
    done = rows.join(materialise(found, "best"), ["scope", "text"], "left")
    seen = F.filter("_steps", lambda s: s.getField("template_pos") <= F.col("pos")) if assign == "pos" else F.col("_steps")
    done = done.withColumn("template_id", F.array_max(seen).getField("template_id")).drop("_steps")
    # templates are a stored table, so these look-ups are cheap
    empties = templates.where(F.col("text") == "").select("scope", "template_id", "pos")
    if empties.isEmpty():
        return done.select(*columns)
    # only empty messages get here, matched by position or to the shared template
    shared = empties.groupBy("scope").agg(F.min("template_id").alias("_shared"))
    blank = done.where(F.col("text") == "").drop("template_id")
    own = blank.join(empties, ["scope", "pos"], "left").join(shared, "scope", "left")
    own = own.withColumn("template_id", F.coalesce("template_id", "_shared"))
    return done.where(F.col("text") != "").select(*columns).unionByName(own.select(*columns))


def best_templates(messages: DataFrame, templates: DataFrame, sim_th: float, assign: str) -> DataFrame:
    """``(scope, text, _steps)``: per message the templates that can win, the largest struct the best.

    Of those with equal shares only the oldest can, so there are at most as many as tokens.
    """
    pairs = match_pairs(messages, templates, sim_th)
    if assign == "final":
        best = F.max(F.struct("equal", (-F.col("template_id")).alias("_age"), "template_pos", "template_id"))
        steps = pairs.groupBy("mid").agg(F.array(best).alias("_steps"))
    else:
        oldest = pairs.groupBy("mid", "equal").agg(F.min(F.struct("template_pos", "template_id")).alias("_t"))
        step = F.struct("equal", F.lit(0).cast("bigint").alias("_age"), "_t.template_pos", "_t.template_id")
        steps = oldest.groupBy("mid").agg(F.collect_list(step).alias("_steps"))
    return messages.select("scope", "text", "mid").join(steps, "mid").drop("mid")
