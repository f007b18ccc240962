"""Operator 1, token counts: a byte-level BPE vocabulary compiled to transducers.

Two deterministic transducers run one after the other.

* The outer one cuts a text into words. Each cut depends on the classes of the character
  before and the two after, and on the contractions behind an apostrophe.
* The inner one reads the bytes of a word and emits numbers of tokens. Reading a byte may
  add tokens or take back a token that a longer one replaces, so a transition carries the
  *change* of the count. A state is the set of tokens that may still be under way: the
  vocabulary prefix read, the token before it, and the count there relative to now. Two
  tokens may stand side by side if merging their bytes gives just these two, which makes
  the last token at each byte unique. States and transitions are compiled when first met
  and kept; the tables start again beyond ``MAX_STATES``.

A long text is cut into chunks. A chunk's map over all states in which it may be entered is
``(head, count, tail)``: between a letter and a space before a letter a cut is certain, so
the count between the first and the last such place is known whatever comes before, and
only head and tail stay open. Maps compose associatively, pairwise in a tree.
"""

from __future__ import annotations

import json
import math
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootscope.llm.common import map_texts, whole_text

#: Bounds of the compiled tables and of the words whose counts are kept.
MAX_STATES, MAX_WORDS = 400_000, 1_000_000
#: Characters of a chunk.
CHUNK = 65_536

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
# fixed values: white space of the Unicode standard, contractions of the vocabulary's cutter
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = {"s": 2, "t": 2, "m": 2, "d": 2, "re": 3, "ve": 3, "ll": 3}


@lru_cache(1)
def _classes() -> np.ndarray:
    found = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            found[i] = LETTER if kind == "L" else NUMBER
    found[WHITE] = SPACE
    found[0x20] = BLANK
    return found


def cut_words(text: str) -> list[str]:
    """The outer transducer: the words of a text, which joined give the text."""
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    white = kind >= BLANK
    cut = np.ones(len(kind), bool)
    before, here = white[:-1], white[1:]
    ends = np.append(~white[2:], False)  # the last of a run of white space that a word follows
    cut[1:] = np.where(
        here, ~before | ends[: len(here)], np.where(before, kind[:-1] != BLANK, kind[:-1] != kind[1:])
    )
    if "'" in text:
        for i in np.flatnonzero((points == 39) & cut):
            size = CONTRACTIONS.get(text[i + 1 : i + 2]) or CONTRACTIONS.get(text[i + 1 : i + 3])
            if size:
                cut[i + 1 : i + size] = False
                if i + size < len(cut):
                    cut[i + size] = True
    starts = np.flatnonzero(cut).tolist()
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountingTransducer:
    """Bytes of a word to its number of tokens."""

    def __init__(self, vocabulary: list[bytes], merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.tokens = {t for t in vocabulary if self.merged(t) == [t]}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((b"", b"", 0),)
        self.number = {start: 0}
        self.states = [start]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.beside.clear()

    def merged(self, text: bytes) -> list[bytes]:
        """The merge rule itself; remembers the two halves merged last."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            i = ranks.index(best)
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The parts at one end (0 left, 1 right) of a token as it is merged, each with the rank of
        the merge that takes it in. Ranks rise, as a merge is learnt after those it builds on."""
        known = self.edges.get((token, side))
        if known is None:
            if len(token) == 1:
                known = [(token, math.inf)]
            else:
                inner = self.edge(self.halves[token][side], side)
                known = [*inner[:-1], (inner[-1][0], self.rank[self.halves[token]]), (token, math.inf)]
            self.edges[(token, side)] = known
        return known

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether both stay whole side by side: no merge across the seam comes first."""
        if not left:
            return True
        known = self.beside.get((left, right))
        if known is None:
            known = self.beside[(left, right)] = self._apart(self.edge(left, 1), self.edge(right, 0))
        return known

    def _apart(self, lefts: list[tuple[bytes, float]], rights: list[tuple[bytes, float]]) -> bool:
        i = j = 0
        while True:
            (a, a_taken), (b, b_taken) = lefts[i], rights[j]
            across = self.rank.get((a, b), math.inf)
            # of equal ranks the leftmost merge comes first
            if across < a_taken and across <= b_taken and across < math.inf:
                return False
            if a_taken == b_taken == math.inf:
                return True
            if a_taken <= b_taken:
                i += 1
            else:
                j += 1

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: the next state and the change of the count."""
        step, under_way, last = bytes((byte,)), [], None
        for read, left, count in self.states[state]:  # longest first
            read += step
            if read in self.prefixes:
                under_way.append((read, left, count))
                if last is None and read in self.tokens and self.may_follow(left, read):
                    last = (read, count + 1)
        token, change = last
        state_now = tuple((r, left, c - change) for r, left, c in under_way) + ((b"", token, 0),)
        number = self.number.get(state_now)
        if number is None:
            number = self.number[state_now] = len(self.states)
            self.states.append(state_now)
            self.moves.append({})
        self.moves[state][byte] = (number, change)
        return number, change

    def count(self, word: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.reset()
        state = total = 0
        moves = self.moves
        for byte in word:
            state, change = moves[state].get(byte) or self.move(state, byte)
            total += change
        return total


class TokenCounter:
    """Number of tokens of texts, as the library of the vocabulary file gives it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        names = _byte_names()
        as_bytes = lambda t: bytes(names[c] for c in t)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.specials = [t["content"] for t in file["added_tokens"]]
        special = set(self.specials)
        self.transducer = CountingTransducer(
            [as_bytes(t) for t in model["vocab"] if t not in special], [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        )
        self.words: dict[str, int] = {}

    def of_words(self, words: list[str]) -> int:
        total, known, count = 0, self.words, self.transducer.count
        for w in words:
            n = known.get(w)
            if n is None:
                n = known[w] = count(w.encode())
            total += n
        if len(known) > MAX_WORDS:
            known.clear()
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """Head, count and tail; no count where no cut is certain."""
        kind = _classes()[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)]
        sure = np.flatnonzero((kind[:-2] == LETTER) & (kind[1:-1] == BLANK) & (kind[2:] == LETTER)) + 1
        if not len(sure):
            return chunk, None, ""
        a, b = int(sure[0]), int(sure[-1])
        return chunk[:a], self.of_words(cut_words(chunk[a:b])), chunk[b:]

    def compose(self, left: tuple, right: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if left[1] is None and right[1] is None:
            return self.chunk_map(left[0] + right[0])
        if left[1] is None:
            return left[0] + right[0], right[1], right[2]
        if right[1] is None:
            return left[0], left[1], left[2] + right[0]
        return left[0], left[1] + self.of_words(cut_words(left[2] + right[0])) + right[1], right[2]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        for special in self.specials:
            if special in text:
                parts = text.split(special)
                return len(parts) - 1 + sum(self.count(p, chunk) for p in parts)
        if len(text) <= chunk:
            return self.of_words(cut_words(text))
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            odd = [maps[-1]] if len(maps) % 2 else []
            maps = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])] + odd
        head, inner, tail = maps[0]
        if inner is None:
            return self.of_words(cut_words(head))
        return self.of_words(cut_words(head)) + inner + self.of_words(cut_words(tail))


def vocabulary_path(name: str) -> str:
    """Where this machine keeps a public vocabulary file; a full path passes unchanged."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def counter(name: str) -> TokenCounter:
    return TokenCounter(vocabulary_path(name))


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row.

    A null or empty text has no tokens. Repeated rows give repeated results; a null
    ``doc_id`` passes; an empty table gives no rows; other columns are not read. ``vocabulary`` is a byte-level BPE
    file of public_tokenizers or a path that every executor has. No shuffle.
    """
    texts = docs.select("doc_id", F.octet_length(whole_text()).cast("bigint").alias("n_bytes"), whole_text().alias("text"))

    def rule(batch: list[str]) -> dict[str, list]:
        count = counter(vocabulary).count
        return {"n_tokens": [count(t) for t in batch]}

    counted = map_texts(texts, ["doc_id", "n_bytes"], rule, "n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
