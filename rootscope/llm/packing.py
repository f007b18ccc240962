"""Operator 4, order-preserving packing by dynamic programming.

Documents in the order of ``doc_id`` form one stream of tokens, cut into blocks of about
``BLOCK`` tokens at document ends. In a block, windows of at most 4096 tokens are chosen by

    cost(j) = penalty(j) + min over i of cost(i) + padding(position(j) - position(i))

where i and j are places at which a cut is allowed: document ends (no penalty), sentence ends
and, inside sentences of over ``LONG`` tokens, every ``STRIDE`` tokens. Padding is linear in
the position, so the minimum over the window comes from a monotone queue; windows whose length
is a power of two need no padding and are looked up beside it.

Texts are encoded once. Of a document only its length, the allowed places and the checksums of
the ids up to each are kept; the checksum of a piece follows from two of them. Block starts come
from the exact running sum of lengths, so neither partitioning nor retries change the result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from functools import lru_cache
from operator import attrgetter
from struct import pack as pack_ids

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootscope.llm.common import map_texts, whole_text
from rootscope.llm.tokens import vocabulary_path
from rootscope.session import materialise

LIMIT, END_ID = 4096, 2
BLOCK = 1 << 20
#: Penalties in tokens of padding: for a cut at a sentence's end and inside a sentence.
SENTENCE, INSIDE = 8, 64
LONG, STRIDE = 512, 256
#: Shorter windows that need no padding.
POWERS = [512, 1024, 2048]
#: Bytes of texts that are encoded at once.
SLICE = 6_000_000
#: Words of a generation; a worker keeps the ids of two generations.
MAX_WORDS = 400_000
#: Runs of marks that a worker keeps.
MAX_MARKS = 10_000
#: Letters whose normal form is themselves in lower case, between ASCII marks. No apostrophe, as 's and the like are
#: cut apart, and no <, as special strings begin with it.
_PLAIN = re.compile(r"""([!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)([A-Za-zÀ-ÖØ-öø-įı-ž]+)([!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)""")
#: The model reads bytes as letters: those that print, without the soft hyphen, stand for themselves, the others for 256 and on.
_PRINT = {*range(33, 127), *range(161, 173), *range(174, 256)}
_AS_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINT)}
_ID = attrgetter("id")
_LENGTHS = [f"<{n}I" for n in range(64)]
#: Separators that str.split knows and the vocabulary's cutter does not.
_ODD_SPACES = "\x1c\x1d\x1e\x1f"


class Encoder:
    """Ids as little-endian 32-bit bytes. The vocabulary drops white space and never joins text
    across it, so the different words of a slice are encoded once. It also cuts between letters
    and marks and lowers letters, so a plain word with marks around it is put together from three parts;
    its letters go to the library's model by themselves and are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        # two generations: words met again move on to the younger
        self.letters: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        vocabulary, shape = rules["model"]["vocab"], rules.get("normalizer") or {}
        if "Lowercase" not in [n["type"] for n in shape.get("normalizers", [shape])] or not rules["model"].get("end_of_word_suffix"):
            raise ValueError(f"packing takes vocabularies of whole words in lower case, not {path}")
        stops = [i for t, i in vocabulary.items() if re.fullmatch(r"[^\w]*[.!?][^\w]*", t.removesuffix("</w>"))]
        self.stops = np.zeros(max(self.library.get_vocab_size(), max(vocabulary.values()) + 1), bool)
        self.stops[stops] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, each with ``END_ID`` behind it, and how many each text has."""
        if any(odd in text for text in texts for odd in _ODD_SPACES):
            lists = pa.array([[t] if any(odd in t for odd in _ODD_SPACES) else t.split() for t in texts], pa.list_(pa.large_string()))
        else:
            lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self._each(words)
        # words are gathered by number; the last one is the end of a text
        known.append(np.array([END_ID], "<u4").tobytes())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(sizes) - sizes
        per_text = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(per_text)
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(words))
        counts = sizes[order]
        upto = np.cumsum(counts)
        ids = np.frombuffer(b"".join(known), "<u4")[np.arange(upto[-1]) + np.repeat(first[order] - upto + counts, counts)]
        return ids, np.diff(upto[ends + np.arange(len(texts))], prepend=0)

    def _each(self, words: list[str]) -> list[bytes]:
        """The ids of each of different words."""
        if len(self.letters) > MAX_WORDS:
            self.older, self.letters = self.letters, {}
        letters, marks, out, odd = self.letters, self.marks, [], []
        for w in words:
            if w.isascii() and w.isalpha():
                word = w.lower()
                ids = letters.get(word) or self._letters(word)
            elif plain := _PLAIN.fullmatch(w):
                before, word, after = plain.groups()
                word = word.lower()
                ids = letters.get(word) or self._letters(word)
                if before:
                    ids = (marks.get(before) or self._mark(before)) + ids
                if after:
                    ids += marks.get(after) or self._mark(after)
            else:
                ids = b""
                if w:
                    odd.append(len(out))
            out.append(ids)
        for i, ids in zip(odd, self._encode([words[i] for i in odd]) if odd else ()):
            out[i] = ids
        return out

    def _mark(self, run: str) -> bytes:
        if len(self.marks) > MAX_MARKS:
            self.marks.clear()
        ids = self.marks[run] = self._encode([run])[0]
        return ids

    def _letters(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            plain = word if word.isascii() else word.encode().decode("latin-1").translate(_AS_LETTERS)
            found = self.model.tokenize(plain)
            ids = pack_ids(_LENGTHS[len(found)], *map(_ID, found)) if len(found) < len(_LENGTHS) else self._encode([word])[0]
        self.letters[word] = ids
        return ids


@lru_cache(1)
def encoder(name: str) -> Encoder:
    return Encoder(vocabulary_path(name))


def places(ids: np.ndarray, stops: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where documents that follow each other in ``ids`` may be cut, and how many places each has.

    Places count from the start of their document, its end last; those inside sentences are negative.
    """
    last = np.cumsum(lengths)
    is_end = stops[ids]
    is_end[last - 1] = True
    ends = np.flatnonzero(is_end) + 1
    gaps = np.diff(ends, prepend=0)
    inside = [np.arange(ends[k] - gaps[k] + STRIDE, ends[k], STRIDE) for k in np.flatnonzero(gaps > LONG)]
    all_ = np.concatenate([ends, *inside])
    sign = np.where(np.arange(len(all_)) < len(ends), 1, -1)
    order = np.argsort(all_, kind="stable")
    doc = np.searchsorted(last, all_[order], "left")
    return (all_[order] - (last - lengths)[doc]) * sign[order], np.bincount(doc, minlength=len(lengths))


def _summaries(vocabulary: str):
    def rule(texts: list[str]) -> dict[str, list]:
        enc = encoder(vocabulary)
        ids, lengths = enc.encode(texts)
        cuts, counts = places(ids, enc.stops, lengths)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        sums, crc, view = [], zlib.crc32, memoryview(ids.astype("<u4", copy=False)).cast("B")
        begin = np.cumsum(lengths) - lengths
        ends = ((np.abs(cuts) + np.repeat(begin, counts)) * 4).tolist()
        start = 0
        for first, after in zip(offsets.tolist(), offsets[1:].tolist()):
            total = 0
            for at in ends[first:after]:
                total = crc(view[start:at], total)
                sums.append(total)
                start = at
        lists = {"places": cuts.astype(np.int32), "sums": np.array(sums, np.uint32).view(np.int32)}
        return {"n": pa.array(lengths)} | {k: pa.ListArray.from_arrays(offsets, pa.array(v)) for k, v in lists.items()}

    return rule


# fixed value: the reflected polynomial of CRC-32
_POLYNOMIAL = 0xEDB88320


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of polynomials over two elements, modulo that of CRC-32; the top bit is the power 0."""
    total = np.zeros_like(a)
    for bit in range(31, -1, -1):
        total ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return total


def checksum_after(whole: np.ndarray, before: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of the last ``n_bytes``, from those of the whole and of what stands before."""
    bits, power = n_bytes.astype(np.uint64) * np.uint64(8), np.full(len(whole), 1 << 30, np.uint32)
    shifted = before.astype(np.uint32)
    while bits.any():
        shifted = np.where(bits & np.uint64(1), _product(shifted, power), shifted)
        power = _product(power, power)
        bits >>= np.uint64(1)
    return whole ^ shifted


def choose_windows(position: list[int], penalty: list[int], limit: int = LIMIT) -> list[int]:
    """The positions at which windows end. ``position`` rises, with gaps of at most ``limit``."""
    at = {0: 0}
    where, cost, back = [0, *position], [0], [-1]
    queue: deque[int] = deque([0])  # places by rising cost(i) + position(i), from left to right
    rank = [0]
    first = 0  # the queue's first place
    small, middle, large = POWERS
    found, push, drop = at.get, queue.append, queue.pop
    for j, p in enumerate(position, 1):
        while where[first] < p - limit:
            queue.popleft()
            first = queue[0]
        i = first
        best = rank[i] + limit - p
        k = found(p - small)
        if k is not None and cost[k] < best:
            best, i = cost[k], k
        k = found(p - middle)
        if k is not None and cost[k] < best:
            best, i = cost[k], k
        k = found(p - large)
        if k is not None and cost[k] < best:
            best, i = cost[k], k
        best += penalty[j - 1]
        cost.append(best)
        back.append(i)
        best += p
        rank.append(best)
        at[p] = j
        while queue and rank[queue[-1]] >= best:
            drop()
        push(j)
        first = queue[0]
    cuts, j = [], len(position)
    while j:
        cuts.append(where[j])
        j = back[j]
    return cuts[::-1]


def _pack_block(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("at", kind="stable")
    length = block["n"].to_numpy()
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    each = [np.asarray(p, np.int64) for p in block["places"]]
    sums = np.concatenate([np.asarray(s, np.int32) for s in block["sums"]]).view(np.uint32)
    position = np.concatenate([np.abs(p) + a for p, a in zip(each, first)])
    fine = np.concatenate([np.where(p < 0, INSIDE, np.where(np.abs(p) == n, 0, SENTENCE)) for p, n in zip(each, length)])
    cuts = np.array([0, *choose_windows(position.tolist(), fine.tolist())])
    edges = np.union1d(cuts, np.append(first, first[-1] + length[-1]))
    start, end = edges[:-1], edges[1:]
    doc = np.searchsorted(first, start, "right") - 1
    window = np.searchsorted(cuts, start, "right") - 1
    whole = sums[np.searchsorted(position, end)]
    inner = start > first[doc]
    whole[inner] = checksum_after(
        whole[inner], sums[np.searchsorted(position, start[inner])], (end - start)[inner] * 4
    )
    return pd.DataFrame(
        {
            "doc_id": block["doc_id"].to_numpy()[doc],
            "start": start - first[doc],
            "length": end - start,
            "ids_crc32": whole.astype(np.int64),
            "doc_tokens": length[doc],
            "sequence_id": (int(block["block"].iloc[0]) << 20) + window,
            "offset": start - cuts[window],
        }
    )


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's ids are those of the library and ``END_ID``; a null or empty text has only
    that. A sequence holds consecutive documents, at most 4096 tokens, from offset 0 without gaps.
    Documents go by ``doc_id``, null first; of equal ids by length and checksum, and rows that
    agree in all of them are packed one by one. An empty table gives no rows; other columns are
    not read. The smallest sequences of a block are its last.
    """
    order = ["doc_id", "n", "last"]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    found = map_texts(texts, ["doc_id"], _summaries(vocabulary), "n bigint, places array<int>, sums array<int>", SLICE)
    found = found.withColumn("last", F.element_at("sums", -1))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(
        materialise(found, "encoded").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged"
    )
    # one small row for each partition
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.coalesce(
        F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = ranged.withColumn("here", here).join(totals.select("part", ahead.alias("ahead")), "part")
    placed = placed.withColumn("at", F.col("ahead") + F.col("here")).withColumn("block", F.floor(F.col("at") / BLOCK))
    pieces = "doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    # as text, since pandas has no integers beside nulls
    placed = placed.withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = placed.select("doc_id", "n", "places", "sums", "at", "block").groupBy("block").applyInPandas(_pack_block, pieces)
    return packed.withColumn("doc_id", F.col("doc_id").cast("bigint"))
