import random
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from odd import ODD_TEXTS
from tokenizers import Tokenizer

from rootscope.llm.packing import LIMIT, POWERS, checksum_after, choose_windows, pack


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def check(library, rows, pieces):
    """Exact round trip: every id in one piece, sequences without gaps, little padding."""
    by_doc = {i: ids(library, t) for i, t in rows}
    for doc, own in groupby(sorted(pieces), key=lambda p: p.doc_id):
        at = 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(by_doc[doc])
            part = np.array(by_doc[doc][at : at + p.length], "<u4")
            assert zlib.crc32(part.tobytes()) == p.ids_crc32 and len(part) == p.length > 0
            at += p.length
        assert at == len(by_doc.pop(doc))
    assert not by_doc
    order = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    padding = total = 0
    for _, own in groupby(order, key=lambda p: p.sequence_id):
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= LIMIT
        padding += 0 if at & (at - 1) == 0 else LIMIT - at
        total += at
    assert [(p.doc_id, p.start) for p in order] == sorted((p.doc_id, p.start) for p in order)
    return padding / max(total, 1)


def test_round_trip(docs, library):
    rng = random.Random(4)
    texts = list(ODD_TEXTS)
    for _ in range(150):
        sentences = [" ".join(rng.choices(["alpha", "beta", "gamma", "Δelta", "don't"], k=rng.randrange(1, 60))) + rng.choice(".!?,") for _ in range(rng.randrange(12))]
        texts.append(" ".join(sentences))
    rows = list(enumerate(texts))
    assert check(library, rows, pack(docs(rows)).collect()) < 0.03


def test_odd_tables(docs, library):
    assert pack(docs([])).count() == 0
    assert check(library, [(3, None)], pack(docs([(3, None)])).collect()) == 0
    repeated = pack(docs([(1, "a b"), (1, "a b"), (None, "c")]).withColumnRenamed("lang", "part")).collect()
    assert sorted((str(p.doc_id), p.length) for p in repeated) == [("1", 3), ("1", 3), ("None", 2)]
    assert sorted(p.offset for p in repeated) == [0, 2, 5]


def test_windows_are_optimal():
    rng = random.Random(5)
    for _ in range(150):
        gaps = [rng.randrange(1, 700) for _ in range(rng.randrange(1, 40))]
        position = np.cumsum(gaps).tolist()
        fine = [rng.choice([0, 8, 64]) for _ in gaps]
        fine[-1] = 0

        def cost(a, b):
            size = b - a
            return (0 if size in (*POWERS, LIMIT) else LIMIT - size) + dict(zip(position, fine))[b]

        best = {0: 0}
        for p in position:
            best[p] = min(best[q] + cost(q, p) for q in best if p - LIMIT <= q)
        cuts = choose_windows(position, fine)
        assert cuts[-1] == position[-1]
        assert sum(cost(a, b) for a, b in zip([0, *cuts], cuts)) == best[position[-1]]


def test_checksums():
    rng = random.Random(6)
    data = [(rng.randbytes(rng.randrange(50)), rng.randbytes(4 * rng.randrange(9000))) for _ in range(30)]
    whole = np.array([zlib.crc32(a + b) for a, b in data], np.uint32)
    before = np.array([zlib.crc32(a) for a, _ in data], np.uint32)
    got = checksum_after(whole, before, np.array([len(b) for _, b in data]))
    assert got.tolist() == [zlib.crc32(b) for _, b in data]
