import random

import public_tokenizers
import pytest
from odd import ODD_TEXTS
from tokenizers import Tokenizer

from rootscope.llm.tokens import count_tokens, counter, cut_words

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_transducer_counts_as_the_library(library):
    rng, count = random.Random(1), counter(NAME).count
    parts = [*" \n\t'sretvmldSRT.,!12", "abc", "  ", "é", "中", "😀", "don't", "we'll ", "<|endoftext|>", "\xa0", " ", "\x1c", "é", "½", "ٱ"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(40)))
        assert count(text) == size(library, text), text
        assert count(text, chunk=rng.randrange(1, 12)) == size(library, text), text


def test_words_join_to_the_text():
    for text in ODD_TEXTS:
        assert "".join(cut_words(text or "")) == (text or "")


def test_tables_start_again(library, monkeypatch):
    monkeypatch.setattr("rootscope.llm.tokens.MAX_STATES", 50)
    monkeypatch.setattr("rootscope.llm.tokens.MAX_WORDS", 20)
    text = "Some words of different kinds, 123 numbers; and so on. " * 5
    assert counter(NAME).count(text) == size(library, text)


def test_query_rows(docs, library):
    rows = docs([*[(i, t) for i, t in enumerate(ODD_TEXTS)], (None, "x"), (1, "again")])
    got = sorted(map(tuple, count_tokens(rows.withColumnRenamed("lang", "n_tokens")).collect()), key=str)
    want = [*enumerate(ODD_TEXTS), (None, "x"), (1, "again")]
    want = [(i, len((t or "").encode()), size(library, t or ""), size(library, t or "") > 512) for i, t in want]
    assert got == sorted(want, key=str)
    assert count_tokens(docs([])).count() == 0
