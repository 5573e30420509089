"""Chunks of texts: cut in their bytes, looked up once a step, ids as the tokenizer library gives them."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspan.llm import bpe

ODD = [
    None,
    "",
    " \t\n",
    "A.b,c;D:e!F?g",
    "DON'T. \"I'LL\" we've, 'S.",
    "a\x1cb\x1d.c\x1f,",
    "one two\u0085three four five six seven eight　nine.",
    "日本　語。",
    "STRASSE, Straße! ẞ? Σσς. İIı",
    "x.",
    ".x",
    "end ",
    "\U0001f642.OK\U0001f642,ok",
]
MARKED = ["J̌ ǰ H̱. W̊Å, é.", "J֑̌ T.̸"]
SPECIAL = ["<|endoftext|>Foo<|ENDOFTEXT|>.bar <|startoftext|>,", "A<|B|>"]


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(str(public_tokenizers.path(bpe.VOCABULARY)))
    return lambda texts: [x.ids for x in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def merger(size=bpe.KEPT_BYTES):
    return bpe.Merger(str(public_tokenizers.path(bpe.VOCABULARY)), size)


def ids_of(tool, column):
    ids, off = tool.encode(column)
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]


def test_a_step_looks_up_distinct_words_only(library):
    """Repeated words, their capitals and the signs after them are no lookups and no entries of their own."""
    tool, asked = merger(), []
    learn = tool.learn
    tool.learn = lambda words: asked.append(words) or learn(words)
    texts = ["The word, the WORD. Another; word! Word?"] * 300 + [None]
    assert ids_of(tool, pa.array(texts)) == library(texts)
    assert len(asked) == 1 and sorted(asked[0]) == sorted([*",.;!?", "the", "word", "another"]) and set(tool.known) == set(asked[0])


@pytest.mark.parametrize("texts", [ODD, ODD + MARKED, ODD + SPECIAL, ODD + MARKED + SPECIAL])
def test_odd_texts(library, texts):
    want, tool = library(texts), merger()
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        assert ids_of(tool, column) == want
        assert ids_of(tool, column.slice(3, 7)) == want[3:10]
        assert [ids_of(tool, column.slice(i, 1))[0] for i in range(len(texts))] == want
    assert ids_of(tool, pa.array([], pa.string())) == [] and ids_of(tool, pa.array([None, ""], pa.string())) == [[], []]


def test_capitals_and_signs_beside_every_character():
    """Each row as a text of its own kind: beside a mark nothing is made small or cut, which must give the same ids."""
    marks = "̀"
    characters = [chr(i) for i in range(0x80, 0x3400) if not 0x300 <= i < 0x370]
    texts = [f"J{c}.A W{c} X,{c}" for c in characters]
    cut, whole = ids_of(merger(), pa.array(texts)), ids_of(merger(), pa.array([*texts, marks]))
    assert cut == whole[:-1]


def test_two_generations(library):
    rng = np.random.default_rng(3)
    tool = merger(1 << 16)
    for _ in range(30):
        texts = [" ".join(f"W{chr(97 + a)}{chr(97 + b)}." for a, b in rng.integers(0, 26, (60, 2)).tolist()) for _ in range(3)]
        assert ids_of(tool, pa.array(texts)) == library(texts)
        assert tool.held <= 1 << 15 and tool.held == sum(len(c) + len(x) + bpe.ENTRY for c, x in tool.known.items())
    assert tool.older
