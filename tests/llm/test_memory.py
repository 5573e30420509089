"""What a Python worker holds: hashing in pieces, the tables of one operator at a time."""

import gc
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa

from quillspan.llm import bpe, packing, textbatch


def hashed(texts):
    buf, off = textbatch.text_buffer(pa.array(texts))
    starts, ends, _ = textbatch.word_bounds(buf, off, textbatch.SPACE_WORD)
    return textbatch.word_hashes(buf, starts, ends)


def test_words_are_hashed_in_little_memory():
    buf, off = textbatch.text_buffer(pa.array([" ".join(f"word{i % 1009}" for i in range(500_000))]))
    starts, ends, _ = textbatch.word_bounds(buf, off, textbatch.SPACE_WORD)
    tracemalloc.start()
    try:
        textbatch.word_hashes(buf, starts, ends)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 8 * len(starts) + 4 * len(buf)


def test_hashes_do_not_depend_on_pieces():
    words = ["a", "B" * 400_000, "c", *(f"w{i}" for i in range(120_000)), "d" * 300_000, "e"]
    together = hashed([None, " ".join(words), "", "a  e"])
    assert len(together) == len(words) + 2
    some = [*range(60), 40_000, 90_001, len(words) - 3, len(words) - 2, len(words) - 1]
    assert together[some].tolist() == [int(hashed([words[i].swapcase()])[0]) for i in some]
    assert together[-2:].tolist() == [together[0], together[len(words) - 1]] and len(np.unique(together[:-2])) == len(words)


def test_a_worker_keeps_the_tables_of_one_operator():
    one = bpe.merger()
    assert bpe.merger() is one
    gone = weakref.ref(one)
    del one
    hashed(["the words of another operator"])
    gc.collect()
    assert gone() is None


def test_a_small_dictionary_gives_the_same_pieces(docs, spark):
    rows = spark.createDataFrame([(int(i), t) for i, t in enumerate(docs["text"]) if isinstance(t, str)][:300], "doc_id long, text string")
    pieces = lambda size: sorted(map(tuple, packing.cut_pieces(rows, dictionary=size).collect()))
    assert pieces(1 << 12) == pieces(bpe.KEPT_BYTES)
