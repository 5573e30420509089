"""Byte-pair tokens by rank-synchronous merging of ragged numpy arrays.

Pre-tokens of many texts are held as one flat symbol array with word bounds. In each round
every word finds its lowest-rank adjacent pair and all words apply theirs at once; words
without a mergeable pair are done. Texts are cut into blank-free chunks in their bytes; only the
distinct ones of a step are looked up, and a bounded dictionary keeps the ids of those already
merged. The pre-tokens of the others are found by the vocabulary's own pattern.

The vocabulary file is read on each executor from the tokenizer package; its name is a
parameter. Files with an end-of-word suffix, lower case and white space dropped are meant
(word_bpe_49k.json); a null or empty text has no tokens.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.textbatch import byte_class, kept, steps, text_buffer

VOCABULARY = "word_bpe_49k.json"
#: Bytes of chunks and ids that a worker keeps, ENTRY counted for each pair, in two generations: when the
#: younger has half, it becomes the older, and what that held and nothing has asked for since goes.
KEPT_BYTES, ENTRY = 256 << 20, 160
#: Bytes of text whose chunks are looked up together: of more bytes, fewer are distinct.
LOOKUP_BYTES = 2 << 20

#: The pre-token pattern of the vocabulary, its white space written out.
_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"

#: The same white space in bytes: single ones, and the codes of characters of two and of three.
_GAP = byte_class(b"\t\n\x0b\x0c\r ")
_GAPS_2 = np.array([0xC285, 0xC2A0])
_GAPS_3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
#: Signs that end a word and that no pattern of letters takes in.
SIGNS = ".,;:!?"
_SIGN = byte_class(SIGNS.encode())


def gaps(buf: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    out = _GAP[buf]
    for width, leads, codes in ((2, b"\xc2", _GAPS_2), (3, b"\xe1\xe2\xe3", _GAPS_3)):
        for lead in leads:
            at = np.flatnonzero(buf[: max(0, len(buf) - width + 1)] == lead)
            code = np.zeros(len(at), np.int64)
            for i in range(width):
                code = code << 8 | buf[at + i]
            at = at[np.isin(code, codes)]
            for i in range(width):
                out[at + i] = True
    return out


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = dict.fromkeys(range(256), "")
    table |= {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [table[b] or chr(next(spare)) for b in range(256)]


class Merger:
    """Merge tables of one vocabulary, as arrays, and the dictionary of merged chunks."""

    def __init__(self, path: str, kept: int = KEPT_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_symbols()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = int(max(vocab.values())) + 1
        self._tables(left * self.size + right, made)
        self.pattern = regex.compile(PATTERN)
        self.kept, self.known, self.older, self.held = kept, {}, {}, 0

    def _tables(self, keys: np.ndarray, made: np.ndarray) -> None:
        """An open-addressed hash table key -> rank, probed in a fixed number of numpy steps."""
        bits = 18
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        slots, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, 1 << 40, np.int64)
        rest, self.probes = np.arange(len(keys)), 0
        home = self._home(keys)
        while len(rest):
            at = (home[rest] + self.probes) & self.mask
            free = slots[at] < 0
            slots[at[free]] = keys[rest[free]]
            ranks[at[free]] = rest[free]
            rest = rest[slots[at] != keys[rest]]
            self.probes += 1
        self.slots, self.ranks, self.made = slots, ranks, made

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        """Merge rank of each pair key, or a huge value."""
        out = np.full(len(keys), 1 << 40, np.int64)
        home, rest = self._home(keys), np.arange(len(keys))
        for probe in range(self.probes):
            at = (home[rest] + probe) & self.mask
            found = self.slots[at]
            hit = found == keys[rest]
            out[rest[hit]] = self.ranks[at[hit]]
            rest = rest[~hit & (found >= 0)]
            if not len(rest):
                break
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word) for words given as UTF-8 bytes, none empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        done_ids, done_word = [], []
        live = np.arange(len(words))
        while len(live):
            n = len(symbols)
            word = np.repeat(np.arange(len(live)), lengths)
            rank = np.full(n, 1 << 40, np.int64)
            if n > 1:
                same = word[1:] == word[:-1]
                at = np.flatnonzero(same)
                rank[at] = self.rank_of(symbols[at] * self.size + symbols[at + 1])
            first = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank, first)
            over = best >= 1 << 40
            if over.any():
                gone = over[word]
                done_ids.append(symbols[gone])
                done_word.append(live[word[gone]])
                stay = ~gone
                symbols, rank, word = symbols[stay], rank[stay], word[stay]
                live, lengths, best = live[~over], lengths[~over], best[~over]
                if not len(live):
                    break
                word = np.repeat(np.arange(len(live)), lengths)
            hit = np.flatnonzero(rank == best[word])
            hit = hit[self._alternate(hit)]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            lengths = lengths - np.bincount(word[hit], minlength=len(live))
            symbols = symbols[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    @staticmethod
    def _alternate(hit: np.ndarray) -> np.ndarray:
        """Of runs of adjacent hits (as in aaa) every other one, from the left."""
        if len(hit) < 2:
            return np.ones(len(hit), bool)
        new = np.empty(len(hit), bool)
        new[0] = True
        new[1:] = np.diff(hit) > 1
        if new.all():
            return new
        at = np.arange(len(hit))
        return (at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.replace("Σ", "σ").lower())

    def parts(self, text: str) -> list[str | int]:
        """Pre-tokens and, as numbers, the special strings of a chunk in order."""
        low = text.lower()
        if low.isascii() or ("Σ" not in text and unicodedata.is_normalized("NFC", text)):
            # a word, or a word and one sign after it, needs no pattern
            if low.isalpha():
                return [low]
            if low[-1] in SIGNS and low[:-1].isalpha():
                return [low[:-1], low[-1]]
        if "<|" not in text or not self.split_special:
            return self.pre_tokens(text)
        out: list[str | int] = []
        for k, piece in enumerate(self.split_special.split(text)):
            out.extend([self.special[piece]] if k % 2 else self.pre_tokens(piece))
        return out

    def learn(self, asked: list[str]) -> list[bytes]:
        """Ids of distinct chunks; those that are not known yet are tokenised."""
        found = list(map(self.known.get, asked))
        new = [c for c, x in zip(asked, found) if x is None]
        if not new:
            return found
        if self.held + sum(map(len, new)) + ENTRY * len(new) > self.kept // 2 and self.known:
            self.known, self.older, self.held = {}, self.known, 0
            again = {c: x for c, x in zip(asked, found) if x is not None}
        else:
            again = {c: self.older[c] for c in new if c in self.older}
        self.held += sum(map(len, again)) + sum(map(len, again.values())) + ENTRY * len(again)
        self.known.update(again)
        fresh = [c for c in new if c not in again]
        for at in range(0, len(fresh), 1 << 16):
            chunks = fresh[at : at + (1 << 16)]
            parts = [self.parts(c) for c in chunks]
            words = list(set().union(*parts))
            numbers = [w for w in words if isinstance(w, int)]
            words = [w for w in words if not isinstance(w, int)]
            ids, counts = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
            raw, end = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
            begin = end - counts * 4
            got = {n: np.uint32(n).astype("<u4").tobytes() for n in numbers}
            got.update(zip(words, [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]))
            made = [got[p[0]] if len(p) == 1 else b"".join([got[w] for w in p]) for p in parts]
            self.held += sum(map(len, chunks)) + sum(map(len, made)) + ENTRY * len(chunks)
            self.known.update(zip(chunks, made))
        late = map(self.known.__getitem__, new)
        return [next(late) if x is None else x for x in found]

    def chunks(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(chunks of all texts, chunks before each text and in all), cut at white space, which no pre-token contains.

        A-Z are made small and a sign after one of a-z is cut off, as fewer chunks are distinct then. Both give the
        same ids unless a combining mark (U+0300 to U+036F, bytes 0xCC and 0xCD) may join a letter, as some join only
        small ones, or a special string may be cut: a step with either stays as it is.
        """
        buf, off = text_buffer(column)
        gap = gaps(buf)
        head = ~gap
        head[1:] &= gap[:-1]
        plain = not (buf >> 1 == 0xCC >> 1).any() and not (self.special and ((buf[:-1] == ord("<")) & (buf[1:] == ord("|"))).any())
        if plain:
            head[1:] |= ((buf[:-1] | 32) - np.uint8(97) < 26) & _SIGN[buf[1:]]
        first = off[:-1][np.diff(off) > 0]
        head[first] = ~gap[first]
        starts = np.flatnonzero(head)
        del head
        bounds = np.empty(len(starts) + 1, np.int64)
        bounds[:-1] = np.cumsum(~gap, dtype=np.int32 if len(buf) < 1 << 31 else np.int64)[starts] - 1
        data = buf[~gap]
        bounds[-1] = len(data)
        if plain:
            data[data - np.uint8(65) < 26] |= 32
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)), np.searchsorted(starts, off)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as little-endian unsigned 32-bit numbers, ids before each text and in all)."""
        chunks, before = self.chunks(column)
        if not len(chunks):
            return np.zeros(0, "<u4"), before
        table = chunks.dictionary_encode()
        # lists of strings hold no cycles: the collector would only walk them again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            made = self.learn(table.dictionary.to_numpy(zero_copy_only=False).tolist())
        finally:
            if collects:
                gc.enable()
        found = pa.array(made, pa.large_binary()).take(table.indices)
        _, ends, ids = found.buffers()
        ends = np.frombuffer(ends, np.int64, len(found) + 1)
        return np.frombuffer(ids, "<u4", ends[-1] // 4), ends[before] // 4


def text_bytes(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, none for null."""
    return np.diff(text_buffer(column)[1])


def merger(vocabulary: str = VOCABULARY, size: int = KEPT_BYTES) -> Merger:
    """The worker's merger of a vocabulary file of the tokenizer package, its dictionary of at most `size` bytes."""
    mine = kept("mergers")
    if (vocabulary, size) not in mine:
        import public_tokenizers

        mine[vocabulary, size] = Merger(str(public_tokenizers.path(vocabulary)), size)
    return mine[vocabulary, size]


def token_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_bytes, ids): ids of every whole text, packed as little-endian 32-bit numbers.

    One row per input row, repeated rows included; null and empty texts have no ids; other
    columns are left out, so clashing names do no harm. No shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(vocabulary)
        for batch in batches:
            for part in steps(batch, size=LOOKUP_BYTES):
                ids, off = tool.encode(part.column(1))
                ids = [ids[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_bytes(part.column(1))), pa.array(ids, pa.binary())], names=["key", "n_bytes", "ids"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, ids binary")
    return out.withColumnRenamed("key", key)


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, limit: int = 2048) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text; see token_ids for the edges."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(vocabulary)
        for batch in batches:
            for part in steps(batch, size=LOOKUP_BYTES):
                n_tokens = np.diff(tool.encode(part.column(1))[1])
                arrays = [part.column(0), pa.array(text_bytes(part.column(1))), pa.array(n_tokens), pa.array(n_tokens > limit)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
