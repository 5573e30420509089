"""Numpy views of Arrow text columns: byte buffers, word bounds, word hashes.

Everything here works on whole texts. A null text is an empty text. Batches are cut by
bytes, never inside a text, so that memory follows the longest text and not the row count.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text a numpy step holds at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd base of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give memory that is free back to the system: a worker waits for its next task with what it needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What `owner` keeps in this worker from task to task. Asking for it drops what other owners kept.

    A worker outlives its operator: of the tables and dictionaries of all operators that it has
    served it would otherwise hold every one while it works for the next.
    """
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
        release()
    return _KEPT[owner]


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch holding about `size` bytes of the column each, one row at least."""
    if batch.num_rows == 0:
        return
    _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _byte_values(seed: int) -> np.ndarray:
    """256 odd pseudo-random words; upper-case letters share the value of lower-case ones."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


#: Bytes of text whose words are hashed at once; a longer word is a piece of its own.
PIECE_BYTES = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, kept up to a piece of text."""
    mine = kept("powers")
    if "made" not in mine or len(mine["made"][0]) < n:
        size = max(n, PIECE_BYTES + 1)
        with np.errstate(over="ignore"):
            made = []
            for base in (BASE, INVERSE):
                out = np.ones(size, np.uint64)
                have, step = 1, np.uint64(base)
                while have < size:
                    more = min(have, size - have)
                    out[have : have + more] = out[:more] * step
                    step, have = step * step, 2 * have
                made.append(out)
        if size > PIECE_BYTES + 1:  # a very long word: not kept
            return made[0], made[1]
        mine["made"] = made
    return mine["made"][0][:n], mine["made"][1][:n]


def word_bounds(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of bytes with inside[byte], cut at row ends."""
    if len(buf) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    mask = inside[buf]
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = mask[:-1]
    rows = off[:-1][np.diff(off) > 0]
    before[rows] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[rows[1:] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ascending byte ranges, blind to the case of A-Z; equal ranges have equal hashes anywhere."""
    out = np.empty(len(starts), np.uint64)
    values = _byte_values(seed)
    at = 0
    while at < len(starts):  # in pieces: the sums take many times the memory of the text
        begin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + PIECE_BYTES, "right")))
        first, last = starts[at:to] - begin, ends[at:to] - begin
        size = int(last[-1])
        with np.errstate(over="ignore"):
            powers, inverse = _powers(size + 1)
            sums = np.empty(size + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values[buf[begin : begin + size]] * powers[:-1], out=sums[1:])
            out[at:to] = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * _M2)
        at = to
    return out


def byte_class(pattern: bytes | list[int]) -> np.ndarray:
    """A table of 256 flags, set at the given byte values."""
    out = np.zeros(256, bool)
    out[list(pattern)] = True
    return out


#: Words `[^\x20\x09-\x0D]+`: all bytes but space and tab to carriage return.
SPACE_WORD = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, letters, all beyond ASCII.
ALNUM_WORD = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def row_ranges(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 positions of each row number 0..n-1 in the sorted array `rows`."""
    keys = np.arange(n)
    return np.searchsorted(rows, keys, "left"), np.searchsorted(rows, keys, "right")


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
