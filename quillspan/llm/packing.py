"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document longer than a window is cut into full windows and a rest, and the rest at multiples of
GRAIN, since many middling pieces balance better than few large ones. Pieces are dealt into blocks
by a hash of their values, repeated ones by their row numbers; in each block k = ceil(sum / capacity) partial partitions are
merged, the two with the largest spread first and with opposing imbalances, until one is left:
k near-equal windows. Where the fullest exceeds the capacity, k rises and the block is dealt
again. A block holds about BLOCK pieces whatever the size of the table, so no task grows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.bpe import KEPT_BYTES, LOOKUP_BYTES, VOCABULARY, merger
from quillspan.llm.scratch import written
from quillspan.llm.textbatch import steps

#: Expected documents of a block; the number of blocks follows the number of documents.
BLOCK = 1500
#: Longest piece, in ids, of what does not fill a window of its own.
GRAIN = 1024
#: Sequences of a block are numbered within 2**ROOM.
ROOM = 32


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each size, sums of the k windows) by k-way largest differencing.

    `sizes` is best given in descending order; equal spreads are taken in order of creation,
    so the result is a function of the sequence.
    """
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64), np.array([int(sizes.sum())] + [0] * (k - 1), np.int64)
    # sums are kept negative and ascending, so that the largest comes first
    sums: list[list[int] | None] = [[-s] for s in sizes.tolist()]
    made: list[tuple[int, int, int | list[int]] | None] = [None] * n
    heap = [(-s, i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        if len(x) < len(y):
            a, b, x, y = b, a, y, x
        sums[a] = sums[b] = None
        if len(y) == 1:  # the common case: one size goes to an empty or to the least full window
            total = y[0] + (x.pop() if len(x) == k else 0)
            at = bisect_right(x, total)
            x.insert(at, total)
            made.append((a, b, at))
        else:
            width = min(k, len(x) + len(y))
            x = x + [0] * (width - len(x))
            for i, v in enumerate(y):
                x[width - 1 - i] += v
            order = sorted(range(width), key=x.__getitem__)
            x = [x[i] for i in order]
            made.append((a, b, order))
        sums.append(x)
        heapq.heappush(heap, (x[0] - (x[-1] if len(x) == k else 0), len(sums) - 1))
    root = heap[0][1]
    window = np.zeros(n, np.int64)
    todo = [(root, list(range(len(sums[root]))))]
    while todo:
        node, slots = todo.pop()
        if (step := made[node]) is None:
            window[node] = slots[0]
            continue
        a, b, how = step
        if isinstance(how, int):
            own = slots.pop(how)
            todo.append((b, [own]))
            todo.append((a, [*slots, own]))  # the last place is the shared window, or one that a has not got
        else:
            place = [0] * len(how)
            for rank, i in enumerate(how):
                place[i] = slots[rank]
            todo.append((a, place))
            todo.append((b, place[::-1]))
    return window, np.bincount(window, weights=sizes, minlength=k).astype(np.int64)


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window numbers 0.. of the pieces of one block, no window above the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = difference(sizes, k)
        if sums.max(initial=0) <= capacity:
            return window
        k += max(1, k // 256)


def cut_pieces(docs: DataFrame, capacity: int = 4096, text: str = "text", key: str = "doc_id", end_id: int = 2, grain: int = GRAIN, vocabulary: str = VOCABULARY, dictionary: int = KEPT_BYTES) -> DataFrame:
    """(key, start, length, doc_tokens, ids): each document's ids and `end_id`, cut into full windows and pieces of `grain` at most.

    A null or empty text is the end id alone. `ids` holds little-endian unsigned 32-bit numbers.
    `dictionary` bounds the bytes of chunks a worker keeps; a smaller one takes more time, not other ids.
    """
    kind = docs.schema[key].dataType.simpleString()
    tail = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(vocabulary, dictionary)
        for batch in batches:
            for part in steps(batch, size=LOOKUP_BYTES):
                rows, start, ids, whole = [], [], [], []
                found, off = tool.encode(part.column(1))
                for row, (first, last) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    x = found[first:last].tobytes() + tail
                    full = len(x) - len(x) % (4 * capacity)
                    for at, to in [*((a, a + 4 * capacity) for a in range(0, full, 4 * capacity)), *((a, a + 4 * grain) for a in range(full, len(x), 4 * grain))]:
                        rows.append(row)
                        start.append(at // 4)
                        ids.append(x[at:to])
                        whole.append(len(x) // 4)
                length = pa.array([len(x) // 4 for x in ids], pa.int64())
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), length, pa.array(whole, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "start", "length", "doc_tokens", "ids"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, start long, length long, doc_tokens long, ids binary")
    return out.withColumnRenamed("key", key)


def pack(pieces: DataFrame, n_docs: int, capacity: int = 4096, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """`pieces` (key, start, length, ...) with sequence_id and offset.

    All columns of `pieces` stay; give `ids` along to get the windows' contents, leave it out to
    move the plan alone. Repeated rows, with or without a key, are pieces of their own and are spread
    over the blocks; null keys sort last. An empty table gives no rows.
    """
    blocks = max(1, round(n_docs / block))
    extra = [c for c in pieces.columns]
    plain = [c for c in extra if c != "ids"]
    rows = written(pieces.withColumns({"__hash": F.xxhash64(*plain), "__row": F.monotonically_increasing_id()}), "pieces")
    many = rows.groupBy("__hash").agg(F.count("*").alias("__n")).where("__n > 1")
    at = F.when(F.col("__n").isNull(), F.col("__hash")).otherwise(F.xxhash64("__hash", "__row"))
    dealt = rows.join(many, "__hash", "left").withColumn("__block", F.pmod(at, F.lit(blocks))).select(*extra, "__block")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), (key, "ascending"), ("start", "ascending")])
        size = table["length"].to_numpy()
        window = pack_block(size, capacity)
        first = np.lexsort((np.arange(len(size)), window))
        before = np.cumsum(size[first]) - size[first]
        change = np.flatnonzero(np.diff(window[first], prepend=-1))
        offset = np.empty(len(size), np.int64)
        offset[first] = before - np.repeat(before[change], np.diff(np.append(change, len(size))))
        number = (table["__block"].to_numpy() << ROOM) + window
        return table.select(extra).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("__block").applyInArrow(run, schema)


def packed(docs: DataFrame, capacity: int = 4096, dictionary: int = KEPT_BYTES) -> DataFrame:
    """The digest rows of a packing: one per piece, its ids as a CRC-32."""
    pieces = cut_pieces(docs.select("doc_id", "text"), capacity, dictionary=dictionary)
    plan = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(plan, docs.count(), capacity)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
