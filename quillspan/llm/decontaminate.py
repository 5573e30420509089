"""Benchmark decontamination by suffix arrays over the training words.

Every step of about SHARD_BYTES of text is a shard: its words, as 64-bit hashes, are ranked and a
suffix array is built by prefix doubling, `width` words deep. Every test suffix of `width` words or
more is binary-searched by its first `width` words, an item of fewer words as a whole, all at once;
the range found holds all places. Hits that go on along item and document are one match, from the
first word of the first to the last word of the last: so each test suffix has its longest verbatim
match at every place, with its location. Shorter suffixes and matches below `width` words decide
nothing and are not looked for.

Benchmark items reach the executors in blocks of a checked size: each block is broadcast in a pass
of its own, so a benchmark of any size works, and one below the bound takes a single pass. With
more, blocks come through the driver one by one and each pass is written before the next begins.
Only documents with a hit are shuffled, to add up passes; a single pass shuffles nothing.

Null and empty texts have no words and no hits; a null or wordless item has no windows; item ids
are compared as strings, null ids are one item without a name; rows with the same document id are
judged row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import written
from quillspan.llm.textbatch import ALNUM_WORD, expand, steps, text_buffer, word_bounds, word_hashes

#: Text of one suffix-array shard.
SHARD_BYTES = 2 << 20
#: Bytes of benchmark items that one broadcast may hold; a longer item is a block of its own.
BLOCK_BYTES = 8 << 20


class Windows:
    """The test windows of a block of items, as rows of word hashes."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        column = pa.array([t for _, t in items], pa.string())
        buf, off = text_buffer(column)
        starts, ends, rows = word_bounds(buf, off, ALNUM_WORD)
        hashes = word_hashes(buf, starts, ends)
        count = np.bincount(rows, minlength=len(items))
        self.ids = [i for i, _ in items]
        self.width, self.words = width, hashes
        n_windows = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
        first = np.cumsum(count) - count
        self.item_start = first
        self.start = expand(first, n_windows)
        self.item = np.repeat(np.arange(len(items)), n_windows)
        self.item_end = np.repeat(first + count, n_windows)
        self.length = np.minimum(width, self.item_end - self.start)
        # equal windows are searched once
        grid = np.zeros((len(self.start), width + 1), np.uint64)
        for j in range(width):
            has = j < self.length
            grid[has, j] = hashes[self.start[has] + j]
        grid[:, width] = self.length
        self.grid, self.inverse = np.unique(grid, axis=0, return_inverse=True)
        self.inverse = self.inverse.reshape(-1)
        order = np.argsort(self.inverse, kind="stable")
        self.by_window, self.window_at = order, np.searchsorted(self.inverse[order], np.arange(len(self.grid) + 1))


def suffix_array(rank: np.ndarray, row: np.ndarray, depth: int) -> np.ndarray:
    """Positions of words of rank 2 or more, ordered by their first `depth` words, by doubling.

    `row` holds the row of each word in ascending order; the end of a row ranks below all words.
    Words of rank 1 start no suffix of interest: they are one symbol and are not sorted.
    """
    n = len(rank)
    live = np.flatnonzero(rank > 1)
    key = rank.astype(np.int64)
    if depth == 1:
        return live[np.argsort(key[live])]
    have, order = 1, live
    while have < depth:
        to = live + have
        inside = to < n
        to[~inside] = 0
        inside &= row[to] == row[live]
        first, second = key[live], np.where(inside, key[to], 0)
        if n + 2 < 1 << 21:  # both ranks and the position fit one number, which sorts faster than an argsort
            packed = np.sort((first.astype(np.uint64) << np.uint64(42)) | (second.astype(np.uint64) << np.uint64(21)) | live.astype(np.uint64))
            order, seen = (packed & np.uint64((1 << 21) - 1)).astype(np.int64), packed >> np.uint64(21)
        else:
            pair = first * (n + 2) + second
            by = np.argsort(pair)
            order, seen = live[by], pair[by]
        fresh = np.cumsum(np.concatenate(([2], (seen[1:] != seen[:-1]).astype(np.int64)))) if len(order) else order
        key = np.ones(n, np.int64)
        key[order] = fresh
        have *= 2
        if len(order) == 0 or fresh[-1] == len(order) + 1:
            break
    return order


class Shard:
    """Words of one step of texts with their suffix array."""

    def __init__(self, column: pa.Array, depth: int, only: np.ndarray | None = None):
        buf, off = text_buffer(column)
        starts, ends, self.row = word_bounds(buf, off, ALNUM_WORD)
        self.words = word_hashes(buf, starts, ends)
        self.n_words = np.bincount(self.row, minlength=len(column))
        self.depth = depth
        self.row_end = np.cumsum(self.n_words)[self.row] if len(self.row) else np.zeros(0, np.int64)
        # words that no test suffix holds are one symbol: their order among themselves is never asked for
        if only is not None:
            self.symbols = only
            at = np.searchsorted(only, self.words)
            at[at == len(only)] = 0
            self.rank = np.where(only[at] == self.words, at + 2, 1) if len(only) else np.ones(len(self.words), np.int64)
        else:
            self.symbols, back = np.unique(self.words, return_inverse=True)
            self.rank = back.reshape(-1) + 2
        self.sa = suffix_array(self.rank, self.row, depth)

    def find(self, grid: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges [low, high) whose first length[i] words equal grid[i]."""
        at = np.searchsorted(self.symbols, grid)
        at[at == len(self.symbols)] = 0
        known = self.symbols[at] == grid if len(self.symbols) else np.zeros(grid.shape, bool)
        wanted = np.where(known, at + 2, 0)
        inside = np.arange(grid.shape[1])[None, :] < length[:, None]
        possible = (known | ~inside).all(axis=1)
        out = [np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64)]
        todo = np.flatnonzero(possible)
        n = len(self.sa)
        if n == 0 or not len(todo):
            return out[0], out[1]
        for side in (0, 1):
            low, high = np.zeros(len(todo), np.int64), np.full(len(todo), n, np.int64)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                right = open_ & self._before(np.minimum(mid, n - 1), wanted[todo], length[todo], side)
                low = np.where(right, mid + 1, low)
                high = np.where(open_ & ~right, mid, high)
            out[side][todo] = low
        return out[0], out[1]

    def _before(self, mid: np.ndarray, wanted: np.ndarray, length: np.ndarray, equal: int) -> np.ndarray:
        """Whether suffix mid[i] sorts before (or, with `equal`, is a continuation of) wanted[i]."""
        at = self.sa[mid]
        state = np.zeros(len(mid), np.int8)
        for j in range(wanted.shape[1]):
            ask = np.flatnonzero((state == 0) & (j < length))
            if not len(ask):
                break
            place = at[ask] + j
            have = np.where(place < self.row_end[at[ask]], self.rank[np.minimum(place, len(self.rank) - 1)], 0)
            state[ask] = np.sign(have - wanted[ask, j])
        return (state < 0) | ((state == 0) & bool(equal))


def item_blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in lists of at most `size` bytes of text (one item at least), streamed through the driver."""
    block, held = [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"), F.octet_length(text).alias("n"))
    for row in rows.toLocalIterator():
        if block and held + row.n > size:
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += row.n
    if block:
        yield block


_MATCH = "struct<item:string,item_word:long,word:long,length:long>"


class Found:
    """All places of a block's windows in one shard."""

    def __init__(self, texts: pa.Array, windows: Windows, only: np.ndarray):
        self.windows, self.shard = windows, Shard(texts, windows.width, only)
        self.length = windows.grid[:, windows.width].astype(np.int64)
        low, high = self.shard.find(windows.grid[:, : windows.width], self.length)
        found = np.flatnonzero(high > low)
        n = high[found] - low[found]
        self.place, self.window = self.shard.sa[expand(low[found], n)], np.repeat(found, n)

    def matches(self) -> tuple[np.ndarray, ...]:
        """(row, item number, word of the item, word of the row, words) of every maximal match, by row and place."""
        w, at = self.windows, self.windows.window_at
        per = at[self.window + 1] - at[self.window]
        suffix = w.by_window[expand(at[self.window], per)]
        item, here, there = w.item[suffix], w.start[suffix], np.repeat(self.place, per)
        order = np.lexsort((there, there - here, item))
        item, here, there = item[order], here[order], there[order]
        size, row = np.repeat(self.length[self.window], per)[order], self.shard.row[there]
        new = np.ones(len(order), bool)
        new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (there[1:] != there[:-1] + 1) | (here[1:] != here[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(order))[: len(first)] - 1
        words = there[last] - there[first] + size[last]
        begin = np.cumsum(self.shard.n_words) - self.shard.n_words
        out = row[first], item[first], here[first] - w.item_start[item[first]], there[first] - begin[row[first]], words
        by = np.lexsort((out[2], out[1], out[3], out[0]))
        return tuple(x[by] for x in out)


def _windows(items: list[tuple[str | None, str]], width: int) -> tuple[Windows, np.ndarray]:
    made = Windows(items, width)
    return made, np.unique(made.words)


def hits(docs: DataFrame, items, width: int = 10, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document against one block of items (a list, or the broadcast of one).

    (key, n_words, hit_words array<long> of word positions, items array<string>, matches), the last
    an array of (item, item_word, word, length): every maximal verbatim match of `width` words or
    more, or of a whole shorter item.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(items) if isinstance(items, list) else items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, only = _windows(shared.value, width)
        for batch in batches:
            for part in steps(batch, size=shard_bytes):
                yield one(part, Found(part.column(1), windows, only))

    def one(part: pa.RecordBatch, found: Found) -> pa.RecordBatch:
        shard, names = found.shard, found.windows.ids
        cover = np.zeros(len(shard.words) + 1, np.int64)
        np.add.at(cover, found.place, 1)
        np.add.at(cover, found.place + found.length[found.window], -1)
        word = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        row = shard.row[word]
        first = np.cumsum(shard.n_words) - shard.n_words
        lists = lambda rows, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=part.num_rows)))), pa.int32()), values)
        of, item, item_word, at, words = found.matches()
        held: list[set] = [set() for _ in range(part.num_rows)]
        for r, i in zip(of.tolist(), item.tolist()):
            held[r].add(names[i])
        spans = pa.StructArray.from_arrays([pa.array([names[i] for i in item.tolist()], pa.string()), *(pa.array(x, pa.int64()) for x in (item_word, at, words))], ["item", "item_word", "word", "length"])
        arrays = [part.column(0), pa.array(shard.n_words, pa.int64()), lists(row, pa.array(word - first[row], pa.int64())), pa.array([sorted(x, key=lambda i: (i is None, i)) for x in held], pa.list_(pa.string())), lists(of, spans)]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "n_words", "hit_words", "items", "matches"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_words long, hit_words array<long>, items array<string>, matches array<{_MATCH}>")
    return out.withColumnRenamed("key", key)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", key: str = "doc_id", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, hit_words, items, matches) of every document against all items.

    One block of items needs no shuffle. With more, the rows are numbered and written once, and the
    passes are added up by that number, so repeated and null keys stay rows of their own.
    """
    blocks = item_blocks(benchmark, item, text, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return hits(docs, first, width, text, key)
    row = F.struct(F.monotonically_increasing_id().alias("number"), F.col(key).alias("key"))
    rows = written(docs.select(row.alias("row"), F.col(text).alias("text")), "rows")
    out = None
    for block in chain((first, second), blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        one = hits(rows, shared, width, "text", "row")
        one = written(one if out is None else one.where(F.size("hit_words") > 0), "pass")
        shared.destroy()
        out = one if out is None else out.unionByName(one)
    every = lambda c: F.flatten(F.collect_list(c))
    out = out.groupBy("row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(every("hit_words"))).alias("hit_words"), F.array_sort(F.array_distinct(every("items"))).alias("items"), every("matches").alias("matches"))
    place = F.transform("matches", lambda m: F.struct(m["word"].alias("w"), m.alias("m")))
    return out.select(F.col("row.key").alias(key), "n_words", "hit_words", "items", F.transform(F.array_sort(place), lambda x: x["m"]).alias("matches"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item; every row is judged by its own text."""
    blocks = item_blocks(benchmark, "item_id", "text", block_bytes)
    block = next(blocks, None)
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs, block = _without(docs, shared, width), next(blocks, None)
        if block is not None:  # one block of items at a time on the driver
            docs = written(docs, "clean")
            shared.destroy()
    return docs


def _without(docs: DataFrame, shared, width: int) -> DataFrame:
    """One pass over whole rows: those with a hit are left out where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, only = _windows(shared.value, width)
        for batch in batches:
            for part in steps(batch, size=SHARD_BYTES):
                found = Found(part.column(part.schema.get_field_index("text")), windows, only)
                keep = np.ones(part.num_rows, bool)
                keep[found.shard.row[found.place]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document judged against every benchmark item."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0)).cast("long").alias("longest"),
    )


#: The same rows in DuckDB: word lists, all windows of documents and items, joined on the window; matches are runs of hits.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS nr, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT nr, item_id, k AS p, least(10, len(w)) AS l, array_to_string(w[k + 1 : k + least(10, len(w))], ' ') AS win
  FROM (SELECT nr, item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)
), ls AS (SELECT DISTINCT l FROM iw), dw AS (
  SELECT doc_id, k, l, array_to_string(w[k + 1 : k + l], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS k FROM d, ls WHERE len(w) >= l)
), h AS (SELECT doc_id, k, dw.l, nr, p, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.l = iw.l),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, nr, l, k - p AS diagonal, k - row_number() OVER (PARTITION BY doc_id, nr, k - p ORDER BY k) AS run FROM h),
m AS (SELECT doc_id, count(*) AS n_matches, max(n) AS longest FROM (SELECT doc_id, count(*) + any_value(l) - 1 AS n FROM g GROUP BY doc_id, nr, diagonal, run) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN m USING (doc_id)
"""
