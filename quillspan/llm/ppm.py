"""Language-model scores by prediction by partial matching, pretrained on all training documents.

The model is a byte-context trie of ORDER context bytes with method-C escapes and symbol exclusion.
A symbol's code length depends on its context and the trained counts alone, so it is worked out
once for each distinct context-and-symbol gram of the corpus and looked up ever after:

1. Rows are dealt into blocks of about BLOCK_BYTES by their numbers and written once. Each block lists
   its distinct grams and words with their training counts, cut into buckets by hash.
2. FAN blocks at a time add up their counts bucket by bucket, whole arrays at once; the sums are
   blocks of the next level, cut into finer buckets where they have grown, until one is left. A row
   holds about ROW_BYTES on every level, so rows are in proportion to the input, no task adds up
   more than FAN of them, and no row is one word or gram.
3. Distinct grams are regrouped by their last two context bytes, which share all contexts of order
   two and more; order one and zero are tables of 65,536 and 256 counts. Of two bytes with more
   than HOT distinct grams, the groups share three context bytes, and the order-two counts, at most
   256 for each such pair of bytes, are sent along. There the escapes, exclusions and code lengths
   of all grams are found, those without training counts included.
4. Values go back down the levels to the blocks that asked, and each block scores its documents.

Counts cover every training document; nothing is sampled or cut off, and what is shuffled grows
with the distinct grams and words of the blocks. A text starts after ORDER zero bytes and ends with
an end symbol (byte 255, which UTF-8 never holds). A null text is an empty one: its score is that
of the end symbol. Rows are scored one by one, so ids may repeat or be null; equal texts have equal
scores. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.langid import held_out
from quillspan.llm.scratch import written
from quillspan.llm.textbatch import SPACE_WORD, mix, steps, text_buffer, word_bounds, word_hashes

ORDER = 4
BLOCK_BYTES = 16 << 20
#: Blocks that are added up at once, bits of a block's first buckets, bytes of keys in a row.
FAN, BITS, ROW_BYTES = 64, 5, 1 << 20
#: Distinct grams of a task of the trie, and of one two-byte context before it is divided.
PLACE, HOT = 1 << 19, 1 << 20
#: Bytes of text in one numpy step inside a block.
STEP = 2 << 20
END_WORD = np.uint64(0x656E642D6F662D74)
END = 255


def grams_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each symbol, symbols per row): ORDER context bytes and the symbol, the end symbol last in each row."""
    n = np.diff(off)
    padded = np.zeros(len(buf) + len(n) * (ORDER + 1), np.uint8)
    begin = off[:-1] + np.arange(len(n)) * (ORDER + 1)
    place = np.arange(len(buf)) + np.repeat(begin - off[:-1] + ORDER, n)
    padded[place] = buf
    padded[begin + ORDER + n] = END
    code = padded.astype(np.uint64)
    gram = code.copy()
    for back in range(1, ORDER + 1):
        gram[back:] |= code[:-back] << np.uint64(8 * back)
    keep = np.ones(len(padded), bool)
    for j in range(ORDER):
        keep[begin + j] = False
    return gram[keep], n + 1


def tokens_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash of each token, row of each token), the end token last."""
    starts, ends, rows = word_bounds(buf, off, SPACE_WORD)
    words = np.concatenate([word_hashes(buf, starts, ends), np.full(len(off) - 1, END_WORD)])
    return words, np.concatenate([rows, np.arange(len(off) - 1)])


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def code_lengths(grams: np.ndarray, counts: np.ndarray, first: np.ndarray, zeroth: np.ndarray, hot: np.ndarray | None = None, second: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each gram's symbol after its context.

    `grams` holds all distinct grams (ascending) whose contexts share their last two bytes with any
    of them, `counts` their training counts (0: asked for only); `first` is the 256 x 256 table of
    order-one counts, `zeroth` the 256 order-zero counts. Of the two-byte contexts `hot`, the grams
    are those that share three bytes, and `second` has the order-two keys and counts.
    """
    symbol = (grams & np.uint64(255)).astype(np.int64)
    result = np.zeros(len(grams))
    open_ = np.ones(len(grams), bool)
    above_q = np.zeros(len(grams), np.int64)  # distinct symbols of the next longer context
    above: tuple | None = None  # its seen grams: (context and symbol keys)
    for order in range(ORDER, -1, -1):
        mask = np.uint64((1 << (8 * (order + 1))) - 1)
        asked = grams & mask
        if order >= 2:
            use = counts > 0
            keys, seen_counts = [asked[use]], [counts[use]]
            if order == 2 and hot is not None and len(hot):
                own = ~np.isin(keys[0] >> np.uint64(8), hot)
                keys, seen_counts = [keys[0][own], second[0]], [seen_counts[0][own], second[1]]
            key, count = summed(keys, seen_counts)
        elif order == 1:
            at = np.flatnonzero(first.ravel())
            key, count = at.astype(np.uint64), first.ravel()[at]
        else:
            at = np.flatnonzero(zeroth)
            key, count = at.astype(np.uint64), zeroth[at]

        def look(x: np.ndarray, key=key, count=count) -> np.ndarray:
            if not len(key):
                return np.zeros(len(x), np.int64)
            i = np.minimum(np.searchsorted(key, x), len(key) - 1)
            return np.where(key[i] == x, count[i], 0)

        context, total = summed([key >> np.uint64(8)], [count])
        _, distinct = summed([key >> np.uint64(8)], [np.ones(len(key), np.int64)])

        def by_context(x: np.ndarray, values: np.ndarray, context=context) -> np.ndarray:
            if not len(context):
                return np.zeros(len(x), np.int64)
            i = np.minimum(np.searchsorted(context, x), len(context) - 1)
            return np.where(context[i] == x, values[i], 0)

        own = asked >> np.uint64(8)
        n, q = by_context(own, total), by_context(own, distinct)
        # symbols of the longer context are excluded: their counts here, summed per longer context
        if above is not None and len(above):
            longer, gone = summed([above >> np.uint64(8)], [look(above & mask)])
            wide = (grams & np.uint64((1 << (8 * (order + 2))) - 1)) >> np.uint64(8)
            i = np.minimum(np.searchsorted(longer, wide), len(longer) - 1)
            n = n - np.where(longer[i] == wide, gone[i], 0)
        fresh = q - above_q
        c = look(asked)
        seen = open_ & (q > 0)
        hit = seen & (c > 0)
        result[hit] += np.log10(c[hit] / (n[hit] + fresh[hit]))
        miss = seen & (c == 0) & (fresh > 0)
        result[miss] += np.log10(fresh[miss] / (n[miss] + fresh[miss]))
        open_ &= ~hit
        above, above_q = key, q
    left = 256 - above_q
    result[open_] -= np.log10(np.maximum(left[open_], 1))
    return result


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _texts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The block's rows with texts, in steps of about STEP bytes."""
    unzip = zstandard.ZstdDecompressor()
    for batch in table.to_batches(max_chunksize=512):
        texts = [unzip.decompress(z).decode("utf-8", "surrogatepass") for z in batch["z"].to_pylist()]
        held = batch["held"]
        more = pa.RecordBatch.from_arrays([batch["row"], held, pa.array(texts, pa.large_string())], names=["row", "held", "text"])
        yield from steps(more, "text", STEP)


def _ordered(keys: np.ndarray, kind: str) -> np.ndarray:
    """The uniform 64-bit number by which a key is bucketed and ordered within a block."""
    return mix(keys) if kind == "g" else keys


def _distinct(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Distinct grams and words of a block with training counts, in bucket order."""
    parts: dict[str, list] = {"g": [[], []], "w": [[], []]}
    for batch in _texts(table):
        buf, off = text_buffer(batch.column(2))
        train = ~batch.column(1).to_numpy(zero_copy_only=False)
        grams, n = grams_of(buf, off)
        words, rows = tokens_of(buf, off)
        for kind, keys, use in (("g", grams, np.repeat(train, n)), ("w", words, train[rows])):
            for some, add in ((keys[use], 1), (keys[~use], 0)):
                key, count = np.unique(some, return_counts=True)
                parts[kind][0].append(key)
                parts[kind][1].append(count * add)
    out = {}
    for kind, (keys, counts) in parts.items():
        key, count = summed(keys, counts)
        order = np.argsort(_ordered(key, kind))
        out[kind] = key[order], count[order]
    return out


def _cut(keys: np.ndarray, kind: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds) of keys in bucket order."""
    bucket = (_ordered(keys, kind) >> np.uint64(64 - bits)).astype(np.int64)
    change = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[change], np.append(change, len(keys))


def _cut_rows(out: dict[str, list], kind: str, unit: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> None:
    """Append a row per bucket of keys that are in bucket order."""
    buckets, bounds = _cut(keys, kind, bits)
    for b, lo, hi in zip(buckets.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        for c, v in zip(out, (kind, unit, b, _bytes(keys[lo:hi]), _bytes(counts[lo:hi].astype(np.int64)))):
            out[c].append(v)


def finer(sums: DataFrame, bits: int) -> DataFrame:
    """Rows of sums cut into buckets of `bits` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: dict[str, list] = {c: [] for c in ("kind", "unit", "bucket", "keys", "counts")}
                _cut_rows(out, row["kind"], row["unit"], np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64), bits)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("kind", pa.string()), ("unit", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return sums.mapInArrow(run, sums.schema)


def _word_totals(words: DataFrame) -> tuple[int, int]:
    """All training tokens and the distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.frombuffer(x, np.int64) for x in batch["counts"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [int(sum(c.sum() for c in counts))], "v": [int(sum((c > 0).sum() for c in counts))]})

    row = words.mapInArrow(run, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    return row["n"], row["v"]


def _pair(grams: np.ndarray) -> np.ndarray:
    """The last two context bytes."""
    return (grams >> np.uint64(8)) & np.uint64(0xFFFF)


def _lengths(grams: DataFrame, bits: int, hot: int) -> DataFrame:
    """(kind, unit, bucket, keys, values) of all distinct grams: code lengths, in buckets of `bits` bits."""
    spark = grams.sparkSession

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # order-one counts, then distinct grams of each two-byte context behind them
        table = np.zeros(1 << 17, np.int64)
        for batch in batches:
            for g, t in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist()):
                g = np.frombuffer(g, np.uint64)
                np.add.at(table, (g & np.uint64(0xFFFF)).astype(np.int64), np.frombuffer(t, np.int64))
                table[1 << 16 :] += np.bincount(_pair(g).astype(np.int64), minlength=1 << 16)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["at", "n"])

    found = np.zeros(1 << 17, np.int64)
    for r in grams.mapInArrow(tables, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 131,072 rows
        found[r["at"]] = r["n"]
    first, distinct = found[: 1 << 16].reshape(256, 256), found[1 << 16 :]
    places = max(64, -(-int(distinct.sum()) // PLACE))
    divided = np.flatnonzero(distinct > hot).astype(np.uint64)

    def second_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, t in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist()):
                g, t = np.frombuffer(g, np.uint64), np.frombuffer(t, np.int64)
                use = np.isin(_pair(g), divided) & (t > 0)
                key, count = summed([g[use] & np.uint64(0xFFFFFF)], [t[use]])
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(count)], names=["at", "n"])

    second = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(divided):  # at most 256 rows for each divided context
        got = sorted((r["at"], r["n"]) for r in grams.mapInArrow(second_order, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator())
        second = np.array([a for a, _ in got], np.uint64), np.array([n for _, n in got], np.int64)
    low = spark.sparkContext.broadcast((first, first.sum(axis=0), divided, second))

    def to_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, t in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist()):
                g, t = np.frombuffer(g, np.uint64), np.frombuffer(t, np.int64)
                pair = _pair(g)
                pair = np.where(np.isin(pair, divided), ((g >> np.uint64(8)) & np.uint64(0xFFFFFF)) | np.uint64(1 << 32), pair)
                place = (mix(pair) % np.uint64(places)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                change = np.flatnonzero(np.diff(place[order], prepend=-1))
                cuts = np.split(order, change[1:])
                yield pa.RecordBatch.from_arrays([pa.array(place[order][change]), pa.array([_bytes(g[c]) for c in cuts], pa.binary()), pa.array([_bytes(t[c]) for c in cuts], pa.binary())], names=["place", "keys", "counts"])

    def trie(table: pa.Table) -> pa.Table:
        known, total = summed([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()], [np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()])
        value = code_lengths(known, total, *low.value)
        order = np.argsort(mix(known))
        known, value = known[order], value[order]
        buckets, bounds = _cut(known, "g", bits)
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return pa.table({"kind": ["g"] * len(spans), "unit": [0] * len(spans), "bucket": buckets, "keys": [_bytes(known[a:b]) for a, b in spans], "values": [_bytes(value[a:b]) for a, b in spans]})

    placed = grams.mapInArrow(to_places, "place long, keys binary, counts binary")
    return placed.groupBy("place").applyInArrow(trie, "kind string, unit long, bucket long, keys binary, values binary")


def _handed_back(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Values of the keys of each row that asked, as 8 bytes each, whatever their type."""
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in known["keys"].to_pylist()] or [np.zeros(0, np.uint64)])
    value = np.concatenate([np.frombuffer(x, np.uint64) for x in known["values"].to_pylist()] or [np.zeros(0, np.uint64)])
    order = np.argsort(key)
    key, value = key[order], value[order]
    values = [_bytes(value[np.searchsorted(key, np.frombuffer(x, np.uint64))]) for x in asked["keys"].to_pylist()]
    return pa.table({"kind": asked["kind"], "unit": asked["unit"], "bucket": asked["bucket"], "keys": asked["keys"], "values": pa.array(values, pa.binary())})


def scored(docs: DataFrame, text: str = "text", key: str = "doc_id", held=None, block_bytes: int = BLOCK_BYTES, hot: int = HOT, fan: int = FAN, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    `held` is a Boolean column: rows that are not learned from.
    """
    held = held_out(key, 7, 2) if held is None else held
    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            for part in steps(batch):
                z = [tool.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(z, pa.binary())], names=["row", "held", "z"])

    rows = docs.select(F.col(key).alias("row"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.mapInArrow(zipped, f"row {kind}, held boolean, z binary")
    dealt = written(dealt.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "texts")

    def gather(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        out: dict[str, list] = {c: [] for c in ("kind", "unit", "bucket", "keys", "counts")}
        for name, (keys, counts) in _distinct(table).items():
            _cut_rows(out, name, block, keys, counts, BITS)
        return pa.table(out)

    def merge(table: pa.Table) -> pa.Table:
        name, unit, bucket = (table[c][0].as_py() for c in ("kind", "unit", "bucket"))
        keys, counts = summed([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()], [np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()])
        order = np.argsort(_ordered(keys, name))
        return pa.table({"kind": [name], "unit": [unit // fan], "bucket": [bucket], "keys": [_bytes(keys[order])], "counts": [_bytes(counts[order])]})

    schema = "kind string, unit long, bucket long, keys binary, counts binary"
    group = ["kind", F.floor(F.col("unit") / fan).alias("parent"), "bucket"]
    levels = [(written(dealt.groupBy("block").applyInArrow(gather, schema), "pairs"), BITS)]
    units = blocks
    while True:
        units = -(-units // fan)
        merged = written(levels[-1][0].groupBy(*group).applyInArrow(merge, schema), "sums")
        if units == 1:
            break
        wide = merged.agg(F.coalesce(F.avg(F.octet_length("keys")), F.lit(0)).alias("n")).first()["n"]
        more = max(0, int(wide // row_bytes).bit_length())
        levels.append((finer(merged, levels[-1][1] + more) if more else merged, levels[-1][1] + more))

    words, grams = (merged.where(F.col("kind") == k) for k in "wg")
    n_tokens, n_words = _word_totals(words)
    known = words.select("kind", "unit", "bucket", "keys", F.col("counts").alias("values")).union(_lengths(grams, levels[-1][1], hot))
    for level in range(len(levels) - 1, -1, -1):
        asked, bits = levels[level]
        finer_by = levels[min(level + 1, len(levels) - 1)][1] - bits
        above = known.select("kind", F.col("unit").alias("parent"), F.shiftright("bucket", finer_by).alias("bucket"), "keys", "values")
        below = asked.select("kind", group[1], "bucket", "unit", "keys")
        known = below.groupBy("kind", "parent", "bucket").cogroup(above.groupBy("kind", "parent", "bucket")).applyInArrow(_handed_back, "kind string, unit long, bucket long, keys binary, values binary")
    values = known.select("kind", "bucket", F.col("unit").alias("block"), "values")

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        found = {}
        for name, (keys, _) in _distinct(texts).items():
            mine = sorted((b, v) for k, b, v in zip(known["kind"].to_pylist(), known["bucket"].to_pylist(), known["values"].to_pylist()) if k == name)
            value = np.frombuffer(b"".join(v for _, v in mine), np.float64 if name == "g" else np.int64)
            order = np.argsort(keys)
            found[name] = keys[order], value[order]
        out: dict[str, list] = {c: [] for c in ("row", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        chunks = []
        for batch in _texts(texts):
            buf, off = text_buffer(batch.column(2))
            n = batch.num_rows
            grams, count = grams_of(buf, off)
            key, value = found["g"]
            total = np.bincount(np.repeat(np.arange(n), count), weights=value[np.searchsorted(key, grams)], minlength=n)
            words, rows = tokens_of(buf, off)
            key, value = found["w"]
            c = value[np.searchsorted(key, words)]
            base = np.bincount(rows, weights=np.log10((c + 1) / (n_tokens + n_words + 1)), minlength=n)
            chunks.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.bincount(rows, minlength=n)), pa.array(np.bincount(rows[c > 0], minlength=n)), pa.array(np.full(n, n_tokens, np.int64)), pa.array(base), pa.array(total)], names=list(out)))
        return pa.Table.from_batches(chunks)

    schema = f"row {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(score, schema).withColumnRenamed("row", key)


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
