"""Near duplicates on five-word shingles: MinHash bands, sequential Bayesian verification, exact check.

1. Every whole text is read once: its distinct shingles, as 64-bit hashes, give a set key (two
   64-bit sums), a signature and band keys. Equal sets are one class from here on, so copies
   cost one row each and no links.
2. Classes meet in band buckets. Each member is paired with its bucket's hub alone: the member whose
   buckets are the largest, as the original of many copies is. What these links leave apart is
   compared in a second round: pairs of a bucket whose members are in different components. In
   small buckets by a join; in large ones the members outside the bucket's main component, the
   strays, meet blocks of that component and blocks of each other, each pair of members in the
   first bucket they share, with the exact check in place, so that only links which connect
   something become rows. Blocks have BLOCK members or the root of the bucket's size, whichever is
   more. So a member of the main component is one row while the strays fit a block, k strays of n
   members are k * sqrt(n) rows at worst, and no link between components is left out.
3. Pairs are compared by batches of their signatures. After each batch the posterior of the
   similarity, under a flat prior, is known; a pair goes once the chance that it reaches the
   threshold falls below `miss`. The survivors' full sets are compared exactly.
4. Connected components of the links are the groups.

A text of fewer words than a shingle is one shingle; a null or wordless text has an empty set and
is linked with nothing. Rows that share a document id are nodes of their own. Ties go to the
smallest key, then to the smallest text hash; null keys come last. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.graph import components
from quillspan.llm.scratch import drop, written
from quillspan.llm.textbatch import SPACE_WORD, STEP_BYTES, expand, mix, steps, text_buffer, word_bounds, word_hashes

WORDS = 5
#: Signature values per band, and the greatest chance that a pair at the threshold meets in no band.
ROWS, UNMET = 5, 8e-7
#: Signature values compared per Bayesian step.
BATCH = 24
#: Chance, per step, of losing a pair that reaches the threshold.
MISS = 1e-7
#: Buckets of up to this many members are compared by a join, larger ones by pairs of blocks of BLOCK members or more.
SMALL = 16
BLOCK = 256
_STEP_SHINGLES = 1 << 15


def bands_for(percent: int) -> int:
    """The fewest bands that leave a pair at the threshold unmet with chance UNMET at most: 24 at 85, 36 at 80."""
    apart = 1 - (percent / 100) ** ROWS
    return 1 if apart <= 0 else ceil(log(UNMET) / log(apart))


#: Bands at op1's threshold.
BANDS = bands_for(85)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each row; number of them per row)."""
    buf, off = text_buffer(column)
    starts, ends, rows = word_bounds(buf, off, SPACE_WORD)
    n = len(off) - 1
    words = word_hashes(buf, starts, ends)
    count = np.bincount(rows, minlength=n)
    first = np.cumsum(count) - count
    many = np.maximum(count - WORDS + 1, np.minimum(count, 1))
    at = expand(first, many)
    with np.errstate(over="ignore"):
        made = np.zeros(len(at), np.uint64)
        left = np.repeat(count, many)
        for j in range(WORDS):
            has = j < left
            step = made * np.uint64(0xD1342543DE82EF95) + words[np.minimum(at + j, len(words) - 1)] if len(at) else made
            made = np.where(has, step, made)
        made = mix(made + np.minimum(left, WORDS).astype(np.uint64))
    bound = np.concatenate(([0], np.cumsum(many)))
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        made[a:b].sort()
    keep = np.ones(len(made), bool)
    if len(made):
        keep[1:] = made[1:] != made[:-1]
        keep[bound[:-1][many > 0]] = True
    row = np.repeat(np.arange(n), many)
    return made[keep], np.bincount(row[keep], minlength=n)


def unpacked_sets(packed: list[bytes]) -> list[np.ndarray]:
    """Distinct shingles of each compressed text, hashed in steps of about STEP_BYTES of text."""
    unzip = zstandard.ZstdDecompressor()
    out: list[np.ndarray] = []
    held, size = [], 0

    def flush() -> None:
        if held:
            sets, sizes = shingles(pa.array(held, pa.large_string()))
            out.extend(np.split(sets, np.cumsum(sizes)[:-1]))
            held.clear()

    for z in packed:
        text = unzip.decompress(z)
        if size + len(text) > STEP_BYTES:
            flush()
            size = 0
        held.append(text.decode("utf-8", "surrogatepass"))
        size += len(text)
    flush()
    return out


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each row's set; empty sets give 0."""
    bound = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(salt)))))
            out.append((total[bound[1:]] - total[bound[:-1]]).view(np.int64))
    return out[0], out[1]


def _constants(bands: int) -> tuple[np.ndarray, np.ndarray]:
    made = mix(np.arange(1, 2 * bands * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (made[::2] >> np.uint64(32)).astype(np.uint32), (made[1::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(sets: np.ndarray, sizes: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Minima of bands * ROWS hash functions per row; rows with an empty set get zeros."""
    masks, factors = _constants(bands)
    k = len(masks)
    out = np.zeros((len(sizes), k), np.uint32)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    x = (sets >> np.uint64(32)).astype(np.uint32)
    bound = np.concatenate(([0], np.cumsum(sizes[rows])))
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(bound, bound[at] + _STEP_SHINGLES, "right")) - 1)
        part = x[bound[at] : bound[to]]
        off = bound[at:to] - bound[at]
        made = np.empty_like(part)
        low = np.empty((k, to - at), np.uint32)
        for i in range(k):
            np.bitwise_xor(part, masks[i], out=made)
            np.multiply(made, factors[i], out=made)
            low[i] = np.minimum.reduceat(made, off)
        out[rows[at:to]] = low.T
        at = to
    return out


@lru_cache(maxsize=64)
def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = BANDS * ROWS) -> tuple[int, ...]:
    """For 1, 2, .. batches: the fewest matches at which P(similarity >= threshold) is not below `miss`.

    With a flat prior the posterior after m matches of n is Beta(m + 1, n - m + 1); its upper tail
    at t is the chance of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(batch, total + 1, batch):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Which rows of two signature matrices stay after all Bayesian steps."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for step, least in enumerate(least_matches(threshold, miss, BATCH, a.shape[1])):
        cut = slice(step * BATCH, (step + 1) * BATCH)
        matches[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Fixed-size binary values as a matrix of 16-bit numbers."""
    buf, off = text_buffer(column.cast(pa.large_binary()))
    return buf.view(np.uint16).reshape(len(off) - 1, -1) if len(off) > 1 else np.zeros((0, ROWS), np.uint16)


def document_sets(docs: DataFrame, text: str = "text", key: str = "doc_id", bands: int = BANDS) -> DataFrame:
    """(key, hash, n_shingles, node, guard, sig, bands) per row, hash a 64-bit hash of the text; the last four null for empty sets."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sets, sizes = shingles(part.column(1))
                node, guard = set_keys(sets, sizes)
                sig = signatures(sets, sizes, bands)
                empty = sizes == 0
                with np.errstate(over="ignore"):
                    band = np.zeros((len(sizes), bands), np.uint64)
                    for j in range(ROWS):
                        band = band * np.uint64(0xD1342543DE82EF95) + sig[:, j::ROWS]
                    band = mix(band + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                short = np.ascontiguousarray((sig >> 16).astype(np.uint16))
                sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(short.shape[1] * 2), len(sizes), [None, pa.py_buffer(short)]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * bands, pa.int32()), pa.array(band.reshape(-1), pa.int64()))
                gone = pa.array(empty)
                null = lambda x: pa.compute.if_else(gone, pa.scalar(None, x.type), x)
                arrays = [part.column(0), part.column(2), pa.array(sizes, pa.int64()), null(pa.array(node)), null(pa.array(guard)), null(sigs), pa.array([None if e else x for e, x in zip(empty.tolist(), lists.to_pylist())], pa.list_(pa.int64())) if empty.any() else lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "hash", "n_shingles", "node", "guard", "sig", "bands"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash")).mapInArrow(run, f"key {kind}, hash long, n_shingles long, node long, guard long, sig binary, bands array<long>")
    return out.withColumnRenamed("key", key)


def _filtered(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that the Bayesian steps keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = survivors(_matrix(batch.column(2)), _matrix(batch.column(3)), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    two = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets satisfy 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                keep = np.zeros(batch.num_rows, bool)
                for i, (x, y) in enumerate(zip(*(unpacked_sets(batch.column(c).to_pylist()) for c in (2, 3)))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one = texts.select(F.col("node").alias("a"), F.col("z").alias("za"))
    two = texts.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _node_texts(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """(node, z): one compressed text of each wanted class (node, key, hash); a clash of hashes is settled by the set key."""
    kind = docs.schema[key].dataType.simpleString()

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in steps(batch):
                z = [tool.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(z, pa.binary())], names=["key", "hash", "z"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = unpacked_sets(batch.column(1).to_pylist())
                keys, _ = set_keys(np.concatenate(found), np.array([len(x) for x in found]))
                yield batch.filter(pa.array(keys == batch.column(0).to_numpy()))

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    made = rows.mapInArrow(zipped, f"key {kind}, hash long, z binary")
    found = made.join(wanted, made["key"].eqNullSafe(wanted[key]) & (made["hash"] == wanted["hash"]))
    return found.select("node", "z").mapInArrow(own, "node long, z binary").dropDuplicates(["node"])


def blocks_of(open_: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bucket, band, i, j, main_block, left, own, node, root): the members of large buckets in the pairs of blocks they are compared in.

    A pair of blocks is (bucket, i, j, main_block): block i of the strays (left) with block j of the
    main component (main_block), or with block j >= i of the strays; own marks a block with itself.
    """
    col = F.col
    mine = open_.where("node != pivot").withColumn("width", F.greatest(F.lit(block), F.ceil(F.sqrt("size")).cast("int")))
    mine = mine.withColumns({"strays": F.ceil((col("size") - col("held")) / col("width")).cast("int"), "mains": F.ceil(col("held") / col("width")).cast("int")})
    stray = col("root") != col("main")
    mine = mine.withColumn("mine", F.pmod(F.xxhash64("node"), F.when(stray, col("strays")).otherwise(col("mains"))).cast("int"))
    pair = lambda i, j, left, main: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"), F.lit(main).alias("main_block"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_main = F.transform(upto(col("mains")), lambda k: pair(col("mine"), k, True, True))
    lower, higher = (F.transform(F.filter(upto(col("strays")), f), g) for f, g in ((lambda k: k >= col("mine"), lambda k: pair(col("mine"), k, True, False)), (lambda k: k < col("mine"), lambda k: pair(k, col("mine"), False, False))))
    at = F.when(stray, F.concat(with_main, lower, higher)).otherwise(F.transform(upto(col("strays")), lambda k: pair(k, col("mine"), False, True)))
    out = mine.withColumn("at", F.explode(at)).select("bucket", "band", "at.*", "node", "root")
    return out.withColumn("own", (col("i") == col("j")) & ~col("main_block"))


def _rest(members: DataFrame, comp: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that the first round left in different components."""
    threshold = percent / 100
    tagged = members.join(comp, "node", "left").select("bucket", "band", "node", "pivot", F.coalesce("root", "node").alias("root"))
    per = tagged.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = per.groupBy("bucket").agg(F.sum("n").alias("size"), F.count("*").alias("comps"), F.max(F.struct("n", "root")).alias("most"))
    main = main.select("bucket", "size", "comps", F.col("most.root").alias("main"), F.col("most.n").alias("held"))
    open_ = tagged.join(main.where("comps > 1 and size > 2"), "bucket")
    small = open_.where(F.col("size") <= SMALL)
    x = small.where("root != main and node != pivot").select("bucket", F.col("node").alias("x"), F.col("root").alias("rx"), "main")
    y = small.where("node != pivot").select("bucket", F.col("node").alias("y"), F.col("root").alias("ry"))
    pairs = x.join(y, "bucket").where("rx != ry and (ry = main or x > y)").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    big = blocks_of(open_.where(F.col("size") > SMALL))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, root, left = (table[c].to_numpy(zero_copy_only=False) for c in ("node", "root", "left"))
        band, own = table["band"][0].as_py(), table["own"][0].as_py()
        sig = _matrix(table["sig"].combine_chunks())
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        first, second = np.flatnonzero(left), np.flatnonzero(left if own else ~left)
        found = []
        for p in first.tolist():
            q = second[(root[second] != root[p]) & ((node[second] > node[p]) | (not own))]
            q = q[~(bands[q, :band] == bands[p, :band]).any(axis=1)]
            for step, fewest in enumerate(least_matches(threshold, MISS, BATCH, sig.shape[1])):
                if not len(q):
                    break
                equal = (sig[q, : (step + 1) * BATCH] == sig[p, : (step + 1) * BATCH]).sum(axis=1)
                q, equal = q[equal >= fewest], equal[equal >= fewest]
            if len(q):
                found.append(np.stack([np.full(len(q), p), q, equal]))
        links: list[tuple[int, int]] = []
        if found:
            pairs = np.concatenate(found, axis=1)
            pairs = pairs[:, np.argsort(-pairs[2], kind="stable")]
            used = np.unique(pairs[:2])
            of = dict(zip(used.tolist(), unpacked_sets(table["z"].take(pa.array(used)).to_pylist())))
            above: dict[int, int] = {}

            def top(x: int) -> int:
                while above.get(x, x) != x:
                    x = above[x]
                return x

            for p, q in pairs[:2].T.tolist():
                a, b = top(int(root[p])), top(int(root[q]))
                if a != b:
                    both = len(np.intersect1d(of[p], of[q], assume_unique=True))
                    if 100 * both >= percent * (len(of[p]) + len(of[q]) - both):
                        above[max(a, b)] = min(a, b)
                        links.append((max(int(node[p]), int(node[q])), min(int(node[p]), int(node[q]))))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    far = big.join(classes.select("node", "sig", "bands"), "node").join(texts, "node").groupBy("bucket", "i", "j", "main_block").applyInArrow(run, "a long, b long")
    near = _confirmed(_filtered(pairs, classes.select("node", "sig"), threshold), texts, percent)
    return near.union(far).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept, n_class): the group of every row.

    component_id is the smallest key in the row's group, kept whether the row has it, n_class
    the number of rows with the very same set. Both are null where the group has null keys alone.
    """
    out = _grouped(docs, percent, text, key)
    group = F.coalesce("component", F.col(key))
    return out.select(key, "n_shingles", group.alias("component_id"), (F.col(key) == group).alias("kept"), F.coalesce("n_class", F.lit(1).cast("long")).alias("n_class"))


def _grouped(docs: DataFrame, percent: int, text: str, key: str) -> DataFrame:
    """(key, hash, n_shingles, node, n_class, component, first): the group's smallest key and its first row as (no key, key, hash); nulls for empty sets."""
    threshold = percent / 100
    base = written(document_sets(docs, text, key, bands_for(percent)), "sets")
    full = base.where(F.col("node").isNotNull())
    classes = written(full.groupBy("node", "guard").agg(F.min(_identity(key)).alias("rep"), F.count("*").alias("n_class"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    bands = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(bands.join(shared, "bucket"), "buckets")
    hubs = sized.groupBy("node").agg(F.sum("n").alias("met"))
    pivots = sized.join(hubs, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("pivot"))
    members = written(sized.select("bucket", "band", "node").join(pivots, "bucket"), "members")
    drop(sized)
    texts = written(_node_texts(docs, classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col(f"rep.{key}").alias(key), F.col("rep.hash").alias("hash")), text, key), "texts")

    star = members.where("node != pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    links = written(_confirmed(_filtered(star, classes.select("node", "sig"), threshold), texts, percent), "links")
    comp = written(components(links), "components")
    more = written(_rest(members, comp, classes, texts, percent), "links")
    if more.isEmpty():
        last = comp
    else:
        last = written(components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "components")
    drop(texts)

    tagged = classes.join(last, "node", "left").select("node", "guard", "rep", "n_class", F.coalesce("root", "node").alias("root"))
    smallest = tagged.groupBy("root").agg(F.min("rep").alias("first"))
    labels = tagged.join(smallest, "root").select("node", "guard", "n_class", F.col(f"first.{key}").alias("component"), "first")
    return base.select(key, "hash", "n_shingles", "node", "guard").join(labels, ["node", "guard"], "left").drop("guard")


def _identity(key: str):
    """What orders and names a row: rows without a key last, then key and text hash."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key), F.col("hash"))


def deduplicated(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, with all their columns: the first row of each group, and every row with an empty set.

    First is the smallest key, then the smallest text hash; null keys come last. Rows are told apart
    by key and text, so keys may repeat or be null, and of rows with equal key and text one stays.
    """
    rows = _grouped(docs, percent, text, key).where("node is not null")
    judged = rows.groupBy(key, "hash").agg(F.count("*").alias("n"), F.min(F.when(_identity(key).eqNullSafe(F.col("first")), 1).otherwise(0)).alias("stays"))
    judged = written(judged.where("n > 1 or stays = 0").withColumnRenamed("hash", "__hash"), "judged")
    marked = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = lambda a, b: a[key].eqNullSafe(b[key]) & (a["__hash"] == b["__hash"])
    again = judged.where("stays = 1")
    gone = judged if not again.isEmpty() else judged.where("stays = 0")
    out = marked.join(gone, same(marked, gone), "left_anti")
    if gone is judged:  # repeated rows: one of each, found apart from the rest
        out = out.unionByName(marked.join(again, same(marked, again), "left_semi").dropDuplicates([key, "__hash"]))
    return out.select(docs.columns)


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows in DuckDB: distinct shingles, shared counts of pairs, reachability.
OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS cut FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * cut >= 85 * (p.n + q.n - cut)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e2.b FROM r JOIN e2 ON r.b = e2.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept,
  CASE WHEN coalesce(n.n, 0) = 0 THEN 1 ELSE z.k END AS n_class
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) OVER (PARTITION BY l) AS k FROM (SELECT doc_id, list_sort(list(g)) AS l FROM s GROUP BY doc_id)) z USING (doc_id)
"""
