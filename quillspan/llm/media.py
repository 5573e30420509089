"""Media columns by content-defined chunking: gear-hash cuts, one stored copy per chunk, verified reads.

A text is a payload of 8-bit samples. Each payload is cut where a rolling gear hash of its last
bytes has its top bits clear, so edits move few cuts. Chunk digests are deduplicated by joins:

* equal payloads are one payload, stored once;
* a chunk that one payload alone holds lies in that payload's pack, in order;
* a chunk that occurs more than once is stored once, under its digest.

Payloads whose chunks are all their own are read back without any shuffle; the others fetch shared
chunks by digest and put them in their places by the ordered chunk list. Every payload read is
checked against the digest taken before storing, and a mismatch fails the job. The stored form of
a payload is its chunk list (per chunk a 16-byte digest and its length) and its chunks' bytes.

A null text is an empty text; payloads are padded by blanks to a positive multiple of `unit`.
Repeated rows give repeated rows; ids may repeat. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import drop, new_path, written
from quillspan.llm.textbatch import mix, steps, text_buffer

UNIT = 192
#: Mean chunk 2**BITS beyond LEAST, at most MOST bytes.
BITS, LEAST, MOST = 11, 256, 16384
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """The gear hash of the last 32 bytes at each place, by doubling instead of rolling."""
    h = _GEAR[buf]
    for step in (1, 2, 4, 8, 16):
        if len(h) <= step:
            break
        more = h[:-step] << np.uint32(step)
        h[step:] += more
    return h


def chunk_ends(n: int, marks: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a payload of n bytes; `marks` are the places (from 1) after which the hash allows a cut."""
    out, last = [], 0
    for mark in [*marks, n]:
        while mark - last > most:
            last += most
            out.append(last)
        if mark == n or mark - last >= least:
            if mark > last:
                out.append(mark)
                last = mark
    return out


def payloads(column: pa.Array, unit: int = UNIT) -> list[tuple[int, bytes]]:
    """(bytes of the text, padded payload) of each row."""
    buf, off = text_buffer(column)
    raw = buf.tobytes()
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        n = b - a
        out.append((n, raw[a:b] + b" " * (max(1, -(-n // unit)) * unit - n)))
    return out


def cut(parts: list[bytes]) -> list[list[int]]:
    """Chunk ends of each payload."""
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    place = np.flatnonzero(gear(np.frombuffer(b"".join(parts), np.uint8)) >> np.uint32(32 - BITS) == 0) + 1
    at = np.searchsorted(place, off, "right")
    return [chunk_ends(len(p), (place[at[i] : at[i + 1]] - off[i]).tolist()) for i, p in enumerate(parts)]


def digest(data: bytes) -> bytes:
    """16 bytes that name a chunk or a payload."""
    return hashlib.blake2b(data, digest_size=16).digest()


def chunk_lists(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: int = UNIT) -> DataFrame:
    """(key, pk, n_bytes, payload_bytes, digests, lens): the ordered chunk list of every row's payload."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sizes, parts = zip(*payloads(part.column(1), unit))
                digests, lens = [], []
                for data, ends in zip(parts, cut(list(parts))):
                    starts = [0, *ends[:-1]]
                    digests.append([digest(data[a:b]) for a, b in zip(starts, ends)])
                    lens.append([b - a for a, b in zip(starts, ends)])
                arrays = [part.column(0), pa.array([digest(p) for p in parts], pa.binary()), pa.array(sizes, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(digests, pa.list_(pa.binary())), pa.array(lens, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "pk", "n_bytes", "payload_bytes", "digests", "lens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, pk binary, n_bytes long, payload_bytes long, digests array<binary>, lens array<int>").withColumnRenamed("key", key)


def _packed_payloads(docs: DataFrame, text: str, unit: int) -> DataFrame:
    """(pk, z): every distinct payload, compressed for its one shuffle; copies go before it, task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=6, write_checksum=False)
        for batch in batches:
            for part in steps(batch):
                found = {digest(p): p for _, p in payloads(part.column(0), unit)}
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([tool.compress(p) for p in found.values()], pa.binary())], names=["pk", "z"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "pk binary, z binary").dropDuplicates(["pk"])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the store from (z, pk, lens, digests, shared, owned): packs, and shared chunks at their owners."""
    tool = zstandard.ZstdDecompressor()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            kinds, keys, datas, lists = [], [], [], []
            for row in whole.slice(at, 256).to_pylist():
                data, start = tool.decompress(row["z"]), 0
                shared, owned, own = set(row["shared"] or ()), set(row["owned"] or ()), []
                for pos, n in enumerate(row["lens"]):
                    piece = data[start : start + n]
                    start += n
                    if pos not in shared:
                        own.append(piece)
                    elif pos in owned:
                        kinds.append("shared")
                        keys.append(row["digests"][pos])
                        datas.append(piece)
                        lists.append(None)
                kinds.append("part" if shared else "whole")
                keys.append(row["pk"])
                datas.append(b"".join(own))
                lists.append(row["lens"])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.binary()), pa.array(datas, pa.binary()), pa.array(lists, pa.list_(pa.int32()))], names=["kind", "name", "data", "lens"])


def features(payload: bytes, chunks: int) -> str:
    """A few whole-number features of the samples."""
    x = np.frombuffer(payload, np.uint8)
    return f"samples={len(x)};sum={int(x.sum(dtype=np.int64))};max={int(x.max())};blanks={int((x == 32).sum())};steps={int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))};chunks={chunks}"


def _read(pk: bytes, lens: list[int], data: bytes, shared: dict[int, bytes]) -> tuple:
    """Result values of a payload put together from its own pack and the shared chunks by place."""
    pieces, at = [], 0
    for pos, n in enumerate(lens):
        if pos in shared:
            pieces.append(shared[pos])
        else:
            pieces.append(data[at : at + n])
            at += n
    payload = b"".join(pieces)
    if digest(payload) != pk:
        raise ValueError(f"stored payload {pk.hex()} reads back differently")
    head = b"".join(digest(p) + struct.pack("<I", len(p)) for p in pieces)
    media = hashlib.sha256(head)
    media.update(payload)
    return pk, hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), len(head) + len(payload), media.digest(), features(payload, len(pieces))


_RESULT = "pk binary, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["pk", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256).to_pylist()
            yield _result([_read(r["name"], r["lens"], r["data"], {p["pos"]: p["data"] for p in r.get("fetched") or ()}) for r in rows])


class MediaStore:
    """The chunk store of a table's payloads: `lists` (row -> payload), and reads by payload."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", unit: int = UNIT):
        spark = docs.sparkSession
        self.key, self.lists = key, written(chunk_lists(docs, text, key, unit), "lists")
        reps = self.lists.groupBy("pk").agg(F.first("digests").alias("digests"), F.first("lens").alias("lens"))
        reps = written(reps, "payloads")
        chunks = reps.select("pk", F.posexplode("digests").alias("pos", "digest"))
        many = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("pk", "pos")).alias("owner")).where("n > 1").select("digest", "owner")
        self.refs = written(chunks.join(many, "digest").select("pk", "pos", "digest", ((F.col("owner.pk") == F.col("pk")) & (F.col("owner.pos") == F.col("pos"))).alias("own")), "refs")
        held = self.refs.groupBy("pk").agg(F.collect_list("pos").alias("shared"), F.collect_list(F.when(F.col("own"), F.col("pos"))).alias("owned"))
        plan = reps.join(held, "pk", "left")
        rows = _packed_payloads(docs, text, unit).join(plan, "pk").select("z", "pk", "lens", "digests", "shared", "owned")
        self.path = new_path(spark, "media")
        rows.mapInArrow(_stored, "kind string, name binary, data binary, lens array<int>").write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").partitionBy("kind").parquet(self.path)
        self.store = spark.read.schema("name binary, data binary, lens array<int>, kind string").parquet(self.path)
        drop(reps)

    def read(self) -> DataFrame:
        """Values of every payload read back, one row each."""
        whole = self.store.where("kind = 'whole'").select("name", "data", "lens").mapInArrow(_read_back, _RESULT)
        shared = self.store.where("kind = 'shared'").select(F.col("name").alias("digest"), "data").dropDuplicates(["digest"])
        fetched = self.refs.join(shared, "digest").groupBy("pk").agg(F.collect_list(F.struct("pos", "data")).alias("fetched"))
        part = self.store.where("kind = 'part'").select("name", "data", "lens").join(fetched.withColumnRenamed("pk", "name"), "name").mapInArrow(_read_back, _RESULT)
        return whole.union(part).dropDuplicates(["pk"])


def media(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: int = UNIT) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row, read back."""
    store = MediaStore(docs, text, key, unit)
    out = store.lists.select(key, "n_bytes", "payload_bytes", "pk").join(store.read(), "pk").drop("pk")
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as chunked media and read back."""
    return media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
