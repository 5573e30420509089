"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partition.

Records are ordered by (text hash, key hash, row), so equal texts stand together and a hot text, or
rows repeated very often, can still be cut between records. A size-weighted sample of the keys gives splitters for many more
ranges than shards; ranges that hold too many bytes are sampled again and subdivided until none
does. Ranges are small enough for one task each, and a running sum in each, on top of the bytes of
the ranges before it, places every record: shard sizes differ by a record at most.

Law: `bytes`. A null text has no bytes, every record counts one more. Equal rows are kept as rows of
their own. An empty table gives no rows. Only keys, sizes and checksums are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.scratch import drop, written

#: Ranges per shard, and records per range where there are very many.
RANGES, RECORDS = 32, 200_000
#: Expected sample keys per range.
SAMPLE = 16


def splitters(sample: list[tuple], n: int) -> list[tuple]:
    """At most n - 1 boundaries that cut the weight of (k, tie, row, weight) samples into equal parts."""
    if n < 2 or not sample:
        return []
    sample = sorted(sample)
    weight = np.cumsum([w for *_, w in sample])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, n) / n)
    return sorted({sample[i][:-1] for i in at.tolist()})


def _at_or_below(bounds: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """For each row of `keys` (columns of equal length) the number of rows of the sorted `bounds` at or below it."""
    low = np.searchsorted(bounds[0], keys[0], "left")
    high = np.searchsorted(bounds[0], keys[0], "right")
    if len(bounds) == 1:
        return high
    same, out = np.flatnonzero(high > low), low.copy()
    for a in np.unique(low[same]).tolist():  # the rows that share their first value with a boundary, value by value
        rows = same[low[same] == a]
        b = int(high[rows[0]])
        out[rows] = a + _at_or_below([x[a:b] for x in bounds[1:]], [x[rows] for x in keys[1:]])
    return out


def with_range(keyed: DataFrame, bounds: list[tuple]) -> DataFrame:
    """`keyed` (k, tie, row, ...) with the number of boundaries at or below each record as `range`."""
    shared = keyed.sparkSession.sparkContext.broadcast([np.array([b[i] for b in bounds], np.int64) for i in range(3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("k", "tie", "row")]
            place = _at_or_below(shared.value, own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int64))], names=[*batch.schema.names, "range"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    return keyed.mapInArrow(run, f"{fields}, range long")


def _number(text: Column) -> Column:
    """60 bits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _sample(keyed: DataFrame, per_byte) -> list[tuple]:
    """Size-weighted Poisson sample: a record is drawn with chance min(1, size * per_byte), by a hash of its key."""
    chance = F.least(F.lit(1.0), F.col("size") * per_byte)
    draw = F.shiftrightunsigned(F.xxhash64("k", "tie", "row", F.lit(17)), 11) / float(1 << 53)
    rows = keyed.where(draw < chance).select("k", "tie", "row", (F.col("size") / chance).alias("w"))
    return [(r.k, r.tie, r.row, r.w) for r in rows.toLocalIterator()]


def sharded(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", ranges: int = RANGES, records: int = RECORDS) -> DataFrame:
    """(key, size, text_crc32, shard, slot): near-equal bytes in each of the shards.

    The number of ranges, and with it the splitters on the driver, is `ranges` a shard or one per
    `records` records, whichever is more: for 10**10 records 50,000 pairs of numbers.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), _number(body).alias("k"), _number(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("tie"))
    keyed = written(keyed.withColumn("row", F.monotonically_increasing_id()), "keys")
    whole = keyed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    n, total = whole["n"], max(1, whole["bytes"])
    count = max(ranges * shards, -(-n // records))
    bounds = splitters(_sample(keyed, count * SAMPLE / total), count)
    ranged = with_range(keyed, bounds)
    while True:
        held = {r["range"]: (r["bytes"], r["n"], r["many"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.count("*") > 1).alias("many")).toLocalIterator()}
        full = [r for r, (b, rows, many) in held.items() if many and (b > 4 * total / count or rows > 4 * records)]
        parts = splitters(_sample(ranged.where(F.col("range").isin(full)), count * SAMPLE / total * 4), 4 * len(full)) if full else []
        more = sorted({*bounds, *parts})
        if len(more) == len(bounds):
            break
        bounds = more
        ranged = with_range(keyed, bounds)
    offsets, at, rows = [], 0, 0
    for r in sorted(held):
        offsets.append((r, at, rows))
        at, rows = at + held[r][0], rows + held[r][1]
    before = docs.sparkSession.createDataFrame(offsets, "range long, bytes_before long, rows_before long")
    window = Window.partitionBy("range").orderBy("k", "tie", "size", "text_crc32", "row")
    placed = ranged.withColumn("upto", F.sum("size").over(window.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(window))
    placed = placed.join(F.broadcast(before), "range")
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * total))).cast("int")).withColumn("at", F.col("rows_before") + F.col("nth") - 1)
    placed = written(placed.select("key", "size", "text_crc32", "shard", "at"), "placed")
    drop(keyed)
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    out = placed.join(F.broadcast(first), "shard").select("key", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
    return out.withColumnRenamed("key", key)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same rows in DuckDB, which has no CRC-32: its table of 256 remainders comes from the polynomial.
OP4_SQL = r"""
WITH RECURSIVE p AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS r FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, r + 1 FROM p WHERE r < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM p WHERE r = 8),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
b AS (SELECT doc_id, x, list_transform(list_filter(string_split(regexp_replace(hex(encode(x)), '(..)', '\1,', 'g'), ','), lambda h: h <> ''), lambda h: ('0x' || h)::BIGINT) AS bytes FROM d),
k AS (SELECT doc_id, len(bytes) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS text_crc32,
  ('0x' || substr(md5(x), 1, 15))::BIGINT AS k, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS tie FROM b, t),
s AS (SELECT *, least(7, (2 * sum(size) OVER (ORDER BY k, tie, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size) * 8 // (2 * sum(size) OVER ()))::INT AS shard FROM k)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k, tie, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""
