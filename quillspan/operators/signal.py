"""Signal operators: array columns of samples without shuffles, long tables by windows, kernels by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows_of(x: str, size: int, stride: int, batch: int = 1) -> Column:
    """Array of windows of `size` samples; only whole batches of windows count."""
    n = F.size(x)
    batches = F.greatest(F.lit(0), F.floor((n - (stride * (batch - 1) + size)) / (stride * batch)) + 1)
    count = (batches * batch).cast("int")
    index = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.slice(x, i * stride + 1, size))


def training_windows(df: DataFrame, key: str, x: str, y: str, size: int, stride: int = 1, batch: int = 1, offset: int | None = None, sequence: bool = False, output_stride: int = 1, padding: int = 0, mask: int | None = None, class_weights: list[float] | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """(key, window_id, x, y, w): windows of samples with their targets and weights.

    `y` holds an array of class probabilities per sample. A window's target is that of the sample at
    `offset` (the middle one) or, as a `sequence`, every `output_stride`-th one of the window. The
    weights of a sequence are 0 for `padding` places at both ends; with `class_weights`, a place's
    weight is that of its largest class. `mask` zeroes that many samples on each side of the middle.
    `share` keeps a drawn part of the windows, chosen by hash, alike on every run. Only whole
    batches of windows count.
    """
    rows = df.select(key, F.posexplode(windows_of(x, size, stride, batch)).alias("window_id", "x"), F.col(y).alias("__y"))
    if share is not None:
        draw = F.shiftrightunsigned(F.xxhash64(key, "window_id", F.lit(seed)), 11) / float(1 << 53)
        rows = rows.where(draw < share)
    first = F.col("window_id") * stride
    if sequence:
        places = F.sequence(F.lit(0), F.lit((size // output_stride - 1) * output_stride), F.lit(output_stride))
        target = F.transform(places, lambda i: F.get("__y", first + i))
        best = lambda p: F.array_position(p, F.array_max(p)).cast("int")
        n = size // output_stride
        inside = lambda i: (i >= padding) & (i < n - padding)
        weight = F.transform("y", lambda p, i: F.when(inside(i), 1.0 if class_weights is None else F.get(F.array(*(F.lit(float(c)) for c in class_weights)), best(p) - 1)).otherwise(0.0))
    else:
        target = F.get("__y", first + (size // 2 if offset is None else offset))
        weight = F.lit(1.0) if class_weights is None else F.get(F.array(*(F.lit(float(c)) for c in class_weights)), F.array_position("y", F.array_max("y")).cast("int") - 1)
    if mask is not None:
        rows = rows.withColumn("x", F.transform("x", lambda v, i: F.when((i >= int(size / 2 - mask)) & (i < int(size / 2 + mask)), 0.0).otherwise(v)))
    return rows.withColumn("y", target).withColumn("w", weight).select(key, F.col("window_id").cast("long").alias("window_id"), "x", "y", "w")


def total(x: str | Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def bank_energy(power: str, bank: np.ndarray) -> Column:
    """Energies of a filter bank (band, bin) given as literals."""
    rows = F.array(*(F.array(*(F.lit(float(w)) for w in row)) for row in bank))
    return F.transform(rows, lambda row: total(F.zip_with(row, power, lambda w, p: w * p)))


def decibels(power: str, floor: float = -80.0) -> Column:
    """10 log10, relative to the array's maximum, cut at the floor."""
    db = F.transform(power, lambda p: 10 * F.log10(F.greatest(p, F.lit(1e-10))))
    return F.transform(db, lambda v: F.greatest(v - F.array_max(db), F.lit(floor)))


def spectral_shape(df: DataFrame, power: str, rate: float, size: int, share: float = 0.85) -> DataFrame:
    """Adds centroid, bandwidth, rolloff, flatness and entropy of a power spectrum."""
    f = F.transform(F.sequence(F.lit(0), F.lit(size // 2)), lambda k: k * F.lit(rate / size))
    df = df.withColumns({"__f": f, "__t": total(power)})
    df = df.withColumn("centroid", total(F.zip_with("__f", power, lambda a, b: a * b)) / F.col("__t"))
    df = df.withColumn("bandwidth", F.sqrt(total(F.zip_with("__f", power, lambda a, b: F.pow(a - F.col("centroid"), F.lit(2)) * b)) / F.col("__t")))
    upto = F.transform(F.sequence(F.lit(1), F.lit(size // 2 + 1)), lambda k: total(F.slice(power, 1, k)))
    df = df.withColumn("__c", upto).withColumn("rolloff", F.array_min(F.filter(F.zip_with("__f", "__c", lambda a, c: F.when(c >= share * F.col("__t"), a)), lambda v: v.isNotNull())))
    eps = F.lit(1e-10)
    flat = F.exp(total(F.transform(power, lambda p: F.ln(p + eps))) / F.size(power)) / (total(F.transform(power, lambda p: p + eps)) / F.size(power))
    entropy = -total(F.transform(power, lambda p: (p / F.col("__t") + eps) * F.log2(p / F.col("__t") + eps)))
    return df.withColumns({"flatness": flat, "entropy": entropy}).drop("__f", "__t", "__c")


def z_scores(df: DataFrame, axis: list[str], value: str = "x", name: str = "z") -> DataFrame:
    """Adds `name`: the value less its mean over its population deviation along an axis (none: of all rows).

    The statistics are aggregated before they are shuffled and joined back, so an axis with few
    places does not gather all rows in as many tasks.
    """
    stats = df.groupBy(*axis).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    both = df.join(stats, axis) if axis else df.join(F.broadcast(stats))  # one row without an axis
    return both.withColumn(name, (F.col(value) - F.col("__m")) / (F.col("__s") + F.lit(1e-10))).drop("__m", "__s")


def _around(keys: list[str], at: str, before: int, after: int):
    return Window.partitionBy(*keys).orderBy(at).rowsBetween(-before, after)


def dilated(df: DataFrame, keys: list[str], at: str, reach: int, value: str = "x") -> Column:
    """Flat dilation along time: the largest of the neighbours within reach."""
    return F.max(value).over(_around(keys, at, reach, reach))


def eroded(df: DataFrame, keys: list[str], at: str, reach: int, value: str = "x") -> Column:
    """Flat erosion along time."""
    return F.min(value).over(_around(keys, at, reach, reach))


def opened(df: DataFrame, keys: list[str], at: str, reach: int, value: str = "x") -> DataFrame:
    """Adds `opened` and `closed`."""
    df = df.withColumns({"__e": eroded(df, keys, at, reach, value), "__d": dilated(df, keys, at, reach, value)})
    return df.withColumns({"opened": dilated(df, keys, at, reach, "__e"), "closed": eroded(df, keys, at, reach, "__d")}).drop("__e", "__d")


def pooled(df: DataFrame, keys: list[str], at: str, size: int, value: str = "x", share: float = 0.5) -> DataFrame:
    """max, min, gradient and mixed pooling over tiles of time."""
    tiles = df.groupBy(*keys, F.floor(F.col(at) / size).alias("tile"))
    hi, lo, mean = F.max(value), F.min(value), F.avg(value)
    return tiles.agg(hi.alias("hi"), lo.alias("lo"), (hi - lo).alias("gradient"), (share * hi + (1 - share) * mean).alias("mixed"), (share * hi + (1 - share) * lo).alias("maxmin"))


def with_noise(value: str | Column, power: float, seed: int) -> Column:
    """Samples with normal noise added."""
    return F.col(value) + F.randn(seed) * power if isinstance(value, str) else value + F.randn(seed) * power


def sub_range(df: DataFrame, at: str, total: int, share: float, seed: int) -> DataFrame:
    """A contiguous share of the places 0 .. total - 1, its start drawn by the seed."""
    size = max(1, int(total * share))
    begin = int(np.random.default_rng(seed).integers(0, max(1, total - size + 1)))
    return df.where(F.col(at).between(begin, begin + size - 1))


def flattened(windows: DataFrame, keys: list[str], array: str, stride: int, margin: int = 0) -> DataFrame:
    """(keys, frame, value) of (keys, window_id, array): windows unrolled, `margin` places cut at both ends."""
    rows = windows.select(*keys, "window_id", F.posexplode(array).alias("pos", "value"), F.size(array).alias("__n"))
    kept = rows.where((F.col("pos") >= margin) & (F.col("pos") < F.col("__n") - margin))
    return kept.select(*keys, (F.col("window_id") * stride + F.col("pos")).alias("frame"), "value")


def kernel(df: DataFrame, key: str, samples: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, values): a numpy kernel on each row's samples, by Arrow batches; null or empty samples give null, and so does a kernel's None."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if not x or (y := f(np.asarray(x, float))) is None else np.asarray(y, float).ravel().tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["key", "values"])

    return df.select(F.col(key).alias("key"), F.col(samples).alias("x")).mapInArrow(run, f"key {kind}, values array<double>").withColumnRenamed("key", key)


def power_spectrum(df: DataFrame, key: str, samples: str) -> DataFrame:
    """(key, p): power of the one-sided Fourier transform of each row's samples.

    A fast transform in Arrow batches: as array expressions the sums over cosines took 50 times as long.
    """
    return kernel(df, key, samples, lambda x: np.abs(np.fft.rfft(x)) ** 2).withColumnRenamed("values", "p")
