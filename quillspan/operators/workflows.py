"""Whole chains: audio to segments, probabilities to segments and events, data sets, features, models."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import dsp, tcn
from quillspan.operators import frames as fr, intervals as iv, sequence as sq
from quillspan.sources.readers import clips

KEY = "recording_id"


def _clean(mask: np.ndarray, size: int) -> np.ndarray:
    """Opening, then closing, of a mask by a square; outside counts as empty."""

    def grow(m: np.ndarray, back: bool) -> np.ndarray:
        out = np.zeros_like(m)
        for i in range(size):
            for j in range(size):
                a, b = (-i, -j) if back else (i, j)
                out[max(a, 0) : m.shape[0] + min(a, 0), max(b, 0) : m.shape[1] + min(b, 0)] |= m[max(-a, 0) : m.shape[0] + min(-a, 0), max(-b, 0) : m.shape[1] + min(-b, 0)]
        return out

    def shrink(m: np.ndarray) -> np.ndarray:
        out = np.zeros_like(m)
        h, w = m.shape[0] - size + 1, m.shape[1] - size + 1
        if h > 0 and w > 0:
            all_set = np.ones((h, w), bool)
            for i in range(size):
                for j in range(size):
                    all_set &= m[i : i + h, j : j + w]
            out[:h, :w] = all_set
        return out

    opened = grow(shrink(mask), False)
    # of an even square, closing sees the places before and the one itself: the first row and column stay empty
    grown, out = grow(opened, True), np.zeros_like(mask)
    h, w = mask.shape[0] - size + 1, mask.shape[1] - size + 1
    if h > 0 and w > 0:
        back = size // 2
        ends = slice(back, back + h), slice(back, back + w)
        out[ends] = shrink(grown)[:h, :w]
    return out


def active_frames(waves: DataFrame, n_fft: int = 1024, hop: int = 64, low: float = 1500.0, high: float = 10000.0, threshold_db: float = -45.0, size: int = 2) -> DataFrame:
    """(recording_id, rate, frame, bins, f_low_hz, f_high_hz): frames with bins above the band's maximum plus a threshold.

    Levels are over 100 medians of the power and cut 80 dB below the largest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [KEY, "rate", "frame", "bins", "f_low_hz", "f_high_hz"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, rate, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not x or not rate:
                    continue
                power = dsp.power_spectrogram(np.asarray(x, float), n_fft, hop)
                freq = np.arange(n_fft // 2 + 1) * rate / n_fft
                keep = (freq >= low) & (freq <= high)
                if not power[:, keep].size:
                    continue
                db = dsp.levels(power, 100 * float(np.median(power)))[:, keep]
                mask = _clean(db > db.max() + threshold_db, size)
                band = freq[keep]
                for t in np.flatnonzero(mask.any(axis=1)).tolist():
                    bins = np.flatnonzero(mask[t])
                    for column, v in zip(out, (key, rate, t, len(bins), float(band[bins[0]]), float(band[bins[-1]]))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64()))], names=names)

    rows = waves.where("samples is not null").select(F.col(KEY).cast("string"), "rate", "samples")
    return rows.mapInArrow(run, f"{KEY} string, rate int, frame long, bins int, f_low_hz double, f_high_hz double")


def segment_units(waves: DataFrame, hop: int = 64, min_duration: float = 0.008, min_gap: float = 0.02, least_bins: int = 1, **options) -> DataFrame:
    """(recording_id, unit_id, start_s, stop_s, f_low_hz, f_high_hz): vocal units of each recording.

    Silences of up to `min_gap` are bridged and units below `min_duration` dropped; times are those
    of frames, half open.
    """
    active = active_frames(waves, hop=hop, **options)
    rate = active.groupBy(KEY).agg(F.first("rate").alias("rate"))
    runs = fr.islands(active.where(F.col("bins") >= least_bins), [KEY]).join(rate, KEY)
    w = Window.partitionBy(KEY).orderBy("first")
    gap = F.rint(F.lit(min_gap) * F.col("rate") / hop)
    joined = F.col("first") - F.lag("last").over(w) - 1 <= gap
    runs = runs.withColumn("__f", F.when(joined, 0).otherwise(1)).withColumn("unit", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(KEY, "unit", "rate").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.where((F.col("last") + 1 - F.col("first")) * hop / F.col("rate") >= min_duration)
    inside = active.drop("rate").join(spans, KEY).where("frame between first and last")
    out = inside.groupBy(KEY, "unit", "rate", "first", "last").agg(F.min("f_low_hz").alias("f_low_hz"), F.max("f_high_hz").alias("f_high_hz"))
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("first")) - 1
    return out.select(KEY, number.alias("unit_id"), (F.col("first") * hop / F.col("rate")).alias("start_s"), ((F.col("last") + 1) * hop / F.col("rate")).alias("stop_s"), "f_low_hz", "f_high_hz")


def predicted_segments(probs: DataFrame, names: list[str], rate: float, threshold: float = 0.5, fill: float | None = None, least: float | None = None) -> DataFrame:
    """(recording_id, name, start_s, stop_s) from (recording_id, frame, idx, p).

    Active where the largest p reaches the threshold; with the two classes noise and song, where
    the label is song. Short gaps are filled and short runs dropped away from the recording's
    ends; a run's name is the commonest label inside, its stop the time of its last frame.
    """
    keys = [KEY, "frame"]
    label = fr.first_above(probs, keys, threshold)
    legacy = len(names) == 2 and names[0].lower() == "noise"
    on = label.where("label > 0").select(keys) if legacy else probs.groupBy(keys).agg(F.max("p").alias("p")).where(F.col("p") >= threshold).select(keys)
    edges = probs.groupBy(KEY).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    runs = fr.islands(on, [KEY])
    if fill is not None:
        runs = fr.bridged(runs, [KEY], int(fill * rate), False, edges)
    if least is not None:
        runs = fr.long_enough(runs, [KEY], int(least * rate), edges)
    spans = runs.withColumn("span_id", F.col("first"))
    table = F.array(*(F.lit(n) for n in names))
    if legacy:
        named = spans.withColumn("name", F.lit(names[1]))
    else:
        votes = fr.majority(label.withColumnRenamed("label", "name"), spans, [KEY]).select(KEY, "span_id", F.get(table, F.col("name")).alias("name"))
        named = spans.join(votes, [KEY, "span_id"])
    return fr.seconds(named, rate).select(KEY, "name", "start_s", "stop_s")


def predicted_events(probs: DataFrame, idx: int, name: str, rate: float, threshold: float = 0.5, distance: float = 0.01, least: float = 0.0, most: float = float("inf")) -> DataFrame:
    """(recording_id, name, start_s, stop_s): peaks of one class, thinned, then filtered by their intervals."""
    one = probs.where(F.col("idx") == idx).select(KEY, "frame", "p")
    found = sq.peaks(one, [KEY], "frame", "p", threshold, int(distance * rate)).select(KEY, F.col("frame").alias("id"), (F.col("frame") / rate).alias("t"))
    kept = iv.isolated_filter(found, least, most)
    return kept.select(KEY, F.lit(name).alias("name"), F.col("t").alias("start_s"), F.col("t").alias("stop_s"))


def frame_labels(df: DataFrame, lengths: DataFrame, classes: list[str], step: float) -> DataFrame:
    """(recording_id, frame, y): class probabilities of each frame, uniform where nothing is labelled.

    `lengths` holds each recording's number of frames as `n`.
    """
    hit = fr.raster(df.join(lengths, KEY), step, F.col("n")) if "n" not in df.columns else fr.raster(df, step, F.col("n"))
    marks = hit.groupBy(KEY, "frame").agg(F.collect_set("name").alias("names"))
    spine = lengths.where("n > 0").select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("frame"))
    every = F.array(*(F.lit(c) for c in classes))
    ones = F.transform(every, lambda c: F.when(F.array_contains(F.coalesce("names", F.array().cast("array<string>")), c), 1.0).otherwise(0.0))
    total = F.aggregate("y", F.lit(0.0), lambda a, b: a + b)
    out = spine.join(marks, [KEY, "frame"], "left").withColumn("y", ones)
    return out.select(KEY, "frame", F.when(total > 0, F.transform("y", lambda v: v / total)).otherwise(F.array_repeat(F.lit(1.0 / len(classes)), len(classes))).alias("y"))


def dataset_split(labels: DataFrame, share: float = 0.1, test: int = 1024) -> DataFrame:
    """Adds `split`: whole recordings to val by hash, of two and more; one recording is cut in time. The first val frames are test as well."""
    recordings = labels.select(KEY).distinct().withColumn("__h", F.md5(F.col(KEY).cast("string")))
    n = recordings.count()
    if n >= 2:
        take = min(max(1, round(n * share)), n - 1)
        val = recordings.orderBy("__h").limit(take).select(KEY, F.lit(True).alias("__v"))
        out = labels.join(val, KEY, "left").withColumn("split", F.when(F.col("__v"), "val").otherwise("train")).drop("__v")
    else:
        frames = labels.count()
        cut = min(max(int(frames * (1 - share)), frames // 5), frames - 1024)
        cut = cut if cut > 0 else frames // 2
        out = labels.withColumn("split", F.when(F.col("frame") < cut, "train").otherwise("val"))
    head = out.where("split = 'val'").orderBy(KEY, "frame").limit(test).withColumn("split", F.lit("test"))
    return out.unionByName(head)


def segment_features(segments: DataFrame, waves: DataFrame, least_s: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """((recording_id, unit_id, values), rejects with reason): the features of each segment in the order of dsp.feature_names()."""
    cut = clips(segments, waves)
    frames = F.floor(F.size("samples") / dsp.HOP) + 1
    cut = cut.withColumn("reason", F.when(F.size("samples") < F.col("rate") * least_s, "too short").when(frames < 3, "too few frames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for rate, x, s, e, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(2, 8))):
                made.append(dsp.segment_features(np.asarray(x, float), rate, s, e, lo or 0.0, hi or 0.0).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.float64()))], names=[KEY, "unit_id", "values"])

    good = cut.where("reason is null").select(F.col(KEY).cast("string"), F.col("unit_id").cast("long"), "rate", "samples", "start_s", "stop_s", "f_low_hz", "f_high_hz")
    lost = segments.join(cut.select(KEY, "unit_id", "reason"), [KEY, "unit_id"], "left_anti").withColumn("reason", F.lit("no audio"))
    return good.mapInArrow(run, f"{KEY} string, unit_id long, values array<double>"), cut.where("reason is not null").select(KEY, "unit_id", "reason").unionByName(lost.select(KEY, "unit_id", "reason"))


def predicted_probabilities(waves: DataFrame, net: tcn.Network, history: int = 1024, overlap: int = 256) -> DataFrame:
    """(recording_id, frame, idx, p): a network over windows of a recording, edges padded, the windows' margins left out."""
    shared = waves.sparkSession.sparkContext.broadcast(net)
    step = history - 2 * overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                y = np.pad(np.asarray(x, float), (overlap, overlap + history), mode="edge") if x else np.zeros(0)
                parts = [tcn.forward(shared.value, y[a : a + history, None])[overlap : overlap + step] for a in range(0, len(x or ()), step)]
                p = np.concatenate(parts)[: len(x)] if parts else np.zeros((0, 1))
                frame, idx = np.indices(p.shape)
                yield pa.RecordBatch.from_arrays([pa.array([key] * p.size, pa.string()), pa.array(frame.ravel(), pa.int64()), pa.array(idx.ravel().astype(np.int32)), pa.array(p.ravel())], names=[KEY, "frame", "idx", "p"])

    return waves.where("samples is not null").select(F.col(KEY).cast("string"), "samples").mapInArrow(run, f"{KEY} string, frame long, idx int, p double")


def fit_best(df: DataFrame, path: str, name: str, labels: list[str]) -> None:
    """Fit a named model on all rows of (label string, features) and save it with its label order."""
    from quillspan.operators.ml import models

    code = F.element_at(F.create_map(*(x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i))))), F.col("label"))
    models()[name].fit(df.withColumn("label", code)).write().overwrite().save(f"{path}/model")
    df.sparkSession.createDataFrame([(name, labels)], "name string, labels array<string>").write.mode("overwrite").json(f"{path}/about")


def predict_with(df: DataFrame, path: str) -> DataFrame:
    """`df` with the saved model's label as `name`."""
    from pyspark.ml import classification

    about = df.sparkSession.read.json(f"{path}/about").first()
    kind = {"linear_svm": classification.OneVsRestModel, "random_forest": classification.RandomForestClassificationModel, "logistic_regression": classification.LogisticRegressionModel}[about["name"]]
    told = kind.load(f"{path}/model").transform(df)
    return told.withColumn("name", F.get(F.array(*(F.lit(v) for v in about["labels"])), F.col("prediction").cast("int")))


def folder_digest(spark, path: str) -> str:
    """A digest of the names and contents of all files below a path, in case-blind order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.struct(F.lower("path").alias("p"), F.md5("content").alias("d")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    name = lambda x: F.concat_ws(":", F.substring(x["p"], F.lit(1) + F.length(F.lit(path)), F.length(x["p"])), x["d"])
    return rows.select(F.md5(F.array_join(F.transform("xs", name), ","))).first()[0]


def save_params(params: dict, path: str) -> None:
    """Parameters as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(params, f, indent=1, sort_keys=True)


def load_params(path: str) -> dict:
    """Parameters from JSON."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
