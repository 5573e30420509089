"""Readers: every file is read as text, columns are found by alias in its own header and cast with try_cast.

Rows that do not parse go to the second DataFrame of `with_rejects`, never silently away; the plain
readers return the good rows. All files of a folder are one DataFrame with their recording id; files
of one folder may differ in the order, number and names of their columns.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Accepted column names, fixed values; of several the first in the file counts.
ALIASES = {
    "name": ("name", "label", "syllable"),
    "start_s": ("start_seconds", "start", "t_start", "t_start_s"),
    "stop_s": ("stop_seconds", "stop", "end_seconds", "t_end", "t_end_s"),
    "channel": ("channel",),
}
#: Accepted columns of segment files, fixed values; in each row the first one that is not empty counts.
SEGMENT_ALIASES = {
    "start_s": ("t_start_s", "t_start"),
    "stop_s": ("t_end_s", "t_end"),
    "f_low_hz": ("f_low_hz", "f_low"),
    "f_high_hz": ("f_high_hz", "f_high"),
    "unit_id": ("unit_id",),
}
#: Header cells that mark the first row of a label table as a header, fixed values.
LABEL_HEADERS = ("label", "labels", "type", "class")
#: Columns of a table that are looked at.
MOST_COLUMNS = 64


def recording_id(suffixes: tuple[str, ...] = ("_annotations", "_segments_info", "_segments", "_MFCC")) -> Column:
    """The file name without folder, extension and known suffixes."""
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(F.url_decode(stem), "(" + "|".join(suffixes) + ")$", "")


def _csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(recording_id, __file, __row, header, cells): rows of tables below their own file's header, both as arrays of trimmed text.

    The first row of each file is its header. Quoted cells may hold line breaks. MOST_COLUMNS columns
    are read.
    """
    schema = ", ".join(f"c{i} string" for i in range(MOST_COLUMNS))
    raw = spark.read.schema(schema).option("header", False).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    cells = F.transform(F.array(*raw.columns), lambda c: F.trim(c))
    rows = raw.select(recording_id().alias("recording_id"), F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__row"), cells.alias("cells"))
    heads = rows.groupBy("__file").agg(F.min(F.struct("__row", "cells")).alias("h"))
    clean = F.transform("h.cells", lambda c: F.trim(F.regexp_replace(c, "^\ufeff", "")))
    out = rows.join(heads.select("__file", clean.alias("header"), F.col("h.__row").alias("__first")), "__file")
    return out.where(F.col("__row") > F.col("__first")).select("recording_id", "__file", "__row", "header", "cells")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The commonest of , ; tab and | in the first line."""
    line = spark.read.text(path).first()
    return max(",;\t|", key=(line["value"] if line else "").count)


def _place(names: tuple[str, ...], exact: bool = False) -> Column:
    """Place, from 0, of the first column of the file's header that has one of the names; null where none has."""
    places = F.transform("header", lambda h, i: F.when((h if exact else F.lower(h)).isin(*names), i))
    return F.array_min(F.filter(places, lambda i: i.isNotNull()))


def _cell(place: Column) -> Column:
    return F.get("cells", place)


def with_rejects(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with `reason`): the first rule that holds names the reason."""
    reason = F.lit(None).cast("string")
    for text, bad in reversed(rules):
        reason = F.when(bad, text).otherwise(reason)
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def intervals(spark: SparkSession, path: str | list[str], strict: bool = False, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """Interval files: (recording_id, name, start_s, stop_s, channel) and rejects.

    `strict` wants the columns name, start_seconds and stop_seconds in every file and takes no
    names "nan"; otherwise aliases count and the first column stands in for a missing name. NaN
    times are kept.
    """
    raw = _csv(spark, path, sep)
    at = {f: _place((ALIASES[f][0],) if strict else ALIASES[f]) for f in ("name", "start_s", "stop_s")}
    if strict:
        whole = at["name"].isNotNull() & at["start_s"].isNotNull() & at["stop_s"].isNotNull()
        missing = F.raise_error(F.concat(F.lit("columns name, start_seconds, stop_seconds expected in "), F.col("__file")))
        raw = raw.withColumn("cells", F.when(whole, F.col("cells")).otherwise(missing.cast("array<string>")))
    number = lambda place: _cell(place).try_cast("double")
    df = raw.select("recording_id", _cell(F.coalesce(at["name"], F.lit(0))).alias("name"), number(at["start_s"]).alias("start_s"), number(at["stop_s"]).alias("stop_s"), number(_place(ALIASES["channel"])).alias("channel"))
    empty = F.col("name").isNull() | (F.col("name") == "") | (F.lower("name") == "nan" if strict else F.lit(False))
    return with_rejects(df, [("no name", empty), ("bad start", F.col("start_s").isNull()), ("bad stop", F.col("stop_s").isNull())])


def segments(spark: SparkSession, path: str | list[str], checked: bool = True) -> tuple[DataFrame, DataFrame]:
    """Segment files: (recording_id, unit_id, start_s, stop_s, f_low_hz, f_high_hz) and rejects.

    A missing unit id is the row's ordinal from 0. `checked` rejects rows without a band, empty
    spans and empty bands.
    """
    raw = _csv(spark, path)
    found = lambda f: F.coalesce(*(F.nullif(_cell(_place((a,), exact=True)), F.lit("")) for a in SEGMENT_ALIASES[f]))
    ordinal = F.row_number().over(Window.partitionBy("__file").orderBy("__row")) - 1
    number = lambda f: found(f).try_cast("double").alias(f)
    df = raw.select("recording_id", F.coalesce(found("unit_id").try_cast("long"), ordinal).alias("unit_id"), *(number(f) for f in ("start_s", "stop_s", "f_low_hz", "f_high_hz")))
    rules = [("bad time", F.col("start_s").isNull() | F.col("stop_s").isNull())]
    if checked:
        rules += [("no band", F.col("f_low_hz").isNull() | F.col("f_high_hz").isNull()), ("empty span", F.col("stop_s") <= F.col("start_s")), ("empty band", F.col("f_high_hz") <= F.col("f_low_hz"))]
    return with_rejects(df, rules)


def segments_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines `Unit n: a s - b s | lo-hi Hz`, the bar optional, as segments with valid spans and bands."""
    number = r"([0-9.]+)"
    line = rf"^\s*Unit\s+(\d+):\s*{number}\s*s\s*-\s*{number}\s*s\s*\|?\s*{number}\s*-\s*{number}\s*Hz\s*$"
    part = lambda k, kind: F.regexp_extract("value", line, k).try_cast(kind)
    rows = spark.read.text(path).select(recording_id().alias("recording_id"), part(1, "long").alias("unit_id"), part(2, "double").alias("start_s"), part(3, "double").alias("stop_s"), part(4, "double").alias("f_low_hz"), part(5, "double").alias("f_high_hz"))
    return rows.where("stop_s > start_s and f_high_hz > f_low_hz")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments by the file's ending: .txt lines, else CSV."""
    return segments_text(spark, path) if path.lower().endswith(".txt") else segments(spark, path)[0]


def matrix(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(recording_id, unit_id, values): rows of numbers, a header line allowed; other cells are an error."""
    raw = spark.read.option("header", False).option("inferSchema", False).csv(path)
    cells = F.array(*(F.col(f"`{c}`") for c in raw.columns))
    rows = raw.select(recording_id().alias("recording_id"), cells.alias("cells"), F.monotonically_increasing_id().alias("__row"))
    numbers = F.transform("cells", lambda c: F.trim(c).try_cast("double"))
    rows = rows.withColumn("values", numbers).withColumn("__n", F.row_number().over(Window.partitionBy("recording_id").orderBy("__row")))
    header = (F.col("__n") == 1) & F.exists("values", lambda v: v.isNull())
    body = rows.where(~header)
    bad = F.exists("values", lambda v: v.isNull())
    unit = F.row_number().over(Window.partitionBy("recording_id").orderBy("__row")) - 1
    checked = F.when(bad, F.raise_error(F.lit("a cell is not a number")).cast("array<double>")).otherwise(F.col("values"))
    return body.select("recording_id", unit.cast("long").alias("unit_id"), checked.alias("values"))


def label_lines(spark: SparkSession, path: str | list[str], blanks: bool = False) -> DataFrame:
    """(recording_id, unit_id, label): one label a line, or the first cell of each row of a .csv file.

    Blank lines are skipped, so that labels stay at the places of a positional join; with `blanks`
    they are units without a label. A first row of a table that names the column is its header.
    """
    rows = spark.read.option("wholetext", True).text(path).select(recording_id().alias("recording_id"), F.lower("_metadata.file_path").endswith(".csv").alias("__table"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line", "value"))
    quoted = F.regexp_extract("value", r'^\s*"((?:[^"]|"")*)"', 1)
    cell = F.when(F.col("value").rlike(r'^\s*"'), F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(F.get(F.split("value", ","), F.lit(0)))
    label = F.trim(F.regexp_replace(F.when(F.col("__table"), cell).otherwise(F.col("value")), "^\ufeff", ""))
    rows = rows.withColumn("label", F.nullif(label, F.lit("")))
    header = F.col("__table") & (F.col("line") == 0) & F.coalesce(F.lower("label").isin(*LABEL_HEADERS), F.lit(False))
    rows = rows.where(~header)
    if not blanks:
        rows = rows.where("label is not null")
    unit = F.row_number().over(Window.partitionBy("recording_id").orderBy("line")) - 1
    return rows.select("recording_id", unit.cast("long").alias("unit_id"), "label")


def is_segment_table(path: Column) -> Column:
    """Whether a file is a table of segments: its stem ends in _segments and is no table of their remarks."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return stem.endswith("_segments") & ~stem.contains("_segments_info")


def is_feature_table(path: Column) -> Column:
    """Whether a file is a table of features: its name ends in _MFCC.csv."""
    return F.lower(path).endswith("_mfcc.csv")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"path": [], "rate": [], "channel": [], "samples": [], "error": []}
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            try:
                with wave.open(io.BytesIO(content)) as f:
                    rate, channels, width, raw = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())
                if width == 1:
                    x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
                elif width == 3:
                    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                    x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
                else:
                    x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
                found = [(c, x[c::channels].tolist(), None) for c in range(channels)]
            except (wave.Error, EOFError, ValueError) as e:
                rate, found = None, [(None, None, str(e))]
            for c, x, error in found:
                for k, v in zip(out, (path, rate, c, x, error)):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["path"], pa.string()), pa.array(out["rate"], pa.int32()), pa.array(out["channel"], pa.int32()), pa.array(out["samples"], pa.list_(pa.float32())), pa.array(out["error"], pa.string())], names=list(out))


def waves(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(recording_id, folder, path, rate, channel, samples, error) of .wav and .WAV files below a path, each path once.

    The folder's name is the label where clips are kept by label. Files that do not decode have an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{wav,WAV}").load(path).dropDuplicates(["path"])
    rows = files.select("path", "content").mapInArrow(_decoded, "path string, rate int, channel int, samples array<float>, error string")
    part = F.split("path", "/")
    return rows.select(F.regexp_replace(F.element_at(part, -1), r"\.[wW][aA][vV]$", "").alias("recording_id"), F.element_at(part, -2).alias("folder"), "path", "rate", "channel", "samples", "error")


def wave_durations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(recording_id, rate, duration_s) of audio files."""
    return waves(spark, path).where("channel = 0").select("recording_id", "rate", (F.size("samples") / F.col("rate")).alias("duration_s"))


def clips(intervals_df: DataFrame, waves_df: DataFrame) -> DataFrame:
    """Samples [trunc(start * rate), trunc(stop * rate)) of each interval in its recording and channel."""
    first, last = (F.col("start_s") * F.col("rate")).cast("int"), (F.col("stop_s") * F.col("rate")).cast("int")
    both = intervals_df.drop("channel").join(waves_df.select("recording_id", "rate", F.col("channel").alias("wave_channel"), "samples"), "recording_id")
    ok = both.where((first >= 0) & (last > first) & (first < F.size("samples")))
    return ok.withColumn("samples", F.slice("samples", first + 1, last - first))


def dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A dataset tree written by split; one split reads its own files alone."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)
