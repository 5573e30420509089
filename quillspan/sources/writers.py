"""Writers: fixed number formats, one folder per recording, totals and rejects as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumbered(df: DataFrame) -> DataFrame:
    """unit_id as 0, 1, .. by start within each recording."""
    return df.withColumn("unit_id", F.row_number().over(Window.partitionBy("recording_id").orderBy("start_s", "stop_s")) - 1)


def segment_rows(df: DataFrame) -> DataFrame:
    """Segments as text: times with six decimals, frequencies with two."""
    six, two = lambda c: F.format_string("%.6f", c), lambda c: F.format_string("%.2f", c)
    return df.select(
        "recording_id", "unit_id", six(F.col("start_s")).alias("t_start_s"), six(F.col("stop_s")).alias("t_end_s"), six(F.col("stop_s") - F.col("start_s")).alias("duration_s"), two(F.col("f_low_hz")).alias("f_low_hz"), two(F.col("f_high_hz")).alias("f_high_hz")
    )


def write_segments(df: DataFrame, path: str) -> None:
    """Segment CSV files by recording."""
    segment_rows(df).write.mode("overwrite").partitionBy("recording_id").option("header", True).csv(path)


def write_annotations(df: DataFrame, path: str) -> None:
    """Annotation CSV files: name, start_seconds, stop_seconds, channel 0.0."""
    out = df.select("recording_id", "name", F.col("start_s").alias("start_seconds"), F.col("stop_s").alias("stop_seconds"), F.lit(0.0).alias("channel"))
    out.write.mode("overwrite").partitionBy("recording_id").option("header", True).csv(path)


def write_matrix(df: DataFrame, path: str, names: list[str] | None = None) -> None:
    """A `values` array as numbered columns with six decimals."""
    n = len(names) if names else df.select(F.size("values")).first()[0]
    names = names or [f"feature_{i}" for i in range(n)]
    df.select("recording_id", *(F.format_string("%.6f", F.col("values")[i]).alias(c) for i, c in enumerate(names))).write.mode("overwrite").partitionBy("recording_id").option("header", True).csv(path)


def write_confusion(counts: DataFrame, path: str, labels: list[str]) -> None:
    """A confusion table as a square."""
    counts.groupBy("t").pivot("p", labels).agg(F.sum("n")).fillna(0).orderBy("t").write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, path: str) -> None:
    """A dataset tree: Parquet by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def rejects_summary(rejects: DataFrame) -> DataFrame:
    """(reason, n) of rejected rows."""
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def with_placeholders(df: DataFrame, classes: DataFrame) -> DataFrame:
    """One row at least for each class (name, category): without intervals NaN times, for segments a stop of 0."""
    nan = F.lit(float("nan"))
    stop = F.when(F.col("category") == "segment", 0.0).otherwise(nan)
    return classes.join(df, "name", "left").withColumns({"start_s": F.coalesce("start_s", nan), "stop_s": F.coalesce("stop_s", stop)})


def write_sheets(tables: dict[str, DataFrame | list[DataFrame]], path: str) -> None:
    """A workbook as a folder: one folder of CSV files per sheet, and of a sheet with several tables one below it for each."""
    for sheet, held in tables.items():
        for k, df in enumerate(held if isinstance(held, list) else [held]):
            where = f"{path}/{sheet}/{k}" if isinstance(held, list) else f"{path}/{sheet}"
            df.write.mode("overwrite").option("header", True).csv(where)


def clip_files(clips: DataFrame, prefix: str = "ch") -> DataFrame:
    """(file, content) of clips (recording_id, channel, unit_id, name, rate, samples): 16-bit WAV files named channel, recording, number, label."""
    import io
    import wave

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for rate, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                made = io.BytesIO()
                with wave.open(made, "wb") as f:
                    f.setnchannels(1)
                    f.setsampwidth(2)
                    f.setframerate(rate)
                    f.writeframes(np.clip(np.round(np.asarray(x, float) * 32768), -32768, 32767).astype("<i2").tobytes())
                out.append(made.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["file", "content"])

    label = F.regexp_replace(F.coalesce("name", F.lit("")), r'[\\/:*?"<>|\s]', "_")
    name = F.concat(F.lit(prefix), F.col("channel").cast("string"), F.lit("_"), F.col("recording_id").cast("string"), F.format_string("_id%03d_", "unit_id"), label, F.lit(".wav"))
    return clips.select(name.alias("file"), "rate", "samples").mapInArrow(run, "file string, content binary")


def write_files(files: DataFrame, path: str) -> None:
    """Each row (file, content) as a file below a path that all executors reach; a file that is there is replaced, so tasks may run again."""

    def put(rows) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(base, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{base}/{row['file']}") as f:
                f.write(bytes(row["content"]))

    files.foreachPartition(put)


def changed_only(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the new table of those keys whose rows differ from the old table's, for writers that leave unchanged files alone."""
    mark = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(f"n{n}"), F.sum(F.xxhash64(*new.columns).cast("decimal(38,0)")).alias(f"h{n}"))
    both = mark(new, 1).join(mark(old.select(new.columns), 2), keys, "left")
    return new.join(both.where("n2 is null or n1 <> n2 or h1 <> h2").select(keys), keys, "left_semi")


def report_text(per_class: DataFrame, label: str = "label") -> str:
    """A table of a row per class as aligned text."""
    rows = per_class.orderBy(label).collect()  # a row per class
    cells = [per_class.columns] + [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    width = [max(len(c[i]) for c in cells) for i in range(len(cells[0]))]
    return "\n".join("  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(row, width))) for row in cells)


def confusion_text(counts: DataFrame, labels: list[str]) -> str:
    """A confusion table (t, p, n) as a square of aligned text, rows true and columns told."""
    n = {(r["t"], r["p"]): r["n"] for r in counts.collect()}  # at most classes times classes
    cells = [["", *labels]] + [[t, *(str(n.get((t, p), 0)) for p in labels)] for t in labels]
    width = max(len(c) for row in cells for c in row)
    return "\n".join("  ".join(c.rjust(width) for c in row) for row in cells)


def run_name(prefix: str = "") -> Column:
    """A name from the time the query began, in the session's zone."""
    return F.concat(F.lit(prefix), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))
