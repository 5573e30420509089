"""Files in and out, edits and streams."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.sources import events, readers, writers
from quillspan.streaming import sequences


def test_interval_files(spark, tmp_path):
    (tmp_path / "bird1_annotations.csv").write_text("﻿Name , start_seconds,stop_seconds\na,0.5,1.0\n,1,2\nb,x,2\nc,nan,nan\n")
    good, bad = readers.intervals(spark, str(tmp_path), strict=True)
    rows = good.orderBy("name").collect()
    assert [(r["recording_id"], r["name"]) for r in rows] == [("bird1", "a"), ("bird1", "c")]
    assert {r["reason"]: r["n"] for r in writers.rejects_summary(bad).collect()} == {"no name": 1, "bad start": 1}
    with pytest.raises(Exception, match="expected in"):
        (tmp_path / "bird2_annotations.csv").write_text("name,start\na,1\n")
        readers.intervals(spark, str(tmp_path), strict=True)[0].collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x_annotations.csv").write_text("Syllable,t_start,t_end\nq,1,2\n")
    assert readers.intervals(spark, str(tmp_path / "b"))[0].first()["stop_s"] == 2.0


def test_files_of_one_folder_have_their_own_headers(spark, tmp_path):
    (tmp_path / "a_annotations.csv").write_text("name,start_seconds,stop_seconds\nx,1,2\n")
    (tmp_path / "b_annotations.csv").write_text('channel,stop,start,label\n3,20,10,"y\nz"\n4,21,11,w\n')
    (tmp_path / "c_annotations.csv").write_text("what,t_end,t_start,stop_seconds\nq,5,4,9\n")
    good, bad = readers.intervals(spark, str(tmp_path))
    got = sorted((r["recording_id"], r["name"], r["start_s"], r["stop_s"], r["channel"]) for r in good.collect())
    assert got == [("a", "x", 1.0, 2.0, None), ("b", "w", 11.0, 21.0, 4.0), ("b", "y\nz", 10.0, 20.0, 3.0), ("c", "q", 4.0, 5.0, None)] and bad.count() == 0
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a_segments.csv").write_text("unit_id,t_start_s,t_end_s,f_low_hz,f_high_hz\n5,0,1,100,200\n6,1,2,,\n")
    (tmp_path / "s" / "b_segments.csv").write_text("f_high,f_low,t_end,t_start,t_start_s\n900,300,4,3,\n")
    good, bad = readers.segments(spark, str(tmp_path / "s"))
    got = sorted((r["recording_id"], r["unit_id"], r["start_s"], r["stop_s"], r["f_low_hz"], r["f_high_hz"]) for r in good.collect())
    assert got == [("a", 5, 0.0, 1.0, 100.0, 200.0), ("b", 0, 3.0, 4.0, 300.0, 900.0)]
    assert [r["reason"] for r in bad.collect()] == ["no band"] and readers.segments(spark, str(tmp_path / "s"), checked=False)[0].count() == 3


def test_file_roles(spark):
    names = ["/d/a_segments.csv", "/d/a_segments_info.csv", "/d/a_MFCC.csv", "/d/a_segments_info_segments.csv"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(readers.is_segment_table(F.col("p")).alias("s"), readers.is_feature_table(F.col("p")).alias("f")).collect()
    assert [(r["s"], r["f"]) for r in rows] == [(True, False), (False, False), (False, True), (False, False)]


def test_segments(spark, tmp_path):
    (tmp_path / "r_segments.csv").write_text("t_start_s,t_end_s,f_low_hz,f_high_hz\n0,1,100,200\n2,1,100,200\n3,4,300,200\n")
    good, bad = readers.segments(spark, str(tmp_path))
    assert [(r["recording_id"], r["unit_id"]) for r in good.collect()] == [("r", 0)]
    assert sorted(r["reason"] for r in bad.collect()) == ["empty band", "empty span"]
    (tmp_path / "old.txt").write_text("Unit 1: 0.5s - 1.5s | 200-900 Hz\nnoise\nUnit 2: 1s - 2s 200-900 Hz\n")
    row = readers.read_segments(spark, str(tmp_path / "old.txt")).orderBy("unit_id").first()
    assert readers.read_segments(spark, str(tmp_path / "old.txt")).count() == 2
    assert (row["unit_id"], row["start_s"], row["f_high_hz"]) == (1, 0.5, 900.0)
    writers.write_segments(good, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["t_end_s"] == "1.000000"


def test_matrix_and_labels(spark, tmp_path):
    (tmp_path / "a_MFCC.csv").write_text("f0,f1\n1,2\n3,4\n")
    assert [r["values"] for r in readers.matrix(spark, str(tmp_path / "a_MFCC.csv")).orderBy("unit_id").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    labels = lambda name, **how: [(r["unit_id"], r["label"]) for r in readers.label_lines(spark, str(tmp_path / name), **how).orderBy("unit_id").collect()]
    assert labels("a.txt") == [(0, "x"), (1, "y")] and labels("a.txt", blanks=True) == [(0, "x"), (1, None), (2, "y")]
    (tmp_path / "b.csv").write_text('Label,more\nx,1\n,2\n"y ""z"", w",3\n')
    (tmp_path / "c.csv").write_text("x\ny\n")
    assert labels("b.csv") == [(0, "x"), (1, 'y "z", w')] and labels("c.csv") == [(0, "x"), (1, "y")]
    (tmp_path / "s.csv").write_text("a;b;c\n1;2;3\n")
    assert readers.sniff_separator(spark, str(tmp_path / "s.csv")) == ";"


def test_waves(spark, tmp_path):
    (tmp_path / "A").mkdir()
    with wave.open(str(tmp_path / "A" / "x.WAV"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(100)
        f.writeframes(np.arange(400, dtype="<i2").tobytes())
    (tmp_path / "A" / "bad.wav").write_bytes(b"no audio")
    rows = readers.waves(spark, str(tmp_path))
    assert rows.where("error is not null").count() == 1
    assert rows.where("channel = 1").first()["samples"][1] == 3 / 32768 and rows.where("channel = 0").first()["folder"] == "A"
    cut = readers.clips(spark.createDataFrame([("x", "n", 0.5, 0.7)], "recording_id string, name string, start_s double, stop_s double"), rows.where("channel = 0"))
    assert len(cut.first()["samples"]) == 20


def test_edits(spark):
    df = events.from_lists(spark, ["a", "a", "b"], [1.0, 5.0, 2.0], [2.0, 6.0, 2.0])
    assert events.added(df, "c", 3).count() == 4 and events.without_name(df, "a").count() == 1
    assert events.moved(df, "a", 1.0, 1.5).where("name = 'a'").agg(F.min("stop_s")).first()[0] == 2.5
    assert events.deleted_near(df, "a", 4.9, 0.5).count() == 2 and events.deleted_near(df, "a", 3.0, 0.5).count() == 3
    assert {r["name"]: r["category"] for r in events.categories(df).collect()} == {"a": "segment", "b": "event"}
    classes = spark.createDataFrame([("a", "segment"), ("z", "event")], "name string, category string")
    assert writers.with_placeholders(df, classes).where("name = 'z' and isnan(stop_s)").count() == 1


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:01:00", "a"), (1, "2024-01-01 00:02:00", "b"), (1, "2024-01-01 01:02:00", "b")]
    df = spark.createDataFrame(rows, "key long, t string, name string").select("key", F.to_timestamp("t").alias("ts"), "name", F.lit(1.0).alias("value"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {}
    for name, out, mode in (("runs", sequences.runs(stream), "append"), ("counts", sequences.counts(stream), "complete"), ("sessions", sequences.sessions(stream), "complete")):
        q = out.writeStream.format("memory").queryName(f"t_{name}").outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        got[name] = spark.table(f"t_{name}").collect()
    assert [(r["name"], r["n"]) for r in got["runs"]] == [("a", 2)]
    assert sum(r["n"] for r in got["counts"]) == 4 and len(got["sessions"]) == 2
