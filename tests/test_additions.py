"""Sources, sinks and edits around the main chains: sheets, clips, changed files, reports, predictions, features."""

import io
import wave

import numpy as np

from quillspan.functions import dsp
from quillspan.operators import workflows as wf
from quillspan.sources import events, readers, writers


def test_features_have_names_and_known_values():
    names = dsp.feature_names()
    t = np.arange(8000) / 16000
    x = np.sin(2 * np.pi * 3000 * t)
    got = dict(zip(names, dsp.segment_features(x, 16000, 1.0, 1.5, 2500.0, 3500.0)))
    assert len(names) == 88 == len(got) and got["duration"] == 0.5 and got["bandwidth"] == 1000.0
    assert abs(got["spectral_centroid_mean"] - 3000) < 60 and abs(got["spectral_rolloff_mean"] - 3000) < 3 * 16000 / 512
    s = dsp.centred_spectrogram(x, 512, 256)
    assert s.shape == (32, 257) and got["shape_aspect_ratio"] == 32 / 257 and got["shape_total_pixels"] == (s > np.percentile(s, 75)).sum()
    assert dsp.segment_features(x[:400], 16000, 0.0, 0.025, 1.0, 2.0) is None and dsp.slope_width(2) is None and dsp.slope_width(8) == 7


def test_closing_leaves_the_first_row_and_column_empty():
    mask = np.ones((6, 5), bool)
    assert not wf._clean(mask, 2)[0].any() and not wf._clean(mask, 2)[:, 0].any() and wf._clean(mask, 2)[1:, 1:].all()
    one = np.zeros((8, 8), bool)
    one[3:5, 3:5] = one[3:5, 6:8] = True
    assert wf._clean(one, 2)[3:5, 3:8].all()  # the gap between two blocks is closed


def test_clips_become_files(spark, tmp_path):
    clips = spark.createDataFrame([("r", 0, 7, "a b", 8000, [0.0, 0.5, -1.0, 2.0])], "recording_id string, channel int, unit_id int, name string, rate int, samples array<double>")
    files = writers.clip_files(clips)
    for _ in range(2):
        writers.write_files(files, str(tmp_path / "clips"))
    path = tmp_path / "clips" / "ch0_r_id007_a_b.wav"
    with wave.open(io.BytesIO(path.read_bytes())) as f:
        assert f.getframerate() == 8000 and np.frombuffer(f.readframes(4), "<i2").tolist() == [0, 16384, -32768, 32767]


def test_only_changed_recordings_are_written(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "recording_id string, x int")
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), ("d", 1)], "recording_id string, x int")
    assert sorted(map(tuple, writers.changed_only(new, old, ["recording_id"]).collect())) == [("b", 5), ("d", 1)]


def test_sheets_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 0.5), ("yy", 20, None)], "label string, n int, f1 double")
    writers.write_sheets({"one": df, "two": [df, df.where("n = 1")]}, str(tmp_path / "book"))
    assert spark.read.option("header", True).csv(str(tmp_path / "book" / "two" / "1")).count() == 1
    assert writers.report_text(df) == "label   n      f1\nx       1  0.5000\nyy     20        "
    counts = spark.createDataFrame([("x", "x", 3), ("x", "yy", 10)], "t string, p string, n int")
    assert writers.confusion_text(counts, ["x", "yy"]).split() == ["x", "yy", "x", "3", "10", "yy", "0", "0"]
    name = spark.range(1).select(writers.run_name("run_").alias("n")).first()["n"]
    assert len(name) == 19 and name.startswith("run_2")


def test_events_of_predictions_and_data_sets(spark, tmp_path):
    df = events.from_lists(spark, ["a"], [1.0], [2.0])
    got = events.from_predictions(df, {"e": [0.5]}, {"s": [(1.0, 3.0)]})
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, 2.0), ("e", 0.5, 0.5), ("s", 1.0, 3.0)]
    long = spark.createDataFrame([(1, "a", "start_seconds", 1.0), (1, "a", "stop_seconds", 2.0), (2, "b", "start_seconds", 4.0)], "event long, name string, event_time string, value double")
    assert sorted(map(tuple, events.from_dataset(long, {"b": "c"}).collect())) == [("a", 1.0, 2.0), ("c", 4.0, 4.0)]
    rows = spark.createDataFrame([("train", 1.0), ("val", 2.0)], "split string, x double")
    writers.write_split(rows, str(tmp_path / "set"))
    assert readers.dataset(spark, str(tmp_path / "set"), "val").first()["x"] == 2.0 and readers.dataset(spark, str(tmp_path / "set")).count() == 2


def test_windows_with_sequences_subsets_and_masks(spark):
    from quillspan.operators import signal

    n = 30
    df = spark.createDataFrame([(1, [float(i) for i in range(n)], [[float(i % 3 == 0), float(i % 3 > 0)] for i in range(n)])], "k long, x array<double>, y array<array<double>>")
    rows = signal.training_windows(df, "k", "x", "y", 8, 2, 3, sequence=True, output_stride=2, padding=1, class_weights=[5.0, 1.0], mask=1).orderBy("window_id").collect()
    assert len(rows) == 12
    for r in rows:
        a = 2 * r["window_id"]
        assert r["x"] == [0.0 if i in (3, 4) else float(a + i) for i in range(8)]
        labels = [(a + i) % 3 == 0 for i in (0, 2, 4, 6)]
        assert [p[0] == 1.0 for p in r["y"]] == labels
        assert r["w"] == [0.0, *(5.0 if x else 1.0 for x in labels[1:3]), 0.0]
    assert [r["y"] for r in signal.training_windows(df, "k", "x", "y", 8, 2, 3, offset=0).orderBy("window_id").collect()] == [[float(2 * i % 3 == 0), float(2 * i % 3 > 0)] for i in range(12)]
    part = signal.training_windows(df, "k", "x", "y", 8, 1, 1, share=0.5, seed=1)
    assert 0 < part.count() < 23 and sorted(map(str, part.collect())) == sorted(map(str, part.collect()))
