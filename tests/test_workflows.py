"""Whole chains on small made-up recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import tcn
from quillspan.operators import workflows as wf

RATE = 16000


@pytest.fixture(scope="module")
def waves(spark):
    t = np.arange(RATE) / RATE
    x = np.where((t > 0.2) & (t < 0.4) | (t > 0.6) & (t < 0.8), np.sin(2 * np.pi * 4000 * t), 0.0) + 1e-4 * np.random.default_rng(0).normal(size=RATE)
    return spark.createDataFrame([("r", RATE, 0, [float(v) for v in x]), ("empty", RATE, 0, [])], "recording_id string, rate int, channel int, samples array<float>")


def test_units_are_found(waves):
    rows = wf.segment_units(waves).orderBy("unit_id").collect()
    assert len(rows) == 2
    assert rows[0]["start_s"] == pytest.approx(0.2, abs=0.07) and rows[1]["stop_s"] == pytest.approx(0.8, abs=0.07)
    assert rows[0]["f_low_hz"] <= 4000 <= rows[0]["f_high_hz"]


def test_features_and_rejects(spark, waves):
    segments = spark.createDataFrame([("r", 0, 0.2, 0.4, 3000.0, 5000.0), ("r", 1, 0.5, 0.5001, 1.0, 2.0), ("gone", 0, 0.0, 1.0, 1.0, 2.0)], "recording_id string, unit_id long, start_s double, stop_s double, f_low_hz double, f_high_hz double")
    good, bad = wf.segment_features(segments, waves)
    row = good.first()
    assert len(row["values"]) == 88 and row["values"][78] == pytest.approx(0.2) and np.isfinite(row["values"]).all()
    assert sorted(r["reason"] for r in bad.collect()) == ["no audio", "too short"]


def probs(spark, text):
    rows = [("r", i, k, 0.9 if (c == "1") == (k == 1) else 0.1) for i, c in enumerate(text) for k in (0, 1)]
    return spark.createDataFrame(rows, "recording_id string, frame long, idx int, p double")


def test_probabilities_to_segments(spark):
    out = wf.predicted_segments(probs(spark, "---111111-1111---1--"), ["noise", "song"], 10.0, fill=0.2, least=0.2)
    assert [(r["name"], r["start_s"], r["stop_s"]) for r in out.collect()] == [("song", 0.3, 1.3)]


def test_probabilities_to_events(spark):
    p = spark.createDataFrame([("r", i, 0, v) for i, v in enumerate([0.1, 0.9, 0.1, 0.8, 0.1, 0.1, 0.1, 0.1, 0.7, 0.1])], "recording_id string, frame long, idx int, p double")
    assert [r["start_s"] for r in wf.predicted_events(p, 0, "e", 10.0, distance=0.3).orderBy("start_s").collect()] == [0.1, 0.8]


def test_dataset(spark):
    df = spark.createDataFrame([("a", "x", 0.0, 1.0), ("a", "y", 0.5, 1.0), ("b", "x", 1.0, 2.0)], "recording_id string, name string, start_s double, stop_s double")
    lengths = spark.createDataFrame([("a", 40), ("b", 40)], "recording_id string, n long")
    y = wf.frame_labels(df, lengths, ["x", "y"], 0.1)
    got = {(r["recording_id"], r["frame"]): r["y"] for r in y.collect()}
    assert got["a", 0] == [1.0, 0.0] and got["a", 7] == [0.5, 0.5] and got["a", 30] == [0.5, 0.5] and len(got) == 80
    split = wf.dataset_split(y, test=16).groupBy("split").agg(F.count("*").alias("n")).collect()
    assert {r["split"]: r["n"] for r in split} == {"train": 40, "val": 40, "test": 16}


def test_network_over_a_recording(waves):
    out = wf.predicted_probabilities(waves, tcn.make(1, 4, 3), 1024, 128)
    assert out.count() == 3 * RATE
    assert out.groupBy("recording_id", "frame").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([("a" if i % 2 else "b", Vectors.dense([float(i % 2), float(i)])) for i in range(40)], ["label", "features"])
    wf.fit_best(df, str(tmp_path / "m"), "logistic_regression", ["a", "b"])
    assert wf.predict_with(df, str(tmp_path / "m")).where("name = label").count() == 40


def test_digest_and_params(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("1")
    one = wf.folder_digest(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "x").write_text("2")
    assert one != wf.folder_digest(spark, str(tmp_path / "d"))
    wf.save_params({"a": [1, 2]}, str(tmp_path / "p.json"))
    assert wf.load_params(str(tmp_path / "p.json")) == {"a": [1, 2]}
