"""Hand-made cases of the interval, frame and sequence operators."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import labels
from quillspan.operators import align, frames as fr, intervals as iv, metrics, sequence as sq


def mask(spark, text):
    return spark.createDataFrame([(1, i) for i, c in enumerate(text) if c == "1"], "recording_id long, frame long"), spark.createDataFrame([(1, 0, len(text) - 1)], "recording_id long, lo long, hi long")


def text_of(runs, n):
    out = ["-"] * n
    for r in runs.collect():
        for i in range(r["first"], r["last"] + 1):
            out[i] = "1"
    return "".join(out)


@pytest.mark.parametrize("given, gap, want", [("---111111-1111---", 2, "---11111111111---"), ("11-111---", 2, "11-111---"), ("--1--1--", 2, "--1--1--")])
def test_fill_gaps(spark, given, gap, want):
    frames, edges = mask(spark, given)
    assert text_of(fr.bridged(fr.islands(frames, ["recording_id"]), ["recording_id"], gap, False, edges), len(given)) == want


def test_bridge_takes_equal_gaps(spark):
    frames, _ = mask(spark, "--1--1--")
    assert text_of(fr.bridged(fr.islands(frames, ["recording_id"]), ["recording_id"], 2, True), 8) == "--1111--"


def test_drop_short(spark):
    frames, edges = mask(spark, "---1111-1---1--")
    assert text_of(fr.long_enough(fr.islands(frames, ["recording_id"]), ["recording_id"], 2, edges), 15) == "---1111--------"


def test_runs_to_ends(spark):
    frames, _ = mask(spark, "11011001")
    rows = fr.islands(frames, ["recording_id"]).orderBy("first").collect()
    assert [(r["first"], r["last"]) for r in rows] == [(0, 1), (3, 4), (7, 7)]


def test_iou(spark):
    row = spark.range(1).select(iv.iou(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(3.0)).alias("a"), iv.iou(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("b")).first()
    assert row["a"] == pytest.approx(1 / 3) and row["b"] == 0


def test_greedy(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 1, 0.5), (1, 1, 0, 0.4)], "k long, i long, j long, iou double")
    assert sorted((r["i"], r["j"]) for r in iv.greedy_match(pairs, ["k"]).collect()) == [(0, 0), (1, 1)]


def test_stab_tie_goes_to_the_later(spark):
    df = spark.createDataFrame([(1, 0, "a", 0.0, 2.0), (1, 1, "b", 0.0, 2.0)], "recording_id long, event_id long, name string, start_s double, stop_s double")
    assert {r["name"] for r in fr.stab(df, 1.0).collect()} == {"b"}


def test_prf_without_rows(spark):
    df = spark.createDataFrame([("a", 0, 0, 0)], "label string, tp long, fp long, fn long")
    row, micro = metrics.prf(df).first(), metrics.prf(df, micro=True).first()
    assert (row["precision"], row["recall"]) == (1, 1) and (micro["precision"], micro["recall"]) == (0, 0)


def test_interval_filter(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.2), (1, 2, 5.0)], "recording_id long, id long, t double")
    assert [r["id"] for r in iv.isolated_filter(df, 0.5, 100.0).orderBy("id").collect()] == [0, 2]


def test_normalise_and_labels(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, 3.0)], "f long, idx int, v double")
    rows = fr.normalised(df, ["f"], "v", 2).orderBy("f", "idx").collect()
    assert [r["p"] for r in rows] == [0.5, 0.5, 0.25, 0.75]
    p = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.6), (1, 2, 0.7)], "f long, idx int, p double")
    assert fr.first_above(p, ["f"], 0.5).first()["label"] == 1 and fr.best_class(p, ["f"]).first()["label"] == 2


def test_pair_merge(spark):
    df = spark.createDataFrame([(1, 1, "R", 2), (1, 2, "H", 1), (1, 3, "R1", 1)], "k long, run long, name string, n long")
    row = sq.run_array(df, ["k"]).select(sq.merged_pairs(F.col("rs"), [("R", "H"), ("H", "R1")]).alias("p"), sq.pattern(F.col("rs")).alias("q")).first()
    assert row["p"] == "(R-H)(1)-R1(1)" and row["q"] == "R(2)-H(1)-R1(1)"


def test_recode_is_one_pass(spark):
    df = spark.createDataFrame([("C'",), ("R1",), ("S",), ("Z",)], "n string")
    table = {"C'": "B", "R1": "R", "S": "K", "B": "never"}
    assert [r[0] for r in df.select(labels.recode(F.col("n"), table)).collect()] == ["B", "R", "K", "Z"]


def aligned(spark, segment, manuals):
    s = spark.createDataFrame([(1, 0, *segment)], "recording_id long, unit_id long, start_s double, stop_s double")
    m = spark.createDataFrame([(1, i, *x) for i, x in enumerate(manuals)], "recording_id long, ord long, name string, start_s double, stop_s double")
    row = align.align_labels(s, m).first()
    return row["label"], row["remark"]


def test_alignment(spark):
    assert aligned(spark, (0.0, 1.0), [("a", 0.0, 0.5), ("b", 0.5, 1.0)]) == ("a", "miss b")
    assert aligned(spark, (5.0, 6.0), [("a", 0.0, 0.5)]) == ("", "")
    assert aligned(spark, (0.0, 1.0), [(" A ", 0.1, 1.1)]) == ("a", "")
    assert aligned(spark, (0.0, 1.0), [("a", 0.0, 0.99), ("b", 0.995, 1.1)]) == ("a", "less b")


def test_remark_counts(spark):
    df = spark.createDataFrame([("miss a b",), ("less x",), ("",)], "r string")
    assert [r[0] for r in df.select(align.missed_in(F.col("r"))).collect()] == [2, 1, 0]


def test_edit_distance(spark):
    assert spark.range(1).select(F.levenshtein(F.lit("ABCDAAE"), F.lit("ABDAAE"))).first()[0] == 1


def test_zip_policies(spark):
    a = spark.createDataFrame([(1, i) for i in range(3)], "recording_id long, u long")
    b = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "recording_id long, v long, label string")
    get = lambda **k: [r["label"] for r in iv.zip_padded(a, b, "u", "v", "label", **k).orderBy("u").collect()]
    assert get() == ["x", "y", "y"] and get(policy="constant", constant="?") == ["x", "y", "?"] and get(policy="truncate") == ["x", "y"]
    with pytest.raises(Exception, match="counts differ"):
        get(policy="strict")


def test_numbers(spark):
    row = spark.range(1).select(labels.half_even(F.lit(2.5), 0).alias("h"), labels.power_of_two_floor(F.lit(1000)).alias("p"), labels.is_power_of_two(F.lit(64)).alias("t"), labels.conv_length(F.lit(10), 3, 2).alias("c")).first()
    assert (row["h"], row["p"], row["t"], row["c"]) == (2.0, 512, True, 4)
