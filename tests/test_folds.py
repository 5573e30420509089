"""Stratified folds and the comparison of all candidate models."""

import collections

import pytest

from quillspan.operators import ml


def test_stratified_folds_share_out_each_class(spark):
    rows = spark.createDataFrame([(i, i % 3 if i < 30 else 0) for i in range(47)], "id long, label int")
    counts = collections.Counter((r["label"], r["fold"]) for r in ml.stratified_folds(rows, "label", "id", 5).collect())
    for label in range(3):
        per = [counts[label, f] for f in range(5)]
        assert max(per) - min(per) <= 1 and sum(per) == (27 if label == 0 else 10)
    with pytest.raises(Exception, match="fewer rows than folds"):
        ml.stratified_folds(rows, "label", "id", 11).collect()


def test_all_models_are_compared_and_one_is_best(spark):
    rows = spark.createDataFrame([(i, i % 2, [float(i % 2) + i % 5 / 10, float(i % 7)]) for i in range(60)], "id long, label int, x array<double>")
    out = ml.cross_validated(ml.stratified_folds(ml.as_vectors(rows, "x"), "label", "id", 2), 2).collect()
    assert sorted(r["model"] for r in out) == ["linear_svm", "logistic_regression", "random_forest"]
    best = [r for r in out if r["best"]]
    assert len(best) == 1 and best[0]["mean_f1"] == max(r["mean_f1"] for r in out)


def test_models_are_of_full_size():
    made = ml.models()
    assert made["random_forest"].getNumTrees() == 200 and made["logistic_regression"].getMaxIter() == 1000 and made["linear_svm"].getClassifier().getMaxIter() == 1000
