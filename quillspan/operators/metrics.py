"""Confusion tables and precision, recall and F1 with the fixed rules for empty denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, empty: Column) -> Column:
    """top / bottom, or `empty` where the bottom is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(empty)


def prf(df: DataFrame, micro: bool | Column = False, digits: int = 6) -> DataFrame:
    """Adds precision, recall, f1 to rows with tp, fp, fn.

    Per class an empty precision is 1 without misses, else 0, and an empty recall is 1; `micro`
    rows have 0 for both.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    micro = F.lit(micro) if isinstance(micro, bool) else micro
    p = ratio(tp, tp + fp, F.when(~micro & (fn == 0), 1.0).otherwise(0.0))
    r = ratio(tp, tp + fn, F.when(micro, 0.0).otherwise(1.0))
    out = df.withColumns({"__p": p.cast("double"), "__r": r.cast("double")})
    f1 = F.when(F.col("__p") + F.col("__r") > 0, 2 * F.col("__p") * F.col("__r") / (F.col("__p") + F.col("__r"))).otherwise(0.0)
    return out.withColumns({"precision": F.round("__p", digits), "recall": F.round("__r", digits), "f1": F.round(f1, digits)}).drop("__p", "__r")


def confusion(df: DataFrame, truth: str = "t", pred: str = "p", weight: str | None = None) -> DataFrame:
    """(t, p, n) of label pairs; `weight` is a column of counts, one a row without it."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(n.alias("n"))


def dense_confusion(counts: DataFrame) -> DataFrame:
    """(t, p, n) with zeros for all pairs of the labels seen on either side, a set whose size is the number of classes."""
    labels = counts.select(F.col("t").alias("x")).union(counts.select("p")).distinct()
    grid = labels.agg(F.collect_set("x").alias("xs")).select(F.explode("xs").alias("t"), "xs").select("t", F.explode("xs").alias("p"))
    return grid.join(counts, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def from_confusion(counts: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, support) of a confusion table."""
    rows = counts.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("t") == F.col("p"), 0).otherwise(F.col("n")).alias("fn")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col("t") == F.col("p"), 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    return rows.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumn("support", F.col("tp") + F.col("fn"))


def summary(per_class: DataFrame, exclude: str | None = None, digits: int = 6) -> DataFrame:
    """(n, accuracy, macro_f1, weighted_f1) of per-class rows; `exclude` names a label left out of the macro mean."""
    kept = F.lit(True) if exclude is None else F.col("label") != exclude
    return per_class.agg(
        F.sum("support").alias("n"),
        F.round(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
        F.round(F.avg(F.when(kept, F.col("f1"))), digits).alias("macro_f1"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), digits).alias("weighted_f1"),
    )


def with_total(per_class: DataFrame, label: str = "label", total: str = "__micro__") -> DataFrame:
    """Per-class rows and one micro row of summed counts, in one pass over the classes."""
    rows = per_class.rollup(label).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), F.grouping(label).alias("__g"))
    micro = F.col("__g") == 1
    return prf(rows, micro).select(F.when(micro, total).otherwise(F.col(label)).alias(label), "tp", "fp", "fn", "precision", "recall", "f1")


def rank_of(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """Adds the row's place in its key, from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
