"""Feature scaling, splits and folds, nearest neighbours, clustering, embeddings, classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their means over their population deviations; constant columns give 0."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    joined = df.join(F.broadcast(stats))  # one row
    return joined.select(*(c for c in df.columns if c not in columns), *(F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(c) for c in columns))


def group_split(df: DataFrame, group: str, share: float) -> DataFrame:
    """Adds `split`: whole groups to test, the first ones by hash, max(1, round(n * share)) of them."""
    groups = df.select(group).distinct().withColumn("__h", F.md5(F.col(group).cast("string")))
    n = groups.agg(F.count("*").alias("n")).first()["n"]
    take = min(max(1, round(n * share)), max(1, n - 1))
    test = groups.orderBy("__h").limit(take).select(group).withColumn("__t", F.lit(True))
    return df.join(test, group, "left").withColumn("split", F.when(F.col("__t"), "test").otherwise("train")).drop("__t")


def stratified_split(df: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """Adds `split`: of each class the same share to test, by hash of the key."""
    w = Window.partitionBy(label)
    rows = df.withColumns({"__r": F.row_number().over(w.orderBy(F.md5(F.col(key).cast("string")))), "__n": F.count("*").over(w)})
    return rows.withColumn("split", F.when(F.col("__r") <= F.floor(F.col("__n") * share), "test").otherwise("train")).drop("__r", "__n")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Adds `fold`: whole groups dealt to and fro over the folds in order of size."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    place = F.row_number().over(Window.orderBy(F.desc("__n"), group)) - 1
    turn, at = F.floor(place / k), place % k
    fold = F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int")
    return df.join(sizes.select(group, fold.alias("fold")), group)


def stratified_folds(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Adds `fold`: the rows of each class dealt round over the folds by hash of the key; a class of fewer rows than folds is an error."""
    w = Window.partitionBy(label)
    rows = df.withColumns({"__r": F.row_number().over(w.orderBy(F.md5(F.col(key).cast("string")), key)), "__n": F.count("*").over(w)})
    fold = F.when(F.col("__n") < k, F.raise_error(F.lit("a class has fewer rows than folds")).cast("int")).otherwise(((F.col("__r") - 1) % k).cast("int"))
    return rows.withColumn("fold", fold).drop("__r", "__n")


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 1024, parts: int = 32) -> DataFrame:
    """(query, neighbour, distance, place): the k rows nearest each stated query, itself left out.

    Queries come in blocks of about `block`, rows in `parts` parts; every block meets every part in a
    task of its own, which keeps k of its rows a query, and only those go on. Nothing passes the
    driver, and no task holds more than a block and the running best. Ties go to the smaller key.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    asked = queries.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.lit(True).alias("q"))
    held = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key, F.lit(5)), F.lit(parts)).alias("p"))
    left = asked.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    right = held.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            ids, vectors = a["key"].to_numpy(), np.array(a["v"].to_pylist(), float)
            best_d, best_i = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
            for batch in b.to_batches(max_chunksize=2048):
                own, x = batch["key"].to_numpy(), np.array(batch["v"].to_pylist(), float)
                for i, v in enumerate(vectors):
                    d = np.round(np.sqrt(((x - v) ** 2).sum(axis=1)), 9)
                    d[own == ids[i]] = np.inf
                    both, who = np.concatenate([best_d[i], d]), np.concatenate([best_i[i], own])
                    top = np.lexsort((who, both))[:k]
                    best_d[i], best_i[i] = both[top], who[top]
            i, j = np.nonzero(np.isfinite(best_d))
            out = ids[i].tolist(), best_i[i, j].tolist(), best_d[i, j].tolist()
        return pa.table({"query": pa.array(out[0], pa.int64()), "neighbour": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.float64())})

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInArrow(run, "query long, neighbour long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def as_vectors(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    """An array column as a vector column."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def clustered(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Adds `cluster` by k-means on `features`."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(df).transform(df)


def embedded(df: DataFrame, k: int = 2) -> DataFrame:
    """Adds `embedding_k`: the first principal components of `features`."""
    from pyspark.ml.feature import PCA

    return PCA(k=k, inputCol="features", outputCol="embedding_k").fit(df).transform(df)


def models(rows: int | None = None) -> dict:
    """The three candidate classifiers; the kernel machine is a linear one, as Spark has no RBF kernel.

    The linear machine and logistic regression scale the features themselves; their penalty is that
    of a cost of 1 a row, which Spark's mean loss needs the number of `rows` for (none: no penalty).
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier

    penalty = 1 / rows if rows else 0.0
    return {
        "linear_svm": OneVsRest(classifier=LinearSVC(maxIter=1000, tol=1e-3, regParam=penalty), labelCol="label", featuresCol="features", parallelism=4),
        "random_forest": RandomForestClassifier(numTrees=200, seed=42, labelCol="label", featuresCol="features"),
        "logistic_regression": LogisticRegression(maxIter=1000, tol=1e-4, regParam=penalty, labelCol="label", featuresCol="features"),
    }


def cross_validated(df: DataFrame, folds: int, names: tuple[str, ...] = ("linear_svm", "random_forest", "logistic_regression"), parallelism: int = 4, rows_a_part: int = 20_000) -> DataFrame:
    """(model, mean_accuracy, std_accuracy, mean_f1, std_f1, best) over the `fold` column; deviations are of the population.

    `best` marks the largest mean macro F1, of equal ones the first in `names`. The rows are kept in
    memory, in parts of about `rows_a_part`, since training reads them many times; `parallelism`
    fits run at once.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    from quillspan.operators.metrics import confusion, from_confusion, prf, summary

    rows = df.select("label", "features", "fold")
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}  # a row per fold
    total = sum(sizes.values())
    rows = rows.repartition(max(1, -(-total // rows_a_part)), F.xxhash64("features", "label")).persist()

    def one(task: tuple[str, int]) -> tuple[str, float, float]:
        name, fold = task
        told = models(total - sizes.get(fold, 0))[name].fit(rows.where(F.col("fold") != fold)).transform(rows.where(F.col("fold") == fold))
        pairs = told.select(F.col("label").cast("int").cast("string").alias("t"), F.col("prediction").cast("int").cast("string").alias("p"))
        row = summary(prf(from_confusion(confusion(pairs)))).first()  # a row
        return name, row["accuracy"], row["macro_f1"]

    try:
        with ThreadPool(parallelism) as pool:
            found = pool.map(inheritable_thread_target(df.sparkSession)(one), [(name, fold) for name in names for fold in range(folds)])
    finally:
        rows.unpersist()
    made = df.sparkSession.createDataFrame([x for x in found if x[1] is not None], "model string, accuracy double, macro_f1 double")
    out = made.groupBy("model").agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"), F.avg("macro_f1").alias("mean_f1"), F.stddev_pop("macro_f1").alias("std_f1"))
    place = F.array_position(F.lit(list(names)), F.col("model"))
    first = F.row_number().over(Window.orderBy(F.desc("mean_f1"), place))  # a row per model
    return out.withColumn("best", first == 1)


def refitted(df: DataFrame, scores: DataFrame):
    """The best model of cross_validated(), fitted on all rows."""
    return models(df.count())[scores.where("best").first()["model"]].fit(df)
