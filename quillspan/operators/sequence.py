"""Operators on ordered label sequences: runs, pair merging, transitions, gaps, edit distance, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: list[str], name: str = "name") -> DataFrame:
    """(keys, run, name, n): maximal runs of equal names in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.col(name).eqNullSafe(F.lag(name).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    marked = df.withColumn("__f", fresh).withColumn("run", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(F.first(name).alias("name"), F.count("*").alias("n"))


def run_array(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rs): the runs of each key as one ordered array."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", "name", "n"))).alias("rs"))


def pattern(rs: Column) -> Column:
    """A(3)-B(1)-... of a run array."""
    return F.array_join(F.transform(rs, lambda r: F.concat(r["name"], F.lit("("), r["n"].cast("string"), F.lit(")"))), "-")


def merged_pairs(rs: Column, pairs: list[tuple[str, str]]) -> Column:
    """The pattern with given neighbouring runs merged, from the left, as (A-B)(1)."""
    wanted = F.array(*(F.lit(f"{a}\x00{b}") for a, b in pairs))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))
    index = F.sequence(F.lit(0), F.size(rs) - 1)

    def step(acc: Column, i: Column) -> Column:
        here, there = F.get(rs, i), F.get(rs, i + 1)
        pair = there.isNotNull() & F.array_contains(wanted, F.concat(here["name"], F.lit("\x00"), F.coalesce(there["name"], F.lit(""))))
        plain = F.concat(here["name"], F.lit("("), here["n"].cast("string"), F.lit(")"))
        both = F.concat(F.lit("("), here["name"], F.lit("-"), there["name"], F.lit(")(1)"))
        return F.when(acc["skip"], F.struct(acc["out"].alias("out"), F.lit(False).alias("skip"))).otherwise(
            F.struct(F.array_append(acc["out"], F.when(pair, both).otherwise(plain)).alias("out"), pair.alias("skip"))
        )

    return F.when(F.size(rs) > 0, F.array_join(F.aggregate(index, start, step)["out"], "-")).otherwise(F.lit(""))


def with_next(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds next_name, next_start and the gap from this stop to the next start."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({"next_name": F.lead("name").over(w), "next_start": F.lead("start_s").over(w)})
    return out.withColumn("gap_s", F.col("next_start") - F.col("stop_s"))


def described(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear), max of a value per group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    r = lambda c: F.round(c, digits)
    return out.select(*keys, "n", r("mean").alias("mean"), r("std").alias("std"), r("min").alias("min"), r(F.col("q")[0]).alias("p25"), r(F.col("q")[1]).alias("p50"), r(F.col("q")[2]).alias("p75"), r("max").alias("max"))


def with_pitch(stats: DataFrame, pitch: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Statistics with the mean of `f0_hz` of the same keys; null where none was measured."""
    return stats.join(pitch.groupBy(*keys).agg(F.round(F.avg("f0_hz"), digits).alias("f0_mean")), keys, "left")


def age_report(songs: DataFrame, digits: int = 3) -> DataFrame:
    """(age, file, song_length): the songs, then each group's average and the difference of Young and Old."""
    r = lambda c: F.round(c, digits)
    mean = lambda age: F.avg(F.when(F.col("age") == age, F.col("song_length")))
    means = songs.agg(mean("Old").alias("o"), mean("Young").alias("y"))
    line = lambda age, file, value: F.struct(F.lit(age).alias("age"), F.lit(file).alias("file"), r(value).alias("song_length"))
    o, y = F.col("o"), F.col("y")
    rows = F.array(line("Old", "Average", o), line("Young", "Average", y), line("Diff(Young-Old)", "Average_Song_Length_Diff", y - o))
    return songs.select("age", "file", r("song_length").alias("song_length")).unionByName(means.select(F.inline(rows)))


def as_letters(names: Column, alphabet: list[str]) -> Column:
    """A label array as a string of one letter each, for edit distances over whole labels."""
    table = F.create_map(*(x for i, a in enumerate(alphabet) for x in (F.lit(a), F.lit(chr(0x100 + i)))))
    return F.array_join(F.transform(names, lambda n: F.coalesce(F.element_at(table, n), F.lit("?"))), "")


def error_rate(truth: Column, other: Column) -> Column:
    """Edit distance over the length of the truth; null for an empty truth."""
    return F.when(F.length(truth) > 0, F.levenshtein(truth, other) / F.length(truth))


def peaks(df: DataFrame, keys: list[str], at: str, value: str, least: float, distance: int) -> DataFrame:
    """(keys, at, value): local maxima of at least `least`, thinned so that no two kept are within `distance`.

    A plateau counts at its first place. Higher peaks go first, ties to the earlier place. Maxima
    further apart than `distance` cannot thin each other, so each cluster of near ones is a fold of
    its own.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    tops = df.withColumns({"__b": before, "__a": after}).where((F.col(value) > F.col("__b")) & (F.col(value) >= F.col("__a")) & (F.col(value) >= least)).drop("__a", "__b")
    far = F.when(F.col(at) - F.lag(at).over(w) <= distance, 0).otherwise(1)
    tops = tops.withColumn("__f", far).withColumn("__g", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lists = tops.groupBy(*keys, "__g").agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("d"), F.col(at).cast("long").alias("p")))).alias("c"))
    kept = F.aggregate("c", F.expr("cast(array() as array<struct<d:double,p:bigint>>)"), lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["p"] - x["p"]) <= distance), acc).otherwise(F.array_append(acc, x)))
    return lists.select(*keys, F.explode(kept).alias("x")).select(*keys, F.col("x.p").alias(at), (-F.col("x.d")).alias(value))
