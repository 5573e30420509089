"""From intervals to frames and back: raster, spine, islands, gap filling, votes, probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
SILENCE = "__SIL__"


def raster(df: DataFrame, step: float, frames: Column | None = None) -> DataFrame:
    """(recording_id, name, frame): frames trunc(start/step) .. trunc(stop/step + 1) - 1, once per name.

    `frames` is the number of frames of the recording, where frames are cut off. Rows without a
    name or with a NaN start give none.
    """
    first, after = (F.col("start_s") / step).cast("long"), (F.col("stop_s") / step + 1).cast("long")
    last = after - 1 if frames is None else F.least(after, frames) - 1
    ok = df.where(F.col("name").isNotNull() & ~F.isnan("start_s") & (first <= last))
    return ok.select(KEY, "name", F.explode(F.sequence(first, last)).alias("frame")).distinct()


def spine(tables: list[DataFrame], step: float, most: int = 2_000_000) -> DataFrame:
    """(recording_id, frame) with (frame + 0.5) * step < the last stop of all tables; more than `most` is an error."""
    return spine_lengths(tables, step, most).select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))


def spine_lengths(tables: list[DataFrame], step: float, most: int = 2_000_000) -> DataFrame:
    """(recording_id, n): the number of frames of each recording's spine, where there is one."""
    rows = tables[0].select(KEY, "stop_s")
    for t in tables[1:]:
        rows = rows.union(t.select(KEY, "stop_s"))
    end = rows.groupBy(KEY).agg(F.max("stop_s").alias("t")).withColumn("t", F.when(F.col("t") > 0, F.col("t")).otherwise(1.0))
    n = F.greatest(F.ceil(F.col("t") / step - 0.5), F.lit(0)).cast("long")
    n = F.when(n > most, F.raise_error(F.lit("too many frames")).cast("long")).otherwise(n)
    return end.select(KEY, n.alias("n")).where("n > 0")


def stab(df: DataFrame, step: float, order: str = "event_id") -> DataFrame:
    """(recording_id, frame, name) at frame centres in [start, stop): the latest start wins, then the later row."""
    low = F.ceil(F.col("start_s") / step - 0.5).cast("long")
    high = F.ceil(F.col("stop_s") / step - 0.5).cast("long") - 1
    hit = df.withColumns({"__l": F.greatest(low, F.lit(0)), "__h": high}).where("__l <= __h")
    rows = hit.select(KEY, "name", "start_s", order, F.explode(F.sequence("__l", "__h")).alias("frame"))
    return rows.groupBy(KEY, "frame").agg(F.max_by("name", F.struct("start_s", order)).alias("name"))


def pieces(sides: dict[str, DataFrame], step: float, order: str = "event_id", width: int = 256, most: int = 2_000_000) -> DataFrame:
    """(recording_id, first, n, one column per side): stretches of frames with one label on every side.

    The labels are those of spine() and stab() with SILENCE where no interval is, but no row is a
    frame: the cuts are the ends of intervals and of buckets of `width` frames, and each piece looks
    up the intervals of its bucket.
    """
    end = spine_lengths(list(sides.values()), step, most)
    clipped = None
    for side, df in sides.items():
        low, high = F.greatest(F.ceil(F.col("start_s") / step - 0.5).cast("long"), F.lit(0)), F.ceil(F.col("stop_s") / step - 0.5).cast("long")
        rows = df.select(KEY, F.col("name"), F.struct("start_s", order).alias("__o"), low.alias("__l"), high.alias("__h"), F.lit(side).alias("__side")).where("__l < __h")
        rows = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("__l") / width), F.floor((F.col("__h") - 1) / width))))
        rows = rows.withColumns({"__l": F.greatest("__l", F.col("bucket") * width), "__h": F.least("__h", (F.col("bucket") + 1) * width)})
        clipped = rows if clipped is None else clipped.unionByName(rows)
    starts = end.select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / width))).alias("bucket"), "n")
    cuts = starts.select(KEY, "bucket", (F.col("bucket") * width).alias("first"))
    inner = clipped.select(KEY, "bucket", F.explode(F.array("__l", "__h")).alias("first")).where(F.col("first") < (F.col("bucket") + 1) * width)
    cuts = cuts.unionByName(inner).distinct().join(end, KEY).where("first < n")
    after = F.lead("first").over(Window.partitionBy(KEY, "bucket").orderBy("first"))
    cuts = cuts.select(KEY, "bucket", "first", F.coalesce(after, F.least((F.col("bucket") + 1) * width, "n")).alias("after"))
    c, i = cuts.alias("c"), clipped.alias("i")
    on = (F.col(f"c.{KEY}") == F.col(f"i.{KEY}")) & (F.col("c.bucket") == F.col("i.bucket")) & (F.col("__l") <= F.col("first")) & (F.col("first") < F.col("__h"))
    top = lambda side: F.coalesce(F.max_by("name", F.when(F.col("__side") == side, F.col("__o"))), F.lit(SILENCE)).alias(side)
    out = c.join(i, on, "left").groupBy(F.col(f"c.{KEY}").alias(KEY), "first", "after").agg(*(top(side) for side in sides))
    return out.select(KEY, "first", (F.col("after") - F.col("first")).alias("n"), *sides)


def islands(active: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """(keys, first, last, n): runs of consecutive frames."""
    w = Window.partitionBy(*keys).orderBy(frame)
    return active.withColumn("__g", F.col(frame) - F.row_number().over(w)).groupBy(*keys, "__g").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("n")).drop("__g")


def bridged(runs: DataFrame, keys: list[str], gap: int, equal: bool, edges: DataFrame | None = None) -> DataFrame:
    """Runs merged over gaps shorter than `gap` frames (`equal`: up to it).

    With `edges` (keys, lo, hi: the recording's first and last frame) a run that touches an edge
    takes no part.
    """
    w = Window.partitionBy(*keys).orderBy("first")
    rows = runs if edges is None else runs.join(edges, keys)
    touch = F.lit(False) if edges is None else (F.col("first") <= F.col("lo")) | (F.col("last") >= F.col("hi"))
    rows = rows.withColumn("__t", touch)
    hole = F.col("first") - F.lag("last").over(w) - 1
    near = (hole <= gap) if equal else (hole < gap)
    join = near & ~F.col("__t") & ~F.lag("__t").over(w)
    rows = rows.withColumn("__f", F.when(join, 0).otherwise(1)).withColumn("__g", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__g").withColumn("n", F.col("last") - F.col("first") + 1)


def long_enough(runs: DataFrame, keys: list[str], least: int, edges: DataFrame | None = None) -> DataFrame:
    """Runs of at least `least` frames; with `edges`, runs that touch an edge stay."""
    if edges is None:
        return runs.where(F.col("n") >= least)
    rows = runs.join(edges, keys)
    return rows.where((F.col("n") >= least) | (F.col("first") <= F.col("lo")) | (F.col("last") >= F.col("hi"))).drop("lo", "hi")


def seconds(runs: DataFrame, rate: float, inclusive: bool = True) -> DataFrame:
    """Adds start_s and stop_s; the stop is the last frame's time (inclusive) or the time after it."""
    return runs.withColumns({"start_s": F.col("first") / rate, "stop_s": (F.col("last") + (0 if inclusive else 1)) / rate})


def majority(frames: DataFrame, spans: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """(keys, span_id, name, n): the commonest name of a span's frames [first, max(first + 1, last)); ties to the smaller name.

    Spans and frames meet in buckets of `width` frames, so no recording is joined with itself whole.
    """
    last = F.greatest(F.col("first") + 1, F.col("last"))
    cut = spans.withColumn("last", last).withColumn("__b", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("last") - 1) / width))))
    both = cut.join(frames.withColumn("__b", F.floor(F.col("frame") / width)), [*keys, "__b"]).where("frame >= first and frame < last")
    votes = both.groupBy(*keys, "span_id", "name").agg(F.count("*").alias("n"))
    best = votes.groupBy(*keys, "span_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "name")).alias("b"))
    return best.select(*keys, "span_id", F.col("b.name").alias("name"), (-F.col("b.m")).alias("n"))


def normalised(df: DataFrame, keys: list[str], value: str, classes: int) -> DataFrame:
    """Values over their sum per key; a sum of zero gives 1 / classes."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("p", F.when(total == 0, F.lit(1.0 / classes)).otherwise(F.col(value) / total))


def best_class(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label): the class index of the largest p; ties to the smaller index."""
    return df.groupBy(*keys).agg(F.max_by("idx", F.struct("p", -F.col("idx"))).alias("label"))


def first_above(df: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, label): the smallest class index with p above the threshold, 0 if none."""
    return df.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("p") > threshold, F.col("idx"))), F.lit(0)).alias("label"))


def class_weights(df: DataFrame, name: str = "name") -> DataFrame:
    """(name, weight): the inverse share of each class."""
    n = df.groupBy(name).agg(F.count("*").alias("n"))
    return n.select(name, "n", (F.sum("n").over(Window.partitionBy(F.lit(1))) / F.col("n")).alias("weight"))
