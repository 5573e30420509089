"""Operators on interval tables (recording_id, name, start_s, stop_s, ...).

Every join has an equality on the recording and, where recordings may be long, on a time bucket,
so plans are hash or merge joins and a long recording is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording_id"
EPS = 1e-9


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two spans; 0 where they only touch or miss."""
    inter = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(inter > 0, inter / (F.greatest(e1, e2) - F.least(s1, s2))).otherwise(F.lit(0.0))


def _bucketed(df: DataFrame, width: float, slack: float) -> DataFrame:
    low, high = F.floor((F.col("start_s") - slack) / width), F.floor((F.col("stop_s") + slack) / width)
    return df.withColumn("bucket", F.explode(F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))))


def overlap_join(left: DataFrame, right: DataFrame, width: float = 86400.0, least: float = EPS, how: str = "inner", on: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Pairs of overlapping intervals, columns prefixed l_ and r_, with `overlap_s`.

    Each interval is put into the time buckets it touches; a pair is kept in the bucket where its
    overlap begins, so it comes once. how="left_anti" gives the left rows without a partner.
    """
    if how == "left_anti":
        keyed = left.withColumn("__id", F.monotonically_increasing_id())
        hit = overlap_join(keyed.select("__id", *left.columns), right, width, least, "inner", on).select(F.col("l___id").alias("__id")).distinct()
        return keyed.join(hit, "__id", "left_anti").drop("__id")
    a = _bucketed(left, width, 0).select(*(F.col(c).alias(f"l_{c}") for c in [*left.columns, "bucket"]))
    b = _bucketed(right, width, 0).select(*(F.col(c).alias(f"r_{c}") for c in [*right.columns, "bucket"]))
    begin = F.greatest("l_start_s", "r_start_s")
    inter = F.least("l_stop_s", "r_stop_s") - begin
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"l_{c}") == F.col(f"r_{c}"))
    both = a.join(b, same & (F.col("l_bucket") == F.col("r_bucket")) & (inter > least) & (F.floor(begin / width) == F.col("l_bucket")))
    return both.withColumn("overlap_s", inter).drop("l_bucket", "r_bucket")


def iou_pairs(truth: DataFrame, pred: DataFrame, least: float = 0.25, on: tuple[str, ...] = (KEY, "name"), width: float = 86400.0) -> DataFrame:
    """(on..., i, j, iou) of overlapping pairs with an IoU of at least `least`; i and j are the rows' `event_id`.

    Candidates come from the bucketed join, so a long recording is spread over tasks.
    """
    cols = [*on, "event_id", "start_s", "stop_s"]
    both = overlap_join(truth.select(*cols), pred.select(*cols), width, 0.0, on=on)
    value = iou(F.col("l_start_s"), F.col("l_stop_s"), F.col("r_start_s"), F.col("r_stop_s"))
    out = both.select(*(F.col(f"l_{c}").alias(c) for c in on), F.col("l_event_id").alias("i"), F.col("r_event_id").alias("j"), value.alias("iou"))
    return out.where(F.col("iou") >= least)


def greedy_match(pairs: DataFrame, keys: list[str], rounds: int = 3) -> DataFrame:
    """One-to-one matches (keys, i, j, iou), best IoU first, ties by i then j.

    A pair that is the best of all pairs of its i and of its j is what the greedy order takes, too:
    such pairs are matched in `rounds` rounds of windows over single intervals, which settles all
    but long chains of preferences. What is left is folded in order per key.
    """
    a, b = Window.partitionBy(*keys, "i"), Window.partitionBy(*keys, "j")
    best = [F.col("__open").desc(), F.desc("iou"), "i", "j"]
    rows = pairs.select(*keys, "i", "j", "iou").withColumns({"__open": F.lit(True), "__taken": F.lit(False)})
    for _ in range(rounds):  # two shuffles a round: pairs by i, pairs by j
        rows = rows.withColumn("__a", F.row_number().over(a.orderBy(*best))).withColumn("__b", F.row_number().over(b.orderBy(*best)))
        rows = rows.withColumn("__taken", F.col("__taken") | (F.col("__open") & (F.col("__a") == 1) & (F.col("__b") == 1)))
        rows = rows.withColumn("__j", F.max("__taken").over(b)).withColumn("__open", ~F.col("__j") & ~F.max("__taken").over(a))
    done = rows.where("__taken").select(*keys, "i", "j", "iou")
    return done.unionByName(_folded(rows.where("__open").select(*keys, "i", "j", "iou"), keys))


def _folded(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy matches as an ordered fold per key."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("i", "j")}
    ranked = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("d"), "i", "j"))).alias("p"))
    empty = F.expr(f"named_struct('i', cast(array() as array<{kinds['i']}>), 'j', cast(array() as array<{kinds['j']}>), 'd', cast(array() as array<double>))")

    def step(acc: Column, x: Column) -> Column:
        free = ~F.array_contains(acc["i"], x["i"]) & ~F.array_contains(acc["j"], x["j"])
        grown = F.struct(F.array_append(acc["i"], x["i"]).alias("i"), F.array_append(acc["j"], x["j"]).alias("j"), F.array_append(acc["d"], x["d"]).alias("d"))
        return F.when(free, grown).otherwise(acc)

    folded = ranked.select(*keys, F.aggregate("p", empty, step).alias("m"))
    out = folded.select(*keys, F.explode(F.arrays_zip("m.i", "m.j", "m.d")).alias("x"))
    return out.select(*keys, F.col("x.i").alias("i"), F.col("x.j").alias("j"), (-F.col("x.d")).alias("iou"))


def matched(truth: DataFrame, pred: DataFrame, least: float = 0.25, on: tuple[str, ...] = (KEY, "name")) -> DataFrame:
    """(on..., i, j, iou): the greedy one-to-one match of two interval tables.

    With `least` at 0 or below, rows without a partner are matched in order of their ids, with IoU 0.
    """
    keys = list(on)
    out = greedy_match(iou_pairs(truth, pred, least, on), keys)
    if least > 0:
        return out

    def single(side: DataFrame, name: str) -> DataFrame:
        free = side.select(*keys, F.col("event_id").alias(name)).join(out, [*keys, name], "left_anti")
        return free.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(name)))

    return out.unionByName(single(truth, "i").join(single(pred, "j"), [*keys, "__n"]).select(*keys, "i", "j", F.lit(0.0).alias("iou")))


def nearest(left: DataFrame, right: DataFrame, tolerance: float | None = None, rate: float = 1.0, width: float = 86400.0) -> DataFrame:
    """(recording_id, id, t) rows of the left with the nearest right time: `near_id` and `dist`.

    Distances are whole samples of 1 / `rate` seconds, cut off; ties go to the smallest right id.
    `dist` is in seconds. Times are sorted within buckets of `width` seconds, and the last and first
    right times of other buckets come from a table of a row per bucket, so a long recording is
    spread over tasks and no pair is made. Ids at the nearest distance are looked up by sample.
    """
    col, bucket = F.col, F.floor(F.col("t") / width)
    rights = right.groupBy(KEY, "t").agg(F.min("id").alias("id")).withColumn("bucket", bucket)
    lefts = left.select(KEY, col("id"), col("t"), bucket.alias("bucket"))
    empty = F.lit(None).cast("double")
    both = lefts.select(KEY, "bucket", "t", "id", empty.alias("r")).unionByName(rights.select(KEY, "bucket", "t", F.lit(None).cast(left.schema["id"].dataType).alias("id"), col("t").cast("double").alias("r")))
    near = Window.partitionBy(KEY, "bucket").orderBy("t")
    both = both.withColumn("lo", F.max("r").over(near.rangeBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.min("r").over(near.rangeBetween(0, Window.unboundedFollowing)))
    ends = both.groupBy(KEY, "bucket").agg(F.max("r").alias("top"), F.min("r").alias("low"))
    order = Window.partitionBy(KEY).orderBy("bucket")
    ends = ends.select(KEY, "bucket", F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    rows = both.where("r is null").join(ends, [KEY, "bucket"])
    samples = lambda x: F.floor(F.abs(x - col("t")) * rate)
    rows = rows.withColumn("d", F.least(samples(F.coalesce("lo", "before")), samples(F.coalesce("hi", "after")))).where("d is not null")
    if tolerance is not None:
        rows = rows.where(col("d") <= tolerance * rate)
    # right times with this very distance lie less than two samples apart on either side
    place = lambda x: F.floor(x * rate)
    at = F.array_distinct(F.array(*(place(col("t")) + s * col("d") + k for s in (-1, 1) for k in (-1, 0, 1))))
    asked = rows.select(KEY, "id", "t", "d", F.explode(at).alias("__s"))
    found = asked.join(rights.select(KEY, col("t").alias("__t"), col("id").alias("near_id"), place(col("t")).alias("__s")), [KEY, "__s"])
    found = found.where(F.floor(F.abs(col("__t") - col("t")) * rate) == col("d"))
    best = found.groupBy(KEY, "id", "t", "d").agg(F.min("near_id").alias("near_id"))
    return best.select(KEY, "id", "t", "near_id", (col("d") / rate).alias("dist"))


def one_to_one(near: DataFrame) -> DataFrame:
    """Of left rows with the same nearest right row, the closest; ties to the smaller id."""
    w = Window.partitionBy(KEY, "near_id").orderBy("dist", "id")
    return near.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def event_scores(truth: DataFrame, pred: DataFrame, tolerance: float, rate: float = 1.0, digits: int = 6) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of events (recording_id, id, t).

    Hits and false alarms count predictions with a nearest true event of their own, misses true
    events without a nearest prediction of their own. Nothing wrong gives 1, also without events.
    """
    count = lambda df, name: df.agg(F.count("*").alias(name))
    hits = one_to_one(nearest(pred, truth, tolerance, rate))
    found = one_to_one(nearest(truth, pred, tolerance, rate))
    n = count(hits, "tp").join(F.broadcast(count(pred, "np"))).join(F.broadcast(count(truth, "nt"))).join(F.broadcast(count(found, "nf")))  # one row each
    n = n.select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("nf")).alias("fn"))
    share = lambda wrong: F.when(F.col(wrong) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(wrong)))
    n = n.withColumns({"p": share("fp"), "r": share("fn")})
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return n.select("tp", "fp", "fn", F.round("p", digits).alias("precision"), F.round("r", digits).alias("recall"), F.round(f1, digits).alias("f1"))


def in_range(start: float | None, stop: float | None, strict: bool = True) -> Column:
    """Whether an interval lies in [start, stop] wholly (strict) or with one end at least."""
    lo, hi = F.lit(0.0 if start is None else start), F.lit(float("inf") if stop is None else stop)
    a, b = F.col("start_s").between(lo, hi), F.col("stop_s").between(lo, hi)
    return (a & b) if strict else (a | b)


def shifted(df: DataFrame, name: str, by: float) -> DataFrame:
    """Intervals of one name moved in time."""
    hit = F.col("name") == name
    return df.withColumns({c: F.when(hit, F.col(c) + by).otherwise(F.col(c)) for c in ("start_s", "stop_s")})


def isolated_filter(df: DataFrame, least: float, most: float, keys: tuple[str, ...] = (KEY,), at: str = "t", tie: str = "id") -> DataFrame:
    """Drop events whose gaps to both neighbours exceed `most` or one of whose gaps is below `least`.

    The first event of a key always stays.
    """
    w = Window.partitionBy(*keys).orderBy(at, tie)
    before, after = F.col(at) - F.lag(at).over(w), F.lead(at).over(w) - F.col(at)
    rows = df.withColumns({"__b": F.coalesce(before, F.lit(float("inf"))), "__a": F.coalesce(after, F.lit(float("inf"))), "__n": F.row_number().over(w)})
    bad = ((F.col("__b") > most) & (F.col("__a") > most)) | (F.col("__b") < least) | (F.col("__a") < least)
    return rows.where((F.col("__n") == 1) | ~bad).drop("__a", "__b", "__n")


def zip_padded(left: DataFrame, right: DataFrame, order_left: str, order_right: str, value: str, policy: str = "last", constant: str | None = None) -> DataFrame:
    """Positional join per recording of `value` from the right.

    policy: strict (counts must agree, else an error when it runs), last / constant (short right
    sides are padded), truncate (surplus left rows go).
    """
    a = left.withColumn("rn", F.row_number().over(Window.partitionBy(KEY).orderBy(order_left)))
    b = right.select(KEY, value, F.row_number().over(Window.partitionBy(KEY).orderBy(order_right)).alias("rn"))
    if policy == "truncate":
        return a.join(b, [KEY, "rn"])
    whole = Window.partitionBy(KEY)
    b = b.withColumn("__last", F.max_by(value, "rn").over(whole)).withColumn("__n", F.count("*").over(whole))
    tail = b.groupBy(KEY).agg(F.first("__last").alias("__last"), F.first("__n").alias("__n"))
    out = a.join(b.select(KEY, "rn", value), [KEY, "rn"], "left").join(tail, KEY, "left")
    if policy == "strict":
        out = out.withColumn("__own", F.count("*").over(whole))
        checked = F.when(F.col("__own").eqNullSafe(F.col("__n")), F.col(value)).otherwise(F.raise_error(F.lit("feature and label counts differ")).cast(right.schema[value].dataType))
        return out.withColumn(value, checked).drop("__last", "__n", "__own")
    pad = F.col("__last") if policy == "last" else F.lit(constant)
    return out.withColumn(value, F.coalesce(value, pad)).drop("__last", "__n")


def paired(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(core) with the candidate of the best priority; several on the best level give `ambiguous`."""
    both = names.join(candidates, "core", "left")
    w = Window.partitionBy("core")
    best = both.withColumn("__p", F.min("priority").over(w)).where(F.col("priority").isNull() | (F.col("priority") == F.col("__p")))
    return best.groupBy("core").agg(F.min("path").alias("path"), F.min("priority").alias("priority"), (F.count("path") > 1).alias("ambiguous"))


def both_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, state): both, left or right."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    state = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full").select(key, state.alias("state"))
