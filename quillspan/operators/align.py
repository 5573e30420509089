"""Labels for detected segments from manual annotations, by a cascade of rules.

Manual intervals of a recording that can matter to a segment are its overlaps, and for the
tolerance rules those with both or one boundary near; all lie within `tolerance` of the segment or
overlap it, so one bucketed join brings them together and no recording is collected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.intervals import EPS, KEY

#: Boundary tolerance, least overlap in seconds, least share of the manual interval.
TOLERANCE, LEAST_OVERLAP, LEAST_SHARE = 0.2, 0.02, 0.12


def _tail(segment: Column, best: Column, manuals: Column, tolerance: float) -> Column:
    """Names of manuals after `best` that end within the segment or stick out of its end."""
    ts, te = segment["start_s"], segment["stop_s"]
    begin = F.struct(F.array().cast("array<string>").alias("names"), F.lit(False).alias("done"))

    def step(acc: Column, m: Column) -> Column:
        later = (m["start_s"] > best["start_s"]) | ((m["start_s"] == best["start_s"]) & (m["ord"] > best["ord"]))
        over = F.least(te, m["stop_s"]) - F.greatest(ts, m["start_s"], best["stop_s"] - tolerance)
        inside = m["stop_s"] <= te + tolerance
        across = (m["start_s"] < te) & (te < m["stop_s"])
        ended = acc["done"] | (m["start_s"] >= te - EPS)
        grown = F.array_append(acc["names"], m["name"])
        return (
            F.when(acc["done"] | ~later, acc)
            .when(ended, F.struct(acc["names"].alias("names"), F.lit(True).alias("done")))
            .when(over <= 0, acc)
            .when(inside, F.struct(grown.alias("names"), F.lit(False).alias("done")))
            .when(across, F.struct(grown.alias("names"), F.lit(True).alias("done")))
            .otherwise(F.struct(acc["names"].alias("names"), F.lit(True).alias("done")))
        )

    names = F.aggregate(manuals, begin, step)["names"]
    return F.when(F.size(names) == 1, F.concat(F.lit("less "), names[0])).when(F.size(names) > 1, F.concat(F.lit("miss "), F.array_join(names, " "))).otherwise(F.lit(""))


def align_labels(segments: DataFrame, manuals: DataFrame, tolerance: float = TOLERANCE, least: float = LEAST_OVERLAP, share: float = LEAST_SHARE, width: float = 86400.0) -> DataFrame:
    """(recording_id, unit_id, start_s, stop_s, label, remark, rule) for each segment.

    Rules in order: two or more significant overlaps; both boundaries near; start near; any overlap
    (touching counts); none. Names are compared trimmed and in lower case; ties go to the earlier
    start, then to the smaller `ord` of the manual.
    """
    low, high = F.floor((F.col("start_s") - tolerance) / width).cast("long"), F.floor((F.col("stop_s") + tolerance) / width).cast("long")
    m = manuals.select(KEY, F.lower(F.trim("name")).alias("name"), "start_s", "stop_s", "ord").withColumn("bucket", F.explode(F.sequence(low, high)))
    s = segments.select(KEY, "unit_id", "start_s", "stop_s").withColumn("bucket", F.explode(F.sequence(low, high)))
    near = (F.col("m.start_s") <= F.col("s.stop_s") + tolerance + EPS) & (F.col("m.stop_s") >= F.col("s.start_s") - tolerance - EPS)
    joined = s.alias("s").join(m.alias("m"), (F.col(f"s.{KEY}") == F.col(f"m.{KEY}")) & (F.col("s.bucket") == F.col("m.bucket")) & near)
    item = F.struct(F.col("m.start_s").alias("start_s"), F.col("m.ord").alias("ord"), F.col("m.stop_s").alias("stop_s"), F.col("m.name").alias("name"))
    found = joined.groupBy(F.col(f"s.{KEY}").alias(KEY), F.col("s.unit_id").alias("unit_id")).agg(F.array_sort(F.collect_set(item)).alias("ms"))
    rows = segments.select(KEY, "unit_id", "start_s", "stop_s").join(found, [KEY, "unit_id"], "left").withColumn("ms", F.coalesce("ms", F.expr("cast(array() as array<struct<start_s:double,ord:bigint,stop_s:double,name:string>>)")))
    seg = F.struct("start_s", "stop_s")
    over = lambda x: F.least(F.col("stop_s"), x["stop_s"]) - F.greatest(F.col("start_s"), x["start_s"])
    strong = F.filter("ms", lambda x: (over(x) >= least) & (over(x) >= share * (x["stop_s"] - x["start_s"])))
    touch = F.filter("ms", lambda x: over(x) > -EPS)
    gap = lambda x: F.greatest(F.abs(x["start_s"] - F.col("start_s")), F.abs(x["stop_s"] - F.col("stop_s")))
    best = lambda f: F.array_min(F.transform("ms", lambda x: F.struct(f(x).alias("d"), x["start_s"].alias("start_s"), x["ord"].alias("ord"), x["stop_s"].alias("stop_s"), x["name"].alias("name"))))
    rows = rows.withColumns({"strong": strong, "touch": touch, "by_both": best(gap), "by_start": best(lambda x: F.abs(x["start_s"] - F.col("start_s")))})
    rest = lambda c: F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x: x["name"])
    rule = (
        F.when(F.size("strong") >= 2, "merged").when(F.col("by_both.d") <= tolerance, "both").when(F.col("by_start.d") <= tolerance, "start").when(F.size("touch") > 0, "overlap").otherwise("none")
    )
    rows = rows.withColumn("rule", rule)
    some = lambda names: F.when(F.size(names) == 1, F.concat(F.lit("less "), names[0])).otherwise(F.concat(F.lit("miss "), F.array_join(names, " ")))
    label = F.when(F.col("rule") == "merged", F.col("strong")[0]["name"]).when(F.col("rule") == "both", F.col("by_both.name")).when(F.col("rule") == "start", F.col("by_start.name")).when(F.col("rule") == "overlap", F.col("touch")[0]["name"]).otherwise("")
    remark = (
        F.when(F.col("rule") == "merged", F.concat(F.lit("miss "), F.array_join(rest(F.col("strong")), " ")))
        .when(F.col("rule") == "both", _tail(seg, F.col("by_both"), F.col("ms"), tolerance))
        .when(F.col("rule") == "start", _tail(seg, F.col("by_start"), F.col("ms"), tolerance))
        .when((F.col("rule") == "overlap") & (F.size("touch") > 1), some(rest(F.col("touch"))))
        .when(F.col("rule") == "overlap", _tail(seg, F.col("touch")[0], F.col("ms"), tolerance))
        .otherwise("")
    )
    return rows.select(KEY, "unit_id", "start_s", "stop_s", label.alias("label"), remark.alias("remark"), "rule")


def missed_in(remark: Column) -> Column:
    """Names listed in a remark."""
    r = F.trim(remark)
    return F.when(r.startswith("miss ") | r.startswith("less "), F.size(F.split(F.trim(F.substring(r, 6, 10_000_000)), r"\s+"))).otherwise(0).cast("long")


def alignment_stats(aligned: DataFrame, manuals: DataFrame, orphans: DataFrame, empty_overlaps: DataFrame) -> DataFrame:
    """Missed syllables per recording and in total (recording_id null): counts and their ratio."""
    part = lambda df, value, name: df.select(KEY, F.lit(name).alias("what"), value.cast("long").alias("n"))
    one = F.lit(1)
    parts = part(manuals, one, "manual").union(part(aligned, missed_in(F.col("remark")), "remark")).union(part(empty_overlaps, one, "empty")).union(part(orphans, one, "orphan"))
    count = lambda w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(f"n_{w}")
    out = parts.rollup(KEY).agg(*(count(w) for w in ("manual", "remark", "empty", "orphan")))
    total = F.col("n_remark") + F.col("n_empty") + F.col("n_orphan")
    return out.withColumn("n_missed", total).withColumn("ratio", F.round(F.when(F.col("n_manual") > 0, total / F.col("n_manual")).otherwise(0.0), 6))
