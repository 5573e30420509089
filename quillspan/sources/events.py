"""Edits of an interval table as pure functions: each returns a new DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.intervals import in_range


def from_lists(spark, names: list[str], starts: list[float], stops: list[float]) -> DataFrame:
    """Interval rows from parallel lists."""
    return spark.createDataFrame(list(zip(names, starts, stops)), "name string, start_s double, stop_s double")


def from_predictions(df: DataFrame, events: dict[str, list[float]], segments: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """`df` with events (name -> times) and segments (name -> spans) of a prediction; events have no length."""
    rows = [(n, float(t), float(t)) for n, ts in events.items() for t in ts] + [(n, float(a), float(b)) for n, spans in segments.items() for a, b in spans]
    return df.unionByName(df.sparkSession.createDataFrame(rows, "name string, start_s double, stop_s double"), allowMissingColumns=True)


def from_dataset(df: DataFrame, named: dict[str, str] | None = None) -> DataFrame:
    """(recording_id, name, start_s, stop_s) of a long table of event times (recording_id, event, event_time, value).

    event_time is start_seconds or stop_seconds; a missing stop is the start. `named` recodes names.
    """
    at = lambda kind: F.max(F.when(F.col("event_time") == kind, F.col("value")))
    keys = [c for c in ("recording_id", "name") if c in df.columns]
    out = df.groupBy(*keys, "event").agg(at("start_seconds").alias("start_s"), at("stop_seconds").alias("stop_s"))
    out = out.withColumn("stop_s", F.coalesce("stop_s", "start_s"))
    if named:
        from quillspan.functions.labels import recode

        out = out.withColumn("name", recode(F.col("name"), named))
    return out.drop("event")


def added(df: DataFrame, name: str, start: float, stop: float | None = None) -> DataFrame:
    """With one more interval; without a stop it is an event. Other columns are null."""
    row = df.sparkSession.createDataFrame([(name, float(start), float(start if stop is None else stop))], "name string, start_s double, stop_s double")
    return df.unionByName(row, allowMissingColumns=True)


def without_name(df: DataFrame, name: str) -> DataFrame:
    """Without a name's intervals; rows without a name stay."""
    return df.where(~F.col("name").eqNullSafe(name))


def moved(df: DataFrame, name: str, old: float, new: float) -> DataFrame:
    """The interval of a name that starts at `old` starts at `new`; its length stays."""
    hit = (F.col("name") == name) & (F.col("start_s") == old)
    return df.withColumn("stop_s", F.when(hit, F.col("stop_s") + (new - old)).otherwise(F.col("stop_s"))).withColumn("start_s", F.when(hit, F.lit(float(new))).otherwise(F.col("start_s")))


def deleted_near(df: DataFrame, name: str, at: float, tolerance: float) -> DataFrame:
    """Without the interval of a name that starts nearest to a time, if within the tolerance; ties go together."""
    gap = F.abs(F.col("start_s") - at)
    best = df.where(F.col("name") == name).agg(F.min(gap).alias("__g"))
    hit = (F.col("name") == name) & (gap == F.col("__g")) & (gap <= tolerance)
    return df.join(F.broadcast(best)).where(~F.coalesce(hit, F.lit(False))).drop("__g")


def deleted_range(df: DataFrame, start: float | None, stop: float | None, strict: bool = True) -> DataFrame:
    """Without the intervals in a range."""
    return df.where(~in_range(start, stop, strict))


def categories(df: DataFrame, order: str = "start_s") -> DataFrame:
    """(name, category): event if the first row has no length or no times, else segment."""
    first = F.min_by(F.struct("start_s", "stop_s"), order)
    point = (F.col("f.start_s") == F.col("f.stop_s")) | (F.isnan("f.start_s") & F.isnan("f.stop_s"))
    return df.groupBy("name").agg(first.alias("f")).select("name", F.when(point, "event").otherwise("segment").alias("category"))
