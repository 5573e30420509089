"""Interval, frame, song and signal views over the input tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.session import table

#: Microseconds of 2024-01-01 UTC, from which recordings count their seconds.
EPOCH_US = 1_704_067_200_000_000
#: Seconds of a frame of the raster views.
STEP = 600.0

TRUTH_SQL = f"""truth AS (SELECT user_id AS recording_id, event_id, event_type AS name, (epoch_us(ts) - {EPOCH_US}) / 1e6::DOUBLE AS start_s,
  (epoch_us(ts) - {EPOCH_US}) / 1e6::DOUBLE + value * 300::DOUBLE AS stop_s FROM events)"""
PRED_SQL = """pred AS (SELECT recording_id, event_id, CASE WHEN event_id % 13 = 0 THEN 'click' ELSE name END AS name,
  start_s + ((event_id % 7) - 3) * 1e-1::DOUBLE * (stop_s - start_s) AS start_s, stop_s + ((event_id % 7) - 3) * 1e-1::DOUBLE * (stop_s - start_s) AS stop_s
  FROM truth WHERE event_id % 11 <> 0)"""
FRAMES_SQL = """frames AS (SELECT DISTINCT recording_id, name, unnest(range(floor(start_s / 600)::BIGINT, floor(stop_s / 600)::BIGINT + 1)) AS frame FROM truth)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled intervals of their users' recordings."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), "event_id", F.col("event_type").alias("name"), start.alias("start_s"), (start + F.col("value") * 300.0).alias("stop_s"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same intervals as an imperfect detector sees them."""
    move = ((F.col("event_id") % 7) - 3) * 0.1 * (F.col("stop_s") - F.col("start_s"))
    name = F.when(F.col("event_id") % 13 == 0, "click").otherwise(F.col("name"))
    return truth(spark, sf_dir).where("event_id % 11 <> 0").select("recording_id", "event_id", name.alias("name"), (F.col("start_s") + move).alias("start_s"), (F.col("stop_s") + move).alias("stop_s"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of STEP seconds touched by each label."""
    lo, hi = F.floor(F.col("start_s") / STEP).cast("long"), F.floor(F.col("stop_s") / STEP).cast("long")
    return truth(spark, sf_dir).select("recording_id", "name", F.explode(F.sequence(lo, hi)).alias("frame")).distinct()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a label sequence."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("name"))


def samples(spark: SparkSession, sf_dir: str, below: int | None = None) -> DataFrame:
    """(recording_id, n, x): embedding vectors as signals of 64 samples."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), F.posexplode("embedding").alias("n", "x"))
    return rows.select("recording_id", F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"))


SAMPLES_SQL = "samples AS (SELECT vec_id AS recording_id, unnest(range(len(embedding))) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings)"
