"""Runs and gaps of labelled events as they arrive, with watermarks and bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window, name, n, mean): windowed counts of (ts, name, value) with late rows dropped after `late`."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "name", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, stop, n): sessions of each key."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def _runs(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Closes a key's run when its label changes; the state is the open run alone."""
    name, start, n = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "name"])
    done = []
    for ts, label in zip(rows["ts"], rows["name"]):
        if label == name:
            n += 1
        else:
            if n:
                done.append((key[0], name, pd.Timestamp(start, unit="us"), n))
            name, start, n = label, ts.value // 1000, 1
    state.update((name, start, n))
    yield pd.DataFrame(done, columns=["key", "name", "start", "n"])


def runs(events: DataFrame) -> DataFrame:
    """(key, name, start, n): closed runs of (key, ts, name) in the order of arrival of micro-batches."""
    return events.groupBy("key").applyInPandasWithState(_runs, "key long, name string, start timestamp, n long", "name string, start long, n long", "append", "NoTimeout")
