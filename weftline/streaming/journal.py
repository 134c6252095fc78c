"""Streams: journals followed as files arrive, and event-time windows (Spark-native extras).

The journal stream drops torn lines and repeated content ids within the watermark; ``follow`` writes
each batch once, keyed by its number, so a restarted stream does not double its output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from weftline.operators.provenance import JOURNAL
from weftline.session import table


def journal_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Journal lines as files arrive; torn lines are dropped."""
    lines = spark.readStream.schema(JOURNAL + ", at timestamp, _corrupt_record string").option("mode", "PERMISSIVE").json(folder)
    return lines.where("_corrupt_record IS NULL").drop("_corrupt_record")


def once(entries: DataFrame, key: str = "content_id", late: str = "1 hour") -> DataFrame:
    return entries.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def follow(entries: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and tumbling window; the same call serves streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def resampled_stream(packets: DataFrame, source: int, target: int, channels: int = 1) -> DataFrame:
    """``track, ord, interleaved`` as packets arrive to ``track, k, v`` at the target rate.

    State is the number of frames so far, the last of them and the number of packets, so that a value
    between two packets has both neighbours, and any cut of a track into packets gives the values of
    ``signal.resampled_tracks`` over the whole. Packets of a track are numbered from 0; within a batch
    they may come in any order, a gap is an error. A packet without a whole frame adds nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, last, expected = state.get if state.exists else (0, 0.0, 0)
        for ord_, interleaved in sorted((row for batch in batches for row in zip(batch["ord"], batch["interleaved"], strict=True)), key=lambda row: row[0]):
            if ord_ != expected:
                raise ValueError(f"track {key[0]}: packet {expected} is missing before {ord_}")
            expected += 1
            values = np.asarray([] if interleaved is None else interleaved, float)
            fresh = values[: len(values) // channels * channels].reshape(-1, channels).sum(1) / channels
            if not len(fresh):
                continue
            # Values up to the one before the last frame were given out already.
            first = (frames - 1) * target // source + 1 if frames else 0
            known = np.append([last], fresh) if frames else fresh
            base = frames - (1 if frames else 0)
            frames, last = frames + len(fresh), float(fresh[-1])
            k = np.arange(first, (frames - 1) * target // source + 1)
            at, part = k * source // target - base, (k * source % target) / target
            here, then = known[at], known[np.minimum(at + 1, len(known) - 1)]
            yield pd.DataFrame({"track": key[0], "k": k, "v": np.where(part == 0, here, here + (then - here) * part)})
        state.update((frames, last, expected))

    return packets.groupBy("track").applyInPandasWithState(step, "track long, k long, v double", "frames long, last double, packets long", "append", GroupStateTimeout.NoTimeout)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(_events(spark, sf_dir)).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _events(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(_events(spark, sf_dir)).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


QUERIES = {"event_windows": event_windows, "event_sliding": event_sliding, "event_sessions": event_sessions}
ORACLES = {
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(coalesce(value, 0.0)), 4) AS total FROM events GROUP BY 1, 2",
    "event_sliding": "SELECT strftime(date_trunc('hour', ts) - to_hours(h), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(h) GROUP BY 1, 2",
    "event_sessions": """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
