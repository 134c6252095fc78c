"""Sequences and signals: decoding, loop cutting, speech windows, resampling, normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.prefix import following, haloed, numbered, recurrence
from weftline.operators.timeline import frames_of
from weftline.session import table

MAX_CYCLE, REPEATS = 16, 3
SPEECH = 0.5


def ctc_collapse(ids: Column, blank: int = 0) -> Column:
    """Greedy decoding: runs collapse first, then blanks go."""
    kept = F.filter(ids, lambda x, i: (i == 0) | (x != F.get(ids, i - 1)))
    return F.filter(kept, lambda x: x != blank)


def loop_start(ids: Column) -> Column:
    """Where a tail of three or more repeats of a unit of 1 to 16 goes on after its first, or null."""
    n = F.size(ids)
    same = lambda c: (n >= c * REPEATS) & (F.slice(ids, F.greatest(F.lit(1), n - c * 2 + 1), F.greatest(F.lit(1), c * 2)) == F.slice(ids, F.greatest(F.lit(1), n - c * 3 + 1), F.greatest(F.lit(1), c * 2)))
    unit = F.get(F.filter(F.sequence(F.lit(1), F.lit(MAX_CYCLE)), same), F.lit(0))
    return n - unit * REPEATS + unit


def cut_loop(ids: Column) -> Column:
    """The sequence with one repeat of a looping tail left."""
    start = loop_start(ids)
    return F.when(start.isNull(), ids).otherwise(F.slice(ids, 1, F.greatest(start, F.lit(0))))


def resample(xs: Column, source: int, target: int) -> Column:
    """Linear interpolation at the target rate."""
    n = F.floor(F.size(xs) * F.lit(target) / F.lit(source)).cast("int")
    at = lambda i: i * F.lit(source) / F.lit(target)
    low = lambda i: F.floor(at(i)).cast("int")
    value = lambda i: F.get(xs, low(i)) * (1 - (at(i) - low(i))) + F.coalesce(F.get(xs, low(i) + 1), F.get(xs, low(i))) * (at(i) - low(i))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<double>"))


def downmix(interleaved: Column, channels: int) -> Column:
    frames = F.sequence(F.lit(0), F.floor(F.size(interleaved) / channels).cast("int") - 1)
    return F.transform(frames, lambda i: F.aggregate(F.slice(interleaved, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x) / channels)


def hann(size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: 0.5 - 0.5 * F.cos(2 * math.pi * i / size))


def reflect_pad(xs: Column, pad: int) -> Column:
    """Edges mirrored without repeating the edge itself."""
    return F.concat(F.reverse(F.slice(xs, 2, pad)), xs, F.reverse(F.slice(xs, F.size(xs) - pad, pad)))


def min_max(xs: Column) -> Column:
    """To whole numbers from 0 to 255; a flat signal is 0."""
    low, high = F.array_min(xs), F.array_max(xs)
    return F.transform(xs, lambda x: F.when(high > low, F.round((x - low) / (high - low) * 255)).otherwise(0.0).cast("int"))


def chunks(samples: DataFrame, size: int = 512, context: int = 64) -> DataFrame:
    """``track, nth, v`` (``nth`` from 0 without gaps) to ``track, chunk, xs``: ``size`` values behind the last ``context`` of the chunk before.

    The first chunk has zeros for context and the last is filled up with zeros. A chunk is a group of
    its own, so no track is gathered or sorted as a whole.
    """
    around = haloed(samples, "nth", size, before=context).withColumn("at", F.col("nth") - F.col("_block") * size + context)
    # The copies behind a track's last sample would begin a chunk without values of its own.
    found = around.groupBy("track", F.col("_block").alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("held"), F.bool_or("_inside").alias("own"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(size + context - 1)), lambda i: F.coalesce(F.try_element_at("held", i.cast("long")), F.lit(0.0)))
    return found.where("own").select("track", "chunk", filled.alias("xs"))


def smoothed(samples: DataFrame, keep: float = 0.99, start: Column | None = None) -> DataFrame:
    """Adds ``mean``, the exponential moving mean of ``v`` over each track, beginning from ``start`` or the first value."""
    return recurrence(samples, "track", "nth", F.col("v"), keep, "mean", start)


def resampled_tracks(samples: DataFrame, source: int, target: int) -> DataFrame:
    """``track, nth, v`` to ``track, k, v`` at the target rate, by linear interpolation.

    Value k lies at ``k * source / target`` and exists if that is not beyond the last sample. Positions are
    whole numbers of ``1 / target``, so no rounding depends on how a track was cut into packets.
    """
    both = following(samples, "track", "nth", "v", "next")
    low, high = F.expr(f"(nth * {target} + {source - 1}) div {source}"), F.expr(f"((nth + 1) * {target} + {source - 1}) div {source} - 1")
    both = both.withColumn("low", low).withColumn("high", high).where("low <= high")
    each = both.withColumn("k", F.explode(F.sequence("low", "high")))
    part = (F.col("k") * source - F.col("nth") * target) / F.lit(float(target))
    value = F.when(part == 0, F.col("v")).otherwise(F.col("v") + (F.col("next") - F.col("v")) * part)
    return each.where((F.col("k") * source == F.col("nth") * target) | F.col("next").isNotNull()).select("track", "k", value.alias("v"))


def samples_of(packets: DataFrame, channels: int) -> DataFrame:
    """``track, ord, interleaved`` to ``track, nth, v``: channels mixed down, frames numbered over the packets of a track."""
    frames = F.when(F.size("interleaved") >= channels, downmix(F.col("interleaved"), channels))
    return numbered(packets.select("track", "ord", F.posexplode(frames).alias("place", "v")), "track", "ord", "place").select("track", "nth", "v")


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(xs, lambda x: F.exp(x - top) / total)


def invert(pixels: Column) -> Column:
    """255 less each colour; pixels are (r, g, b, a) and alpha stays."""
    return F.transform(pixels, lambda p, i: F.when(i % 4 == 3, p).otherwise(255 - p))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order as small numbers."""
    code = F.pmod(F.length("props") + F.col("event_id"), F.lit(4)).cast("int")
    ordered = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", code.alias("code")))).alias("xs"))
    return ordered.select("user_id", F.transform("xs", lambda x: x["code"]).alias("ids"))


_CODES = "SELECT user_id, list(((length(props) + event_id) % 4)::INTEGER ORDER BY event_id) AS ids FROM events GROUP BY user_id"


def ctc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("user_id", F.array_join(ctc_collapse(F.col("ids")).cast("array<string>"), " ").alias("decoded"))


def loop_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of labels with a tail repeated by turns, cut."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 10).cast("int")).alias("xs"))
    unit = F.slice("xs", 1, F.pmod("vec_id", F.lit(20)).cast("int"))
    looped = F.flatten(F.array_repeat(unit, (F.pmod("vec_id", F.lit(5)) + 1).cast("int")))
    return v.select("vec_id", F.size(F.concat("xs", looped)).alias("before"), F.size(cut_loop(F.concat("xs", looped))).alias("after"))


def speech_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten events per user with any value at or over the threshold."""
    order = W.partitionBy("user_id").orderBy("event_id")
    hops = table(spark, sf_dir, "events").select("user_id", ((F.row_number().over(order) - 1) / 10).cast("int").alias("win"), (F.coalesce("value", F.lit(0.0)) >= 100 * SPEECH).alias("loud"))
    return hops.groupBy("user_id", "win").agg(F.bool_or("loud").alias("speech"))


def min_max_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("xs"))
    return v.select("vec_id", F.aggregate(min_max(F.col("xs")), F.lit(0), lambda a, x: a + x).alias("level"), F.round(F.array_max(softmax(F.col("xs"))), 6).alias("top"))


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("xs"))
    out = resample(F.col("xs"), 48, 16)
    return v.select("vec_id", F.size(out).alias("n"), F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type as the samples of a track, in order of id."""
    values = table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), "event_id", F.coalesce("value", F.lit(0.0)).alias("v"))
    return numbered(values, "track", "event_id").drop("event_id")


def track_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 512 with 64 of context: what the context holds, what the whole holds, and each weighted by its place."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    placed = F.aggregate(F.transform("xs", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return chunks(_tracks(spark, sf_dir)).select("track", "chunk", F.round(total(F.slice("xs", 1, 64)), 4).alias("context"), F.round(total(F.col("xs")), 4).alias("total"), F.round(placed, 3).alias("placed"))


def track_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value against the moving mean of its track, which begins at a constant as a level meter's does."""
    found = smoothed(_tracks(spark, sf_dir), 0.99, F.lit(-60.1234567))
    return found.select("track", "nth", F.round("mean", 6).alias("mean"), F.round((F.col("v") - F.col("mean")) / 40, 6).alias("level"))


def track_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks from 44,100 to 16,000 values a second, as amplitudes."""
    return resampled_tracks(_tracks(spark, sf_dir), 44_100, 16_000).select("track", "k", F.round(F.col("v") / 700, 6).alias("v"))


def hann_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings mirrored at their edges, in windows of 16 every 8, weighted by a Hann window."""
    padded = reflect_pad(F.transform("embedding", lambda x: x.cast("double")), 8)
    frames = frames_of(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), padded.alias("xs")), 16, 8)
    weighted = F.zip_with("window", hann(16), lambda x, w: x * w)
    return frames.select("id", "frame", F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 6).alias("level"))


_TRACKS = "SELECT event_type AS track, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS nth, coalesce(value, 0.0) AS v FROM events"
QUERIES = {"ctc_collapse": ctc, "loop_cut": loop_cut, "speech_windows": speech_windows, "min_max_levels": min_max_levels, "resample_linear": resampled, "track_chunks": track_chunks, "track_means": track_means, "track_resampled": track_resampled, "hann_frames": hann_frames}
ORACLES = {
    "ctc_collapse": f"SELECT user_id, array_to_string(list_filter(list_filter(ids, lambda x, i: i = 1 OR x <> ids[i - 1]), lambda x: x <> 0), ' ') AS decoded FROM ({_CODES})",
    "loop_cut": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x * 10)::INTEGER) AS xs FROM embeddings),
s AS (SELECT vec_id, list_concat(xs, flatten(list_transform(range(vec_id % 5 + 1), lambda r: xs[1 : vec_id % 20]))) AS q FROM v),
n AS (SELECT vec_id, q, len(q) AS n, list_filter(range(1, 17), lambda c: len(q) >= c * 3 AND q[len(q) - c * 2 + 1 : len(q)] = q[len(q) - c * 3 + 1 : len(q) - c])[1] AS unit FROM s)
SELECT vec_id, n::INTEGER AS before, (CASE WHEN unit IS NULL THEN n ELSE n - unit * 2 END)::INTEGER AS after FROM n""",
    "speech_windows": "SELECT user_id, win::INTEGER AS win, bool_or(loud) AS speech FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS win, coalesce(value, 0.0) >= 50 AS loud FROM events) GROUP BY 1, 2",
    "min_max_levels": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS xs FROM embeddings)
SELECT vec_id, list_sum(list_transform(xs, lambda x: CASE WHEN list_max(xs) > list_min(xs) THEN round((x - list_min(xs)) / (list_max(xs) - list_min(xs)) * 255)::INTEGER ELSE 0 END))::INTEGER AS level,
  round(1 / list_sum(list_transform(xs, lambda x: exp(x - list_max(xs)))), 6) AS top FROM v""",
    "resample_linear": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS xs FROM embeddings)
SELECT vec_id, (len(xs) // 3)::INTEGER AS n, round(coalesce(list_sum(list_transform(range(len(xs) // 3), lambda i: xs[i * 3 + 1])), 0), 5) AS total FROM v""",
    "track_chunks": f"""
WITH t AS ({_TRACKS}), c AS (SELECT track, unnest(range(max(nth) // 512 + 1)) AS chunk FROM t GROUP BY track)
SELECT c.track, chunk, round(coalesce(sum(v) FILTER (nth < chunk * 512), 0), 4) AS context, round(sum(v), 4) AS total, round(sum(v * (nth - chunk * 512 + 65)), 3) AS placed
FROM c JOIN t ON t.track = c.track AND nth >= chunk * 512 - 64 AND nth < chunk * 512 + 512 GROUP BY c.track, chunk""",
    "track_means": f"""
WITH t AS ({_TRACKS}), m AS (SELECT a.track, a.nth, any_value(a.v) AS v, pow(0.99, a.nth + 1) * -60.1234567 + sum(0.01 * b.v * pow(0.99, a.nth - b.nth)) AS mean FROM t a JOIN t b ON b.track = a.track AND b.nth <= a.nth GROUP BY a.track, a.nth)
SELECT track, nth, round(mean, 6) AS mean, round((v - mean) / 40, 6) AS level FROM m""",
    "track_resampled": f"""
WITH t AS ({_TRACKS}), n AS (SELECT track, unnest(range((max(nth) * 16000) // 44100 + 1)) AS k FROM t GROUP BY track), p AS (SELECT track, k, k * 44100 // 16000 AS i, (k * 44100 % 16000) / 16000.0 AS f FROM n)
SELECT p.track, k, round((a.v + CASE WHEN f = 0 THEN 0 ELSE (b.v - a.v) * f END) / 700, 6) AS v FROM p JOIN t a ON a.track = p.track AND a.nth = i LEFT JOIN t b ON b.track = p.track AND b.nth = i + 1""",
    "hann_frames": """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT id, list_concat(list_reverse(e[2:9]), e, list_reverse(e[len(e) - 8 : len(e) - 1])) AS xs FROM v),
w AS (SELECT id, xs, unnest(range(0, len(xs) - 15, 8)) AS pos FROM p)
SELECT id, (pos // 8)::INTEGER AS frame, round(list_sum(list_transform(range(16), lambda i: xs[pos + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 16)))), 6) AS level FROM w""",
}
