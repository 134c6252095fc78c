"""Timelines: samples of tracks in order, cut at keyframes, joined, measured and framed.

A sample table has ``track, ord, ts, keyframe`` and any payload columns. All operators are windows
over one track or aggregations; nothing needs a whole track in one place but the sort of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.prefix import numbered
from weftline.operators.selection import median
from weftline.session import table


def trim(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Samples of ``[start, end)``; a track's start snaps back to the last keyframe at or before its first sample there.

    Positions stay those of the source. The end is a filter, since order need not ascend in time.
    A track without such a keyframe starts at the cut; one that ends before the start gives nothing.
    """
    track = W.partitionBy("track")
    cut = F.min(F.when(F.col("ts") >= start, F.col("ord"))).over(track)
    marked = samples.withColumn("cut", cut)
    begin = F.coalesce(F.max(F.when(F.col("keyframe") & (F.col("ord") <= F.col("cut")), F.col("ord"))).over(track), F.col("cut"))
    kept = marked.withColumn("begin", begin).where((F.col("ord") >= F.col("begin")) & (F.col("ts") < end))
    return kept.drop("cut", "begin")


def deltas(samples: DataFrame) -> DataFrame:
    return samples.withColumn("delta", F.col("ts") - F.lag("ts").over(W.partitionBy("track").orderBy("ord"))).where("delta IS NOT NULL")


def cadence(samples: DataFrame) -> int | None:
    """The upper median of all gaps between neighbours, pooled over tracks, by counts per range."""
    return median(deltas(samples), "delta")


class Refused(ValueError):
    """An edit that would give an empty or mixed timeline."""


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """``second`` after ``first``: one shift for all tracks, a cadence past the end, at least one tick.

    Both have the same tracks, as positions in ``second`` carry on from those of ``first``.
    """
    ends = first.groupBy("track").agg(F.max("ord").alias("base"), F.max_by("ts", "ord").alias("ts"))
    last = ends.agg(F.max("ts")).first()[0] or 0
    shift = last + max(cadence(first) or 0, 1)
    moved = second.join(ends.select("track", "base"), "track", "left").withColumn("ts", F.col("ts") + F.lit(shift)).withColumn("ord", F.col("ord") + F.coalesce(F.col("base"), F.lit(0)))
    return first.withColumn("part", F.lit(1)).unionByName(moved.select(*first.columns).withColumn("part", F.lit(2)))


def refusals(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, why`` of pairs of files: why they cannot be joined on one timeline, or null.

    ``tracks``: ``file, position, scale_ns, kind, codec, private, width, height``. Files need as many
    tracks as each other, then one clock, then each pair of tracks the same kind and codec, then the same
    settings and dimensions, as the output carries those of ``a`` only.
    """
    clock = tracks.groupBy("file").agg(F.count("*").alias("n"), F.min("scale_ns").alias("scale_ns"))
    files = pairs.join(clock.select(F.col("file").alias("a"), F.col("n").alias("a_n"), F.col("scale_ns").alias("a_scale")), "a", "left").join(clock.select(F.col("file").alias("b"), F.col("n").alias("b_n"), F.col("scale_ns").alias("b_scale")), "b", "left")
    side = lambda p: tracks.select(F.col("file").alias(p), "position", F.struct("kind", "codec").alias(f"{p}_codec"), F.struct("private", "width", "height").alias(f"{p}_config"))
    differs = pairs.distinct().join(side("a"), "a").join(side("b"), ["b", "position"]).groupBy("a", "b").agg(F.bool_or(~F.col("a_codec").eqNullSafe(F.col("b_codec"))).alias("codec"), F.bool_or(~F.col("a_config").eqNullSafe(F.col("b_config"))).alias("config"))
    why = F.when(F.coalesce("a_n", F.lit(0)) != F.coalesce("b_n", F.lit(0)), "track layouts differ").when(~F.col("a_scale").eqNullSafe(F.col("b_scale")), "timecode scales differ")
    return files.join(differs, ["a", "b"], "left").select("a", "b", why.when(F.col("codec"), "codec sets differ").when(F.col("config"), "codec configurations differ").alias("why"))


def ms_to_ticks(ms: Column, scale_ns: Column) -> Column:
    """Milliseconds in ticks of ``scale_ns``, rounded down; a scale of 0 counts as 1, what is too large as the largest."""
    # In whole numbers: a decimal quotient is rounded to six places, and so up to the next tick where it is that close.
    ms, scale = ms.cast("long"), F.greatest(scale_ns, F.lit(1)).cast("long")
    rest = F.pmod(ms, scale)
    whole = F.call_function("div", ms - rest, scale).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    exact = whole + F.call_function("div", rest * 1_000_000, scale)
    return F.least(exact, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def trimmed(samples: DataFrame, start: int, end: int) -> DataFrame:
    """``trim``, refused where nothing would be left of any track."""
    found = trim(samples, start, end)
    if found.isEmpty():
        raise Refused(f"this window selects no samples: {start} to {end}")
    return found


def peaks(frames: DataFrame, buckets: int = 96) -> DataFrame:
    """``track, frame, v`` (frames from 0, any channels) to ``track, bucket, peak``, peaks from 0 to 255.

    Bucket b holds frames from b*F/B to the larger of (b+1)*F/B and its start plus one, in whole
    numbers. A frame finds its buckets by that rule, so no range join is needed.
    """
    lengths = frames.groupBy(F.col("track").alias("of")).agg((F.max("frame") + 1).alias("n"))
    loudest = frames.groupBy("track", "frame").agg(F.max(F.abs("v")).alias("v"))
    by_frame = loudest.join(lengths, F.col("track").eqNullSafe(F.col("of"))).drop("of")
    low = F.expr(f"CAST(floor((frame * {buckets}L) / n) AS BIGINT)")
    high = F.expr(f"least({buckets - 1}L, CAST(floor(((frame + 1) * {buckets}L - 1) / n) AS BIGINT))")
    spread = by_frame.withColumn("bucket", F.explode(F.sequence(low, high)))
    held = "frame >= (bucket * n) div {0} AND frame < greatest(((bucket + 1) * n) div {0}, (bucket * n) div {0} + 1)".format(buckets)
    return spread.where(held).groupBy("track", "bucket").agg(F.round(F.least(F.greatest(F.max("v"), F.lit(0.0)), F.lit(1.0)) * 255).cast("int").alias("peak"))


def frames_of(values: DataFrame, size: int, hop: int) -> DataFrame:
    """``id, xs`` (array) to ``id, frame, window``: every full window of ``size`` values, ``hop`` apart."""
    starts = F.when(F.size("xs") >= size, F.sequence(F.lit(1), F.size("xs") - size + 1, F.lit(hop)))
    return values.select("id", "xs", F.posexplode(starts).alias("frame", "start")).select("id", "frame", F.slice("xs", F.col("start"), size).alias("window"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("track"), F.row_number().over(order).alias("ord"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000").alias("ts"), (F.col("event_type") == "purchase").alias("keyframe"), "event_id")


_SAMPLES = "SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, (epoch_us(ts) / 1000)::BIGINT AS ts, event_type = 'purchase' AS keyframe, event_id FROM events"
#: The same as above, rounding down as the cast in Spark does.
_SAMPLES = _SAMPLES.replace("(epoch_us(ts) / 1000)::BIGINT", "epoch_us(ts) // 1000")


def concat_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tracks of files of three, some with a track missing; neighbouring files are to be joined."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 17 <> 0")
    tracks = c.select(
        F.floor(F.col("c_custkey") / 3).alias("file"), (F.col("c_custkey") % 3).alias("position"), F.when(F.floor(F.col("c_custkey") / 3) % 13 == 0, 1000).otherwise(1_000_000).alias("scale_ns"),
        F.when(F.col("c_custkey") % 3 == 0, "video").otherwise("audio").alias("kind"), F.when(F.col("c_nationkey") < 22, "x").otherwise("y").alias("codec"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None).cast("string")).otherwise("p").alias("private"), F.lit(640).alias("width"), F.when(F.col("c_acctbal") < 0, 360).otherwise(480).alias("height"),
    )
    files = tracks.select(F.col("file").alias("a")).distinct()
    return refusals(tracks, files.select("a", (F.col("a") + 1).alias("b"))).select("a", "b", "why")


def tick_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times in ticks of several clocks."""
    ms, scale = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000"), F.element_at(F.array(*map(F.lit, (0, 1, 100, 1_000_000, 41_666_667))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", ms_to_ticks(ms * 1000, scale).alias("ticks"))


def _bounds(samples: DataFrame) -> tuple[int, int]:
    first, last = samples.agg(F.min("ts"), F.max("ts")).first()  # one row
    if first is None:
        return 0, 0
    return first + (last - first) // 3, first + 2 * (last - first) // 3


def trim_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle third of every user's events, from a purchase on."""
    samples = _samples(spark, sf_dir)
    return trim(samples, *_bounds(samples)).select("track", "ord", "ts", "event_id")


def concat_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of all tracks' events, then the second half, on one timeline."""
    samples = _samples(spark, sf_dir)
    middle = F.col("ord") % 2 == 1
    halves = [samples.where(c).withColumn("ord", F.row_number().over(W.partitionBy("track").orderBy("ord"))) for c in (middle, ~middle)]
    return concat(*halves).select("track", "ord", "ts", "part", "event_id")


def cadence_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(_samples(spark, sf_dir)).groupBy("track").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY delta DESC)").alias("upper"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY delta)").alias("lower"))


def peaks_96(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    values = numbered(events, "event_type", "event_id").select(F.col("event_type").alias("track"), F.col("nth").alias("frame"), (F.coalesce("value", F.lit(0.0)) / 500).alias("v"))
    return peaks(values)


def chunk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 16 values, 8 apart, over each embedding, with their energy."""
    values = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("xs"))
    energy = F.aggregate("window", F.lit(0.0), lambda a, x: a + x * x)
    return frames_of(values, 16, 8).select("id", "frame", F.round(energy, 6).alias("energy"))


def track_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of track only: the samples of each user's purchases, numbered anew."""
    kept = _samples(spark, sf_dir).where("keyframe")
    return kept.select("track", F.row_number().over(W.partitionBy("track").orderBy("ord")).alias("ord"), "ts")


QUERIES = {"trim_keyframe": trim_keyframe, "concat_shift": concat_shift, "cadence_median": cadence_median, "peaks_96": peaks_96, "chunk_frames": chunk_frames, "track_filter": track_filter, "concat_refusals": concat_refusals, "tick_times": tick_times}
ORACLES = {
    "trim_keyframe": f"""
WITH s AS ({_SAMPLES}), b AS (SELECT min(ts) + (max(ts) - min(ts)) // 3 AS lo, min(ts) + 2 * (max(ts) - min(ts)) // 3 AS hi FROM s),
c AS (SELECT s.*, lo, hi, min(CASE WHEN ts >= lo THEN ord END) OVER (PARTITION BY track) AS cut FROM s, b),
g AS (SELECT *, coalesce(max(CASE WHEN keyframe AND ord <= cut THEN ord END) OVER (PARTITION BY track), cut) AS bgn FROM c)
SELECT track, ord, ts, event_id FROM g WHERE cut IS NOT NULL AND ord >= bgn AND ts < hi""",
    "concat_shift": f"""
WITH s AS ({_SAMPLES}),
a AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY ord) AS ord, ts, event_id FROM s WHERE ord % 2 = 1),
b AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY ord) AS ord, ts, event_id FROM s WHERE ord % 2 = 0),
d AS (SELECT ts - lag(ts) OVER (PARTITION BY track ORDER BY ord) AS delta FROM a),
m AS (SELECT quantile_disc(delta, 0.5 ORDER BY delta DESC) AS cadence FROM d WHERE delta IS NOT NULL),
l AS (SELECT max(ts) AS last FROM (SELECT track, arg_max(ts, ord) AS ts FROM a GROUP BY track)),
x AS (SELECT greatest(last + coalesce(cadence, 0), last + 1) AS shift FROM l, m),
n AS (SELECT track, max(ord) AS base FROM a GROUP BY track)
SELECT track, ord, ts, 1 AS part, event_id FROM a UNION ALL
SELECT b.track, b.ord + coalesce(base, 0), b.ts + shift, 2, b.event_id FROM b CROSS JOIN x LEFT JOIN n ON n.track = b.track""",
    "cadence_median": f"""
WITH s AS ({_SAMPLES}), d AS (SELECT track, ts - lag(ts) OVER (PARTITION BY track ORDER BY ord) AS delta FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY delta) AS rn, count(*) OVER (PARTITION BY track) AS n FROM d WHERE delta IS NOT NULL)
SELECT track, max(CASE WHEN rn = n // 2 + 1 THEN delta END) AS upper, max(CASE WHEN rn = (n + 1) // 2 THEN delta END) AS lower FROM r GROUP BY track""",
    "peaks_96": """
WITH f AS (SELECT event_type AS track, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame, coalesce(value, 0.0) / 500 AS v FROM events),
n AS (SELECT track, count(*) AS n FROM f GROUP BY track), b AS (SELECT track, n, unnest(range(96)) AS bucket FROM n),
r AS (SELECT track, bucket, bucket * n // 96 AS lo, least(greatest((bucket + 1) * n // 96, bucket * n // 96 + 1), n) AS hi FROM b)
SELECT r.track, bucket, round(least(greatest(max(abs(v)), 0.0), 1.0) * 255)::INTEGER AS peak FROM r JOIN f ON f.track = r.track AND frame >= lo AND frame < hi GROUP BY r.track, bucket""",
    "chunk_frames": """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS xs FROM embeddings), w AS (SELECT id, xs, unnest(range(0, len(xs) - 15, 8)) AS pos FROM e)
SELECT id, (pos // 8)::INTEGER AS frame, round(list_sum(list_transform(xs[pos + 1 : pos + 16], lambda x: x * x)), 6) AS energy FROM w""",
    "track_filter": f"SELECT track, row_number() OVER (PARTITION BY track ORDER BY ord)::INTEGER AS ord, ts FROM ({_SAMPLES}) WHERE keyframe",
    "concat_refusals": """
WITH t AS (SELECT c_custkey // 3 AS file, c_custkey % 3 AS position, CASE WHEN c_custkey // 3 % 13 = 0 THEN 1000 ELSE 1000000 END AS scale, (c_custkey % 3 = 0, c_nationkey < 22) AS codec, (c_mktsegment = 'BUILDING', c_acctbal < 0) AS config FROM customer WHERE c_custkey % 17 <> 0),
f AS (SELECT file, count(*) AS n, min(scale) AS scale FROM t GROUP BY file),
d AS (SELECT x.file AS a, bool_or(x.codec <> y.codec) AS codec, bool_or(x.config <> y.config) AS config FROM t x JOIN t y ON y.file = x.file + 1 AND y.position = x.position GROUP BY x.file)
SELECT f.file AS a, f.file + 1 AS b, CASE WHEN f.n <> coalesce(g.n, 0) THEN 'track layouts differ' WHEN f.scale <> g.scale THEN 'timecode scales differ' WHEN codec THEN 'codec sets differ' WHEN config THEN 'codec configurations differ' END AS why
FROM f LEFT JOIN f g ON g.file = f.file + 1 LEFT JOIN d ON d.a = f.file""",
    "tick_times": "SELECT event_id, least(((epoch_us(ts) // 1000)::HUGEINT * 1000 * 1000000) // greatest([0, 1, 100, 1000000, 41666667][event_id % 5 + 1], 1), 9223372036854775807)::BIGINT AS ticks FROM events",
}
