"""Sample tables of movie files: run lengths of times, offsets and chunks become one row per sample.

A movie says how long samples last, how much later they are shown, and how many lie in each chunk, all as
runs. Here runs are rows, placed at the first sample that they hold for by running sums, and put in one
order with the samples; each sample then takes the last row of each kind at or before it. So no run is
expanded and no track is gathered, and a run of any length costs one row.

Tables: ``times`` (``track, run, count, delta``), ``offsets`` (``track, run, count, offset``), ``chunk_runs``
(``track, first, per``: from chunk ``first`` on, counted from 1), ``chunks`` (``track, chunk, at``, from 0),
``sizes`` (``track, nth, size``, from 0), ``syncs`` (``track, nth``, counted from 1) and ``tracks`` (``track, timescale``).

Edges: runs without samples give way to the next; the last duration goes on beyond its run, offsets do
not; samples that no chunk has room for are left out, as are chunks before the first run; a track
without syncs has keyframes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.prefix import filled, numbered, ordered, running_sum, summed
from weftline.session import table


def _starts(runs: DataFrame, order: str, count: str) -> DataFrame:
    """Runs with ``nth``, the number of samples before them."""
    return running_sum(runs, "track", order, F.col(count), "nth").withColumn("nth", F.col("nth") - F.col(count))


def _truncated(ticks: Column, scale: Column) -> Column:
    """Milliseconds, rounded towards 0."""
    return F.signum(ticks).cast("long") * F.floor(F.abs(ticks) * 1000 / scale).cast("long")


def chunk_starts(chunks: DataFrame, chunk_runs: DataFrame) -> DataFrame:
    """``track, chunk, at, per, nth``: each chunk's samples and the first of them."""
    both = chunks.select("track", "chunk", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("per"))
    both = both.unionByName(chunk_runs.select("track", (F.col("first") - 1).alias("chunk"), F.lit(0).alias("kind"), F.col("per").cast("long").alias("per")), allowMissingColumns=True)
    found = filled(ordered(both, "track", "chunk", "kind"), "track", "per").where("kind = 1").select("track", "chunk", "at", F.coalesce("per", F.lit(0)).alias("per"))
    return _starts(found, "chunk", "per")


def sample_table(tracks: DataFrame, times: DataFrame, offsets: DataFrame, chunk_runs: DataFrame, chunks: DataFrame, sizes: DataFrame, syncs: DataFrame) -> DataFrame:
    """``track, nth, ts_ms, offset_ms, at, size, keyframe``."""
    lasting = _starts(times, "run", "count").withColumn("ticks", F.col("count") * F.col("delta"))
    lasting = running_sum(lasting, "track", "run", F.col("ticks"), "until")
    rows = [
        (0, lasting.select("track", "nth", F.col("run").alias("rank"), F.struct(F.col("nth").alias("from"), (F.col("until") - F.col("ticks")).alias("ticks"), "delta").alias("time"))),
        (0, _starts(offsets, "run", "count").select("track", "nth", F.col("run").alias("rank"), F.struct((F.col("nth") + F.col("count")).alias("end"), "offset").alias("shown"))),
        (0, chunk_starts(chunks, chunk_runs).where("per > 0").select("track", "nth", F.col("chunk").alias("rank"), F.struct("at", (F.col("nth") + F.col("per")).alias("end")).alias("place"))),
        (0, syncs.select("track", (F.col("nth") - 1).alias("nth"), F.lit(0).cast("long").alias("rank"), (F.col("nth") - 1).alias("sync"))),
        (1, sizes.select("track", "nth", F.lit(0).cast("long").alias("rank"), "size")),
    ]
    union = None
    for kind, part in rows:
        part = part.withColumn("kind", F.lit(kind)).withColumn("nth", F.col("nth").cast("long")).withColumn("rank", F.col("rank").cast("long"))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    placed = summed(ordered(union, "track", "nth", "kind", "rank"), "track", "size", "upto")
    # A chunk's row comes before its first sample, so it sees the sizes of all samples before the chunk.
    placed = placed.withColumn("place", F.when(F.col("place").isNotNull(), F.struct("place.at", "place.end", F.col("upto").alias("before"))))
    known = filled(placed, "track", "time", "shown", "place", "sync").where("kind = 1 AND nth < place.end")
    marked = syncs.select("track").distinct().withColumn("has_syncs", F.lit(True))
    known = known.join(tracks.select("track", "timescale"), "track").join(marked, "track", "left")
    ticks = F.coalesce(F.col("time.ticks") + (F.col("nth") - F.col("time.from")) * F.col("time.delta"), F.lit(0))
    offset = F.when(F.col("nth") < F.col("shown.end"), F.col("shown.offset")).otherwise(0)
    return known.select(
        "track", "nth", F.floor(ticks * 1000 / F.col("timescale")).cast("long").alias("ts_ms"), _truncated(offset, F.col("timescale")).alias("offset_ms"),
        (F.col("place.at") + F.col("upto") - F.col("size") - F.col("place.before")).alias("at"), "size", (F.col("has_syncs").isNull() | F.col("sync").eqNullSafe(F.col("nth"))).alias("keyframe"),
    )


def movie_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type as a movie's track, its runs taken from the events' numbers."""
    n = numbered(table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), "event_id", F.length("props").cast("long").alias("size")), "track", "event_id")
    tracks = n.select("track").distinct().withColumn("timescale", F.when(F.col("track") == "click", 90_000).otherwise(44_100))
    times = n.where("nth % 3 = 0").select("track", F.expr("nth div 3").alias("run"), F.expr("nth % 5").alias("count"), F.expr("nth % 7 + 900").alias("delta"))
    offsets = n.where("nth % 4 = 1").select("track", F.expr("nth div 4").alias("run"), F.expr("nth % 3").alias("count"), F.expr("(nth % 11 - 5) * 1000").alias("offset"))
    chunk_runs = n.where("nth % 50 = 10").select("track", (F.col("nth") + 1).alias("first"), F.expr("1 + nth div 50 % 4").alias("per"))
    chunks = n.where("nth % 2 = 0").select("track", F.expr("nth div 2").alias("chunk"), (F.col("event_id") * 1000).alias("at"))
    syncs = n.where("track <> 'click' AND nth % 10 = 0").select("track", (F.col("nth") + 1).alias("nth"))
    return sample_table(tracks, times, offsets, chunk_runs, chunks, n.select("track", "nth", "size"), syncs)


QUERIES = {"movie_samples": movie_samples}
ORACLES = {
    "movie_samples": """
WITH n AS (SELECT event_type AS track, event_id, length(props) AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS nth FROM events),
t AS (SELECT track, nth // 3 AS run, nth % 5 AS cnt, nth % 7 + 900 AS delta FROM n WHERE nth % 3 = 0),
tt AS (SELECT *, sum(cnt) OVER w - cnt AS s, sum(cnt * delta) OVER w - cnt * delta AS ticks FROM t WINDOW w AS (PARTITION BY track ORDER BY run)),
t1 AS (SELECT track, s, arg_max(delta, run) AS delta, max(ticks) AS ticks FROM tt GROUP BY track, s),
o AS (SELECT track, nth // 4 AS run, nth % 3 AS cnt, (nth % 11 - 5) * 1000 AS offs FROM n WHERE nth % 4 = 1),
o1 AS (SELECT *, sum(cnt) OVER (PARTITION BY track ORDER BY run) - cnt AS s FROM o),
r AS (SELECT track, nth AS chunk, 1 + nth // 50 % 4 AS per FROM n WHERE nth % 50 = 10),
c AS (SELECT track, nth // 2 AS chunk, event_id * 1000 AS base FROM n WHERE nth % 2 = 0),
cp AS (SELECT c.track, c.chunk, c.base, coalesce(r.per, 0) AS per FROM c ASOF LEFT JOIN r ON r.track = c.track AND c.chunk >= r.chunk),
c1 AS (SELECT *, sum(per) OVER (PARTITION BY track ORDER BY chunk) - per AS s FROM cp),
x AS (SELECT n.track, n.nth, n.size, c1.base, c1.chunk FROM n JOIN c1 ON c1.track = n.track AND n.nth >= c1.s AND n.nth < c1.s + c1.per),
y AS (SELECT *, base + sum(size) OVER (PARTITION BY track, chunk ORDER BY nth) - size AS pos FROM x),
z AS (SELECT y.*, t1.ticks + (y.nth - t1.s) * t1.delta AS ticks FROM y ASOF LEFT JOIN t1 ON t1.track = y.track AND y.nth >= t1.s)
SELECT z.track, z.nth, (z.ticks * 1000 // CASE WHEN z.track = 'click' THEN 90000 ELSE 44100 END)::BIGINT AS ts_ms,
  trunc(coalesce(o1.offs, 0) * 1000 / CASE WHEN z.track = 'click' THEN 90000 ELSE 44100 END)::BIGINT AS offset_ms, z.pos::BIGINT AS "at", z.size, z.track = 'click' OR z.nth % 10 = 0 AS keyframe
FROM z LEFT JOIN o1 ON o1.track = z.track AND z.nth >= o1.s AND z.nth < o1.s + o1.cnt""",
}
