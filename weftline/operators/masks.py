"""Brush strokes on the transparency of pictures: strokes to discs, discs to tiles, tiles to pixels.

A stroke is stamped as discs half a radius apart along its points. Each disc goes to the tiles that it can
touch, a picture's tiles are joined with theirs, and a pixel takes the last stroke that covers its centre.
So a picture is never in one task, and a pixel is tested only against the discs of its own tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import dealt, table

TILE = 32
# What a picture's strokes may be.
MOST_STROKES, MOST_POINTS, RADII = 500, 30_000, (0.001, 0.2)


def checked(strokes: DataFrame) -> DataFrame:
    """``image, ord, restore, radius, points`` (arrays of x, y from 0 to 1), refused where out of bounds."""
    inside = lambda v: v.between(0.0, 1.0) & ~F.isnan(v)
    bad = ~F.coalesce(F.col("radius").between(*RADII) & ~F.isnan("radius") & F.forall("points", lambda p: inside(p["x"]) & inside(p["y"])), F.lit(False))
    fault = lambda why: F.raise_error(F.concat(F.lit(f"{why}: image "), F.col("image").cast("string")))
    sums = strokes.groupBy("image").agg(F.count("*").alias("_strokes"), F.sum(F.size("points")).alias("_points"))
    joined = strokes.join(sums, "image")
    ok = F.when((F.col("_strokes") > MOST_STROKES) | (F.col("_points") > MOST_POINTS), fault("too many brush points")).when(bad, fault("invalid brush")).otherwise(True)
    return joined.where(ok).drop("_strokes", "_points")


def discs(strokes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``image, w, h, ord, restore, x, y, r`` in pixels. ``sizes``: ``image, w, h``."""
    sized = checked(strokes).join(sizes, "image").withColumn("r", F.greatest(F.col("radius") * F.least("w", "h"), F.lit(1.0)))
    # From each point to the next; the first is stamped where it stands.
    legs = F.transform("points", lambda p, i: F.struct(F.get("points", F.greatest(i - 1, F.lit(0))).alias("a"), p.alias("b")))
    each = sized.select("image", "w", "h", "ord", "restore", "r", F.explode(legs).alias("leg"))
    dx, dy = (F.col("leg.b.x") - F.col("leg.a.x")) * F.col("w"), (F.col("leg.b.y") - F.col("leg.a.y")) * F.col("h")
    steps = F.greatest(F.ceil(F.hypot(dx, dy) / (F.col("r") * 0.5)), F.lit(1)).cast("int")
    stamped = each.withColumn("steps", steps).withColumn("dx", dx).withColumn("dy", dy).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    share = F.col("step") / F.col("steps")
    return stamped.select("image", "w", "h", "ord", "restore", (F.col("leg.a.x") * F.col("w") + F.col("dx") * share).alias("x"), (F.col("leg.a.y") * F.col("h") + F.col("dy") * share).alias("y"), "r").distinct()


def masked(strokes: DataFrame, sizes: DataFrame, tile: int = TILE) -> DataFrame:
    """``image, px, py, restore``: the pixels that strokes change, and whether the last one restores or erases."""
    stamped = discs(strokes, sizes)
    span = lambda at, most: F.sequence(F.floor(F.greatest(F.col(at) - F.col("r"), F.lit(0.0)) / tile).cast("int"), F.floor(F.least(F.col(at) + F.col("r"), F.col(most) - 1.0) / tile).cast("int"))
    tiled = stamped.withColumn("tx", F.explode(span("x", "w"))).withColumn("ty", F.explode(span("y", "h")))
    tiles = tiled.groupBy("image", "w", "h", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct("ord", "restore", "x", "y", "r"))).alias("discs"))  # bounded, as strokes are
    inside = lambda t, most: F.sequence(F.col(t) * tile, F.least((F.col(t) + 1) * tile, F.col(most)).cast("int") - 1)
    pixels = tiles.withColumn("px", F.explode(inside("tx", "w"))).withColumn("py", F.explode(inside("ty", "h")))
    covers = lambda d: F.hypot(F.col("px") + 0.5 - d["x"], F.col("py") + 0.5 - d["y"]) <= d["r"]
    last = F.try_element_at(F.filter("discs", covers), F.lit(-1))
    return pixels.select("image", "px", "py", last["restore"].alias("restore")).where("restore IS NOT NULL")


def painted(pixels: DataFrame, changes: DataFrame) -> DataFrame:
    """``image, px, py, alpha, source_alpha`` and others with ``alpha`` after the strokes."""
    alpha: Column = F.when(F.col("restore"), F.col("source_alpha")).when(~F.col("restore"), 0).otherwise(F.col("alpha"))
    return pixels.join(changes, ["image", "px", "py"], "left").withColumn("alpha", alpha).drop("restore")


def brush_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as two strokes on a picture of 40 by 24 pixels: how many pixels each leaves, and where."""
    v = dealt(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "image"), 1024, "image").select("image", F.transform("embedding", lambda x: F.least(F.abs(x.cast("double")) * 3, F.lit(1.0))).alias("e"))
    point = lambda i: F.struct(F.get("e", i).alias("x"), F.get("e", i + 1).alias("y"))
    brush = lambda k: F.struct(F.lit(k).alias("ord"), (F.col("image") % 2 == k).alias("restore"), (F.lit(0.05) + F.get("e", F.lit(40 + k)) * 0.1).alias("radius"), F.array(*[point(F.lit(6 * k + 2 * j)) for j in range(3)]).alias("points"))
    strokes = v.select("image", F.explode(F.array(brush(0), brush(1))).alias("s")).select("image", "s.*")
    found = masked(strokes, v.select("image", F.lit(40).alias("w"), F.lit(24).alias("h")), tile=16)
    return found.groupBy("image", "restore").agg(F.count("*").alias("pixels"), F.sum(F.col("px") + F.col("py") * 40).alias("places"))


QUERIES = {"brush_masks": brush_masks}
ORACLES = {
    "brush_masks": """
WITH v AS (SELECT vec_id AS image, list_transform(embedding, lambda x: least(abs(x::DOUBLE) * 3, 1.0)) AS e FROM embeddings),
s AS (SELECT image, k AS ord, image % 2 = k AS restore, greatest((0.05 + e[41 + k] * 0.1) * 24, 1.0) AS r, j, e[6 * k + 2 * j + 1] AS bx, e[6 * k + 2 * j + 2] AS by_, e[6 * k + 2 * greatest(j - 1, 0) + 1] AS ax, e[6 * k + 2 * greatest(j - 1, 0) + 2] AS ay
  FROM v, range(2) a(k), range(3) b(j)),
t AS (SELECT *, (bx - ax) * 40 AS dx, (by_ - ay) * 24 AS dy FROM s),
u AS (SELECT *, greatest(ceil(sqrt(dx * dx + dy * dy) / (r * 0.5)), 1)::INTEGER AS steps FROM t),
d AS (SELECT image, ord, restore, r, ax * 40 + dx * (i / steps) AS x, ay * 24 + dy * (i / steps) AS y FROM u, range(100) c(i) WHERE i <= steps),
p AS (SELECT image, px, py, arg_max(restore, ord) AS restore FROM d, range(40) e(px), range(24) f(py) WHERE abs(px + 0.5 - x) <= r AND sqrt((px + 0.5 - x) ** 2 + (py + 0.5 - y) ** 2) <= r GROUP BY 1, 2, 3)
SELECT image, restore, count(*) AS pixels, sum(px + py * 40)::BIGINT AS places FROM p GROUP BY 1, 2""",
}
