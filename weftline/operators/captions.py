"""Text from recognisers, and drawings: captions, reading order, boxes, polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.strings import timestamp
from weftline.session import table


def vtt(segments: DataFrame) -> DataFrame:
    """``id, start, end, text`` (seconds) to one caption file per id, cues in order of start."""
    cue = F.concat(timestamp(F.col("start")), F.lit(" --> "), timestamp(F.col("end")), F.lit("\n"), F.trim("text"))
    rows = segments.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", cue.alias("cue")))).alias("cues"))
    return rows.select("id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cues", lambda c: c["cue"]), "\n\n"), F.lit("\n")).alias("vtt"))


def reading_text(boxes: DataFrame) -> DataFrame:
    """``id, ord, y, h, text`` to text: an empty line where the next box starts over 1.5 heights lower."""
    order = W.partitionBy("id").orderBy("ord")
    glue = F.when(F.lag("y").over(order).isNull(), "").when(F.col("y") > F.lag("y").over(order) + F.lag("h").over(order) * 1.5, "\n\n").otherwise("\n")
    pieces = boxes.withColumn("piece", F.concat(glue, F.col("text")))
    return pieces.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda p: p["piece"]), "").alias("text"))


def bounding_boxes(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def svg_paths(points: DataFrame, width: float = 1000.0) -> DataFrame:
    """``drawing, path, ord, x, y`` to one SVG per drawing: scaled to a width, y turned over."""
    box = bounding_boxes(points, "drawing").withColumn("scale", F.lit(width) / F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9)))
    number = lambda c: F.format_string("%.2f", c)
    at = points.join(box, "drawing").select("drawing", "path", "ord", F.concat(number((F.col("x") - F.col("x0")) * F.col("scale")), F.lit(","), number((F.col("y1") - F.col("y")) * F.col("scale"))).alias("p"))
    lines = at.groupBy("drawing", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "p"))), lambda p: p["p"]), " ").alias("points"))
    shapes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "points"))), lambda s: F.concat(F.lit('<polyline fill="none" points="'), s["points"], F.lit('"/>'))), "\n")
    return lines.groupBy("drawing").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">\n'), shapes, F.lit("\n</svg>\n")).alias("svg"))


def wrapped(text: Column, measure: int) -> Column:
    """Lines of at most ``measure`` characters: words are kept whole unless one alone is longer."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    pieces = F.flatten(F.transform(words, lambda w: F.when(F.length(w) <= measure, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(?s).{{1,{measure}}}"), F.lit(0)))))
    step = lambda a, w: F.when(a["line"] == "", F.struct(a["done"].alias("done"), w.alias("line"))).when(F.length(a["line"]) + 1 + F.length(w) <= measure, F.struct(a["done"].alias("done"), F.concat(a["line"], F.lit(" "), w).alias("line"))).otherwise(F.struct(F.array_append(a["done"], a["line"]).alias("done"), w.alias("line")))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
    return F.aggregate(pieces, empty, step, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.array_append(a["done"], a["line"])))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return vtt(turns.select(F.col("conv_id").alias("id"), (F.col("turn") * 2.5).cast("double").alias("start"), (F.col("turn") * 2.5 + 2).cast("double").alias("end"), "text"))


def ocr_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return reading_text(turns.select(F.col("conv_id").alias("id"), F.col("turn").alias("ord"), (F.col("turn") * 20 + F.when(F.col("turn") % 3 == 2, 30).otherwise(0)).alias("y"), F.lit(16.0).alias("h"), "text"))


def drawing_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("drawing"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return bounding_boxes(points, "drawing")


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polyline per order of each supplier's lines."""
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("drawing"), F.col("l_orderkey").alias("path"), F.struct("l_linenumber", "l_partkey").alias("ord"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"))
    return svg_paths(points)


def word_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns set to 40 columns: number of lines and the longest."""
    lines = wrapped(F.col("text"), 40)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(lines).alias("lines"), F.coalesce(F.array_max(F.transform(lines, lambda x: F.length(x))), F.lit(0)).alias("longest"))


_TS = "printf('%02d:%02d:%02d.%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000)"
QUERIES = {"vtt_captions": captions, "ocr_reading": ocr_reading, "drawing_boxes": drawing_boxes, "drawing_svg": drawings, "word_wrap": word_wrap}
ORACLES = {
    "vtt_captions": f"""SELECT conv_id AS id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_TS.replace('ms', '(turn * 2500)')} || ' --> ' || {_TS.replace('ms', '(turn * 2500 + 2000)')} || chr(10) || trim(text, ' '), chr(10) || chr(10) ORDER BY turn) || chr(10) AS vtt
  FROM conversations GROUP BY conv_id""",
    "ocr_reading": """
WITH b AS (SELECT conv_id AS id, turn, text, turn * 20 + CASE WHEN turn % 3 = 2 THEN 30 ELSE 0 END AS y FROM conversations),
g AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL THEN '' WHEN y > lag(y) OVER w + 24 THEN chr(10) || chr(10) ELSE chr(10) END AS glue FROM b WINDOW w AS (PARTITION BY id ORDER BY turn))
SELECT id, string_agg(glue || text, '' ORDER BY turn) AS text FROM g GROUP BY id""",
    "drawing_boxes": "SELECT l_suppkey AS drawing, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1",
}
