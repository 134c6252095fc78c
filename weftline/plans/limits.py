"""Limits, budgets and isolation of planned steps, as expressions over columns of limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import catalog
from weftline.session import table

# Default limits of one step, and of a batch.
DEFAULTS = {"wall_s": 120, "cpu_s": 240, "memory": 1 << 30, "pixels": 256_000_000, "depth": 32, "entries": 100_000, "archive_total": 8 << 30}
OUTPUT_BUDGET, RESERVE = 64 << 30, 2 << 30


def clamp(asked: Column, ceiling: Column) -> Column:
    """Field by field the smaller; a flag must hold in both. ``asked`` and ``ceiling`` are structs of DEFAULTS and ``gpu``."""
    fields = [F.least(asked[k], ceiling[k]).alias(k) for k in DEFAULTS]
    return F.struct(*fields, (asked["gpu"] & ceiling["gpu"]).alias("gpu"))


def narrowed_pixels(width: Column, height: Column, pixels: Column) -> Column:
    """Known dimensions narrow the pixel limit to twice their area, and never widen it."""
    return F.least(pixels, F.coalesce(F.try_multiply(F.try_multiply(width.cast("long"), height.cast("long")), F.lit(2)), pixels))


def admits(projected: Column, free: Column) -> Column:
    return (projected <= OUTPUT_BUDGET) & (free >= projected + RESERVE)


def isolation(safe_parser: Column, needs_engine: Column) -> Column:
    """In process only where a memory-safe parser reads the input and no engine takes part."""
    return F.when(safe_parser & ~needs_engine, "in-process").otherwise("sandboxed")


def plan_hash(*parts: Column) -> Column:
    """A decimal of the first eight bytes of a digest of the request."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def limits_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests for limits, clamped by a ceiling."""
    o = table(spark, sf_dir, "orders")
    asked = F.struct(*[((F.col("o_orderkey") * (i + 3)) % (v * 2)).cast("long").alias(k) for i, (k, v) in enumerate(DEFAULTS.items())], (F.col("o_custkey") % 2 == 0).alias("gpu"))
    ceiling = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in DEFAULTS.items()], (F.col("o_custkey") % 3 == 0).alias("gpu"))
    found = o.select("o_orderkey", clamp(asked, ceiling).alias("c"))
    return found.select("o_orderkey", "c.wall_s", "c.depth", "c.entries", "c.gpu")


def route_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of events by how the first route of their pair is isolated, and its class."""
    ids = F.array(*[F.lit(r[1]) for r in catalog.format_rows()])
    asked = table(spark, sf_dir, "events").select(F.element_at(ids, (F.col("event_id") % 50 + 1).cast("int")).alias("source"), F.element_at(ids, (F.floor(F.col("event_id") / 50) % 50 + 1).cast("int")).alias("target"))
    formats = catalog.formats(spark).select(F.col("id").alias("source"), "safe_parser")
    needs = F.exists("requires", lambda r: ~r.isin("StreamsCompatible", "AudioCompatible"))
    first = catalog.routes(spark).groupBy("source", "target").agg(F.min_by(F.struct("class", "requires"), "ord").alias("route")).select("source", "target", "route.*")
    routes = asked.join(F.broadcast(first), ["source", "target"]).join(F.broadcast(formats), "source")
    return routes.select(isolation(F.col("safe_parser"), needs).alias("isolation"), "class").groupBy("isolation", "class").agg(F.count("*").alias("requests"))


def step_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pictures whose dimensions narrow the pixel limit, each with the hash of its plan."""
    w, h = F.col("l_quantity").cast("long") * 400, F.when(F.col("l_linenumber") != 3, F.col("l_suppkey"))
    limit = narrowed_pixels(w, h, F.lit(DEFAULTS["pixels"]).cast("long"))
    key = plan_hash(F.col("l_orderkey").cast("string"), F.lit("Jpeg"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", limit.alias("pixels"), key.cast("string").alias("plan_hash"))


def batch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose documents, grown a millionfold, still fit the output budget and the free space."""
    sums = table(spark, sf_dir, "documents").groupBy("source").agg((F.sum("n_chars") * 1_000_000).alias("projected"))
    return sums.select("source", "projected", admits(F.col("projected"), F.lit(40 << 30)).alias("admitted"))


_K = {k: i + 3 for i, k in enumerate(DEFAULTS)}
QUERIES = {"limits_clamped": limits_clamped, "route_isolation": route_isolation, "step_limits": step_limits, "batch_budget": batch_budget}
ORACLES = {
    "limits_clamped": "SELECT o_orderkey, " + ", ".join(f"least((o_orderkey * {_K[k]}) % {DEFAULTS[k] * 2}, {DEFAULTS[k]})::BIGINT AS {k}" for k in ("wall_s", "depth", "entries")) + ", o_custkey % 2 = 0 AND o_custkey % 3 = 0 AS gpu FROM orders",
    "route_isolation": f"""
WITH f AS (SELECT * FROM {catalog.sql_values([(r[0], r[1], r[5]) for r in catalog.format_rows()], 'i, id, safe')}), r AS (SELECT * FROM {catalog.sql_values(catalog.route_rows(), 'ord, source, target, class, requires, via')}),
q AS (SELECT event_id, s.safe, class, requires, row_number() OVER (PARTITION BY event_id ORDER BY ord) AS n FROM events JOIN f s ON s.i = event_id % 50 JOIN f t ON t.i = event_id // 50 % 50 JOIN r ON r.source = s.id AND r.target = t.id)
SELECT CASE WHEN safe AND len(list_filter(requires, lambda r: r NOT IN ('StreamsCompatible', 'AudioCompatible'))) = 0 THEN 'in-process' ELSE 'sandboxed' END AS isolation, class, count(*) AS requests FROM q WHERE n = 1 GROUP BY 1, 2""",
    "step_limits": f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN {DEFAULTS["pixels"]} ELSE least({DEFAULTS["pixels"]}, l_quantity::BIGINT * 400 * l_suppkey * 2) END AS pixels,
  (('0x' || substr(sha256(l_orderkey || chr(31) || 'Jpeg'), 1, 16))::UBIGINT)::VARCHAR AS plan_hash FROM lineitem""",
    "batch_budget": f"SELECT source, projected::BIGINT AS projected, projected <= {OUTPUT_BUDGET} AND {40 << 30} >= projected + {RESERVE} AS admitted FROM (SELECT source, sum(n_chars) * 1000000 AS projected FROM documents GROUP BY source)",
}
