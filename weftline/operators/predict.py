"""Ranking of likely targets: decayed history, two levels of blending, floors and folder intent.

History is one aggregation of exponentially decayed weights; shares come from windows over it; the
score of each candidate is one expression, applied in a fixed order, over broadcast dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans import catalog
from weftline.session import table

HALF_LIFE_DAYS = 60.0
ARM, LEAD = 0.85, 0.60


def decay(age_seconds: Column) -> Column:
    """Half after 60 days; 1 for no age, a negative one or one that is not a number."""
    days = age_seconds / F.lit(86400.0)
    return F.when(age_seconds.isNull() | F.isnan(age_seconds) | (age_seconds <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(F.lit(0.5), days / HALF_LIFE_DAYS))))


def evidence(n: Column) -> Column:
    return F.when(n.isNull() | F.isnan(n) | (n <= 0) | (n == float("inf")), 0.0).otherwise(n / (n + 3.0))


def blend(base: Column, hit: Column, total: Column) -> Column:
    w = evidence(total)
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), hit / total))
    return F.when(w == 0, base).otherwise(base * (1 - w) + ratio * w)


def pattern_floor(pattern: Column) -> Column:
    return F.when(pattern <= 0, F.lit(None)).when(pattern == 1, 0.70).when(pattern == 2, 0.80).otherwise(0.90)


def folder_category(folder: Column) -> Column:
    name = F.lower(folder)
    return F.when(F.contains(name, F.lit("screenshot")), "screenshots").when(F.contains(name, F.lit("scan")), "scans").when(F.contains(name, F.lit("download")), "downloads").otherwise("unknown")


def history(journal: DataFrame) -> DataFrame:
    """``source, target, folder, age_seconds, completed`` to decayed weights by folder and overall."""
    weighed = journal.where("completed AND source <> '' AND target <> ''").withColumn("w", decay(F.col("age_seconds")))
    sums = weighed.groupBy("folder", "source", "target").agg(F.sum("w").alias("folder_pair"))
    pair, source = W.partitionBy("source", "target"), W.partitionBy("source")
    return (
        sums.withColumn("pair", F.sum("folder_pair").over(pair)).withColumn("total", F.sum("folder_pair").over(source))
        .withColumn("folder_total", F.sum("folder_pair").over(W.partitionBy("folder", "source")))
    )


def global_priors(spark: SparkSession) -> DataFrame:
    """``source, target, prior, ord`` of every pair of formats; a tuned pair overrides the derived value."""
    f = catalog.formats(spark).join(catalog.weights(spark), "id", "left").join(catalog.fidelities(spark), "id", "left")
    a = f.select(F.col("id").alias("source"), F.col("kind").alias("ka"), F.col("fidelity").alias("fa"))
    b = f.select(F.col("id").alias("target"), F.col("kind").alias("kb"), F.col("fidelity").alias("fb"), "weight", "ord")
    pairs = a.join(F.broadcast(b), F.col("source") != F.col("target")).join(F.broadcast(catalog.priors(spark)), ["source", "target"], "left")
    direction = F.when((F.col("fa") == "lossy") & (F.col("fb") == "lossless"), 0.55).when((F.col("fa") == "lossless") & (F.col("fb") == "lossy"), 1.15).otherwise(1.0)
    base = F.when(F.col("ka") == F.col("kb"), 0.42).otherwise(0.10)
    derived = F.least(F.lit(1.0), base * F.coalesce("weight", F.lit(0.0)) * direction)
    return pairs.select("source", "target", F.coalesce("pair_prior", derived).alias("prior"), "ord")


# What an operation on a file scores before any habit, and what it keeps in a batch.
OPERATION_PRIOR, BATCH_FACTOR = 0.05, 0.7


def score(signals: DataFrame, operation: Column | None = None, batch_size: Column | None = None) -> DataFrame:
    """``prior, pair, total, folder_pair, folder_total, pattern, sibling, folder, target`` to ``score``, in this order of steps.

    Where ``operation`` holds, the target is an operation on the file: its prior is fixed, ``target`` is the
    file's own format, and a batch of more than one file counts against it.
    """
    operation = F.lit(False) if operation is None else F.coalesce(operation, F.lit(False))
    s = blend(F.when(operation, OPERATION_PRIOR).otherwise(F.col("prior")), F.coalesce("pair", F.lit(0.0)), F.col("total"))
    s = blend(s, F.coalesce("folder_pair", F.lit(0.0)), F.col("folder_total"))
    s = F.greatest(s, pattern_floor(F.col("pattern")))
    s = F.when(F.col("sibling"), F.greatest(s, F.lit(0.70))).otherwise(s)
    if batch_size is not None:
        s = s * F.when(operation & (batch_size > 1), BATCH_FACTOR).otherwise(1.0)
    category = folder_category(F.col("folder"))
    s = s * F.when((category == "screenshots") & F.col("target").isin("Jpeg", "Webp"), 1.2).when((category == "scans") & (F.col("target") == "Pdf"), 1.3).otherwise(1.0)
    return signals.withColumn("score", F.when(s.isNull() | F.isnan(s), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))))


def rank(scored: DataFrame, *keys: str) -> DataFrame:
    """Best first; equal scores keep the order of the format table."""
    return scored.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "ord")))


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as a journal: the customer's segment is the folder, priority and status give the formats."""
    orders = table(spark, sf_dir, "orders").join(F.broadcast(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")), F.col("o_custkey") == F.col("c_custkey"))
    sources = F.array(*[F.lit(x) for x in ("Png", "Docx", "Mkv", "Csv", "Wav")])
    targets = F.array(*[F.lit(x) for x in ("Jpeg", "Pdf", "Mp4", "Json", "Mp3", "Webp", "Txt")])
    newest = F.lit("1999-01-01").cast("timestamp")
    return orders.select(
        F.element_at(sources, (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int")).alias("source"), F.element_at(targets, (F.pmod("o_custkey", F.lit(7)) + 1).cast("int")).alias("target"),
        F.lower("c_mktsegment").alias("folder"), (F.unix_seconds(newest) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).cast("double").alias("age_seconds"), (F.col("o_orderstatus") != "P").alias("completed"),
    )


_JOURNAL = """SELECT ['Png', 'Docx', 'Mkv', 'Csv', 'Wav'][o_orderkey % 5 + 1] AS source, ['Jpeg', 'Pdf', 'Mp4', 'Json', 'Mp3', 'Webp', 'Txt'][o_custkey % 7 + 1] AS target, lower(c_mktsegment) AS folder,
  (epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate::TIMESTAMP))::DOUBLE AS age_seconds, o_orderstatus <> 'P' AS completed FROM orders JOIN customer ON o_custkey = c_custkey"""
_HISTORY = f"""j AS ({_JOURNAL}), w AS (SELECT *, CASE WHEN age_seconds <= 0 THEN 1.0 ELSE power(0.5::DOUBLE, age_seconds / 86400.0::DOUBLE / 60.0::DOUBLE) END AS w FROM j WHERE completed),
h AS (SELECT folder, source, target, sum(w) AS folder_pair FROM w GROUP BY 1, 2, 3),
hh AS (SELECT *, sum(folder_pair) OVER (PARTITION BY source, target) AS pair, sum(folder_pair) OVER (PARTITION BY source) AS total, sum(folder_pair) OVER (PARTITION BY folder, source) AS folder_total FROM h)"""


def history_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = ("folder_pair", "pair", "total", "folder_total")
    return history(_journal(spark, sf_dir)).select("folder", "source", "target", *[F.round(c, 5).alias(c) for c in sums])


def prior_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior of every pair of formats that events ask for, and how many do."""
    ids = F.array(*[F.lit(r[1]) for r in catalog.format_rows()])
    named = lambda at: F.element_at(ids, (at % len(catalog.format_rows()) + 1).cast("int"))
    asked = table(spark, sf_dir, "events").groupBy(named(F.col("event_id")).alias("source"), named(F.floor(F.col("event_id") / 50)).alias("target")).agg(F.count("*").alias("requests"))
    return asked.join(F.broadcast(global_priors(spark)), ["source", "target"]).select("source", "target", "requests", F.round("prior", 9).alias("prior"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history(_journal(spark, sf_dir))
    priors = global_priors(spark)
    joined = found.join(F.broadcast(priors), ["source", "target"])
    return joined.withColumn("pattern", F.pmod(F.length("folder"), F.lit(4))).withColumn("sibling", F.col("target") == "Pdf")


def score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked targets of each folder and source, with the thresholds they reach."""
    ranked = rank(score(_signals(spark, sf_dir)), "folder", "source")
    return ranked.select("folder", "source", "target", F.round("score", 6).alias("score"), "place", (F.col("score") >= ARM).alias("armed"), (F.col("score") >= LEAD).alias("leads"))


def operation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on files, alone and in batches: orders as files, their customers' folders as habits."""
    found = history(_journal(spark, sf_dir)).select("source", "folder", "total", "folder_total").distinct()
    sizes = found.withColumn("batch", F.explode(F.array(F.lit(1), F.lit(2))))
    signals = sizes.select("*", F.lit(None).cast("double").alias("prior"), (F.col("total") / 4).alias("pair"), (F.col("folder_total") / 3).alias("folder_pair"), F.lit(0).alias("pattern"), F.lit(False).alias("sibling"), F.col("source").alias("target"))
    return score(signals, F.lit(True), F.col("batch")).select("source", "folder", "batch", F.round("score", 6).alias("score"))


def folder_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best target of each folder and source: a top-1 by ``max_by``, without a window."""
    scored = score(_signals(spark, sf_dir))
    return scored.groupBy("folder", "source").agg(F.max_by("target", F.struct("score", -F.col("ord"))).alias("target"))


_PRIORS = f"""f AS (SELECT t.i, t.id, t.kind, w.weight, x.fidelity FROM {catalog.sql_values([(r[0], r[1], r[2]) for r in catalog.format_rows()], 'i, id, kind').replace('AS v(', 'AS t(')}
  LEFT JOIN {catalog.sql_values([(a, float(b)) for a, b in catalog.weight_rows()], 'id, weight').replace('AS v(', 'AS w(')} ON w.id = t.id LEFT JOIN {catalog.sql_values(catalog.fidelity_rows(), 'id, fidelity').replace('AS v(', 'AS x(')} ON x.id = t.id),
pp AS (SELECT * FROM {catalog.sql_values([(a, b, p) for (a, b), p in catalog.PRIOR_PAIRS.items()], 'source, target, p')}),
pr AS (SELECT a.id AS source, b.id AS target, b.i AS ord, coalesce(pp.p::DOUBLE, least(1.0::DOUBLE, (CASE WHEN a.kind = b.kind THEN 0.42::DOUBLE ELSE 0.10::DOUBLE END) * coalesce(b.weight, 0)::DOUBLE *
  (CASE WHEN a.fidelity = 'lossy' AND b.fidelity = 'lossless' THEN 0.55::DOUBLE WHEN a.fidelity = 'lossless' AND b.fidelity = 'lossy' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END))) AS prior
  FROM f a JOIN f b ON a.id <> b.id LEFT JOIN pp ON pp.source = a.id AND pp.target = b.id)"""
_SCORED = """b1 AS (SELECT hh.*, pr.prior, pr.ord, length(folder) % 4 AS pattern, prior * (1 - total / (total + 3)) + least(1.0, pair / total) * (total / (total + 3)) AS s1 FROM hh JOIN pr ON pr.source = hh.source AND pr.target = hh.target),
b2 AS (SELECT *, s1 * (1 - folder_total / (folder_total + 3)) + least(1.0, folder_pair / folder_total) * (folder_total / (folder_total + 3)) AS s2 FROM b1),
b3 AS (SELECT *, greatest(s2, CASE pattern WHEN 0 THEN 0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.8 ELSE 0.9 END, CASE WHEN target = 'Pdf' THEN 0.7 ELSE 0 END) *
  CASE WHEN contains(folder, 'screenshot') AND target IN ('Jpeg', 'Webp') THEN 1.2 WHEN contains(folder, 'scan') AND target = 'Pdf' THEN 1.3 ELSE 1.0 END AS s3 FROM b2),
sc AS (SELECT *, least(1.0, greatest(0.0, s3)) AS score FROM b3)"""

QUERIES = {"history_decay": history_decay, "prior_matrix": prior_matrix, "score_rank": score_rank, "folder_top": folder_top, "operation_scores": operation_scores}
ORACLES = {
    "history_decay": f"WITH {_HISTORY} SELECT folder, source, target, round(folder_pair, 5) AS folder_pair, round(pair, 5) AS pair, round(total, 5) AS total, round(folder_total, 5) AS folder_total FROM hh",
    "prior_matrix": f"""WITH {_PRIORS}, q AS (SELECT s.id AS source, t.id AS target, count(*) AS requests FROM events JOIN f s ON s.i = event_id % 50 JOIN f t ON t.i = event_id // 50 % 50 GROUP BY 1, 2)
SELECT source, target, requests, round(prior, 9) AS prior FROM q JOIN pr USING (source, target)""",
    "score_rank": f"WITH {_HISTORY}, {_PRIORS}, {_SCORED} SELECT folder, source, target, round(score, 6) AS score, row_number() OVER (PARTITION BY folder, source ORDER BY score DESC, ord)::INTEGER AS place, score >= 0.85 AS armed, score >= 0.6 AS leads FROM sc",
    "folder_top": f"WITH {_HISTORY}, {_PRIORS}, {_SCORED} SELECT folder, source, arg_max(target, (score, -ord)) AS target FROM sc GROUP BY 1, 2",
    "operation_scores": f"""WITH {_HISTORY}, d AS (SELECT DISTINCT source, folder, total, folder_total FROM hh),
s AS (SELECT *, 0.05::DOUBLE * (1 - total / (total + 3)) + 0.25::DOUBLE * (total / (total + 3)) AS s1 FROM d)
SELECT source, folder, batch::INTEGER AS batch, round(least(1.0, (s1 * (1 - folder_total / (folder_total + 3)) + (1 / 3.0::DOUBLE) * (folder_total / (folder_total + 3))) * CASE WHEN batch > 1 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM s, (VALUES (1), (2)) b(batch)""",
}
