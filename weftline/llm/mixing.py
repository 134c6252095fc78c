"""Operator 2, mixing sources to target weights by Poisson replication.

A source with share ``w`` of the target mixture and ``mass`` characters gets the mean repetition
rate ``w * budget / mass``. Each document inverts a Poisson distribution with that mean at a
uniform number hashed from the seed and its id, is exploded by the count it draws, and the copies
are shuffled globally by a second hash. Nothing depends on the order or partitioning of the input.

A rate above ``MAX_RATE`` is drawn as a sum of equal Poisson parts, which has the same
distribution, so that the inverted table stays short for any rate.

Cases: null text counts as empty; the mass of a document is its length plus one, so empty texts
weigh something; a null source is a source of its own and takes the default weight; a source of
weight 0 yields no rows; rows that share an id draw the same count; a null id draws as its own id;
empty tables give empty results; other columns pass through untouched.

The rate table has one row per source. It is broadcast while there are at most
``BROADCAST_SOURCES`` sources; beyond that the join is salted so that a hot source spreads over
``SALTS`` tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.scratch import written
from weftline.llm.text import documents, whole

MAX_RATE = 16.0
#: P(X > TAIL) is below 2^-52 for a mean of MAX_RATE.
TAIL = 72
BROADCAST_SOURCES = 10_000
SALTS = 64

#: The mixture of the registered query: relative weights; other sources weigh 1.
QUERY_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
QUERY_SEED = 20260101


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of SHA-256."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, budget: float | None = None) -> DataFrame:
    """``weftline_key, weftline_rate, weftline_parts, weftline_cdf``: one row per source. ``budget``: target mass; None: the mass there is."""
    mass = docs.groupBy(_source_key(F.col("source")).alias("weftline_key")).agg(F.sum(F.length(whole()) + F.lit(1)).cast("double").alias("mass"))
    mass = written(mass, "source-mass")  # one scan, whatever reads it below
    known = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit("s" + k), F.lit(float(w)))]) if weights else None
    weight = F.coalesce(F.try_element_at(known, "weftline_key"), F.lit(float(default_weight))) if weights else F.lit(float(default_weight))
    mass = mass.withColumn("weight", weight)
    # Decimals add up alike in any order.
    total = mass.agg(F.sum(F.col("weight").cast("decimal(38,12)")).cast("double").alias("all_weight"), F.sum("mass").alias("all_mass"))
    target = F.lit(float(budget)) if budget is not None else F.col("all_mass")
    rated = mass.crossJoin(F.broadcast(total)).withColumn("rate", F.col("weight") / F.col("all_weight") * target / F.col("mass"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE))).cast("int")
    part = F.col("rate") / F.col("parts")
    log_factorials = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(TAIL + 1)])
    terms = F.transform(log_factorials, lambda lf, k: F.exp(F.lit(-1.0) * part + k * F.ln(part) - lf))
    summed = F.aggregate(terms, F.array().cast("array<double>"), lambda done, p: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + p))
    return (
        rated.where(F.col("weight") > 0)
        .withColumn("parts", parts)
        .withColumn("cdf", summed)
        .select("weftline_key", F.col("rate").alias("weftline_rate"), F.col("parts").alias("weftline_parts"), F.col("cdf").alias("weftline_cdf"))
    )


def with_rates(docs: DataFrame, table: DataFrame) -> DataFrame:
    keyed = docs.withColumn("weftline_key", _source_key(F.col("source")))
    if table.count() <= BROADCAST_SOURCES:
        return keyed.join(F.broadcast(table), "weftline_key")
    salted = table.withColumn("weftline_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("weftline_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["weftline_key", "weftline_salt"])


def replicate(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, budget: float | None = None, seed: int = 0) -> DataFrame:
    """The columns of ``docs`` and ``weftline_copy`` (from 1), ``weftline_copies``, ``weftline_order``; shuffled."""
    drawn = with_rates(docs, rates(docs, weights, default_weight, budget))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draw = lambda part: F.size(F.filter("weftline_cdf", lambda c: c <= _uniform(F.lit(seed), name, part)))
    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("weftline_parts")), draw), F.lit(0), lambda a, b: a + b)
    out = (
        drawn.withColumn("weftline_copies", copies)
        .where(F.col("weftline_copies") > 0)
        .withColumn("weftline_copy", F.explode(F.sequence(F.lit(1), F.col("weftline_copies"))))
        .withColumn("weftline_order", F.sha2(F.concat_ws("|", F.lit(f"order{seed}"), name, F.col("weftline_copy")).cast("binary"), 256))
    )
    # Hashed keys: each task gets a random share, and sorts it by the same hash.
    shuffled = out.repartition("weftline_order").sortWithinPartitions("weftline_order")
    return shuffled.select(*docs.columns, "weftline_copy", "weftline_copies", "weftline_order")


def mixed(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, budget: float | None = None, seed: int = 0) -> DataFrame:
    """The mixture itself, with the columns of ``docs``."""
    return replicate(docs, weights, default_weight, budget, seed).select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replicate(documents(spark, sf_dir), QUERY_WEIGHTS, seed=QUERY_SEED)
    return found.select("doc_id", "source", F.col("weftline_copy").alias("copy"), F.col("weftline_copies").alias("copies"), F.col("weftline_order").alias("shuffle_key"), "text")


def mixing_sql(table: str, columns: str, weights: dict[str, float], seed: int) -> str:
    """The same rows in SQL; ``columns`` may use d.* columns, copy, copies and shuffle_key."""
    cases = " ".join(f"WHEN '{k}' THEN {float(w)}" for k, w in sorted(weights.items()))
    logs = ", ".join(f"({k}, CAST({math.lgamma(k + 1)!r} AS DOUBLE))" for k in range(TAIL + 1))
    return f"""
WITH mass AS (
  SELECT source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS mass, CASE source {cases} ELSE 1.0 END::DOUBLE AS weight
  FROM {table} GROUP BY source
), rated AS (
  SELECT source, weight / sum(weight) OVER () * sum(mass) OVER () / mass AS rate, weight FROM mass
), parted AS (
  SELECT source, rate, greatest(1, ceil(rate / {MAX_RATE}))::INTEGER AS parts FROM rated WHERE weight > 0
), terms AS (
  SELECT source, parts, k, exp(-1.0 * (rate / parts) + k * ln(rate / parts) - lf) AS p
  FROM parted, (VALUES {logs}) AS logs(k, lf)
), cdf AS (
  SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), folded AS (
  SELECT source, parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, parts
), drawn AS (
  SELECT d.*, list_sum([len(list_filter(f.cs, lambda c: c <= ('0x' || substr(sha256('{seed}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || j), 1, 13))::BIGINT::DOUBLE / {2**52}.0))
                        FOR j IN generate_series(1, f.parts)])::INTEGER AS copies
  FROM {table} d JOIN folded f ON d.source IS NOT DISTINCT FROM f.source
), copied AS (
  SELECT *, unnest(generate_series(1, copies))::INTEGER AS copy FROM drawn WHERE copies > 0
)
SELECT {columns} FROM (
  SELECT *, sha256('order{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key FROM copied
) d
"""


QUERIES = {"op2_mixing": op2}
ORACLES = {"op2_mixing": mixing_sql("documents", "doc_id, source, copy, copies, shuffle_key, text", QUERY_WEIGHTS, QUERY_SEED)}
