"""Receipts as a store: a folder of Parquet that grows by batches and forgets by id.

``receipts/batch=...`` holds what was inserted, ``deleted/request=...`` the ids that were removed;
reading is an anti-join. Every write replaces a folder of its own name, so a lost job can be run
again, and nothing is rewritten while it is read. ``compact`` folds deletions in.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import table

COLUMNS = "id string, converted_at long, source_name string, output_name string, output_bytes long, content_id string, detected string, class string, tool string, steps string"


def string_field(document: Column, name: str) -> Column:
    """A member of a variant that is a string, else an empty string."""
    return F.coalesce(optional_field(document, name), F.lit(""))


def optional_field(document: Column, name: str) -> Column:
    value = F.try_variant_get(document, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(document, f"$.{name}", "string"))


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as ``2024-01-31T23:59:59Z``, whatever the session's zone; negative ones count as 0."""
    s = F.greatest(seconds, F.lit(0))
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    rest = s % 86_400
    # Spark writes years of five digits with a plus.
    day = F.ltrim(F.date_from_unix_date(F.floor(s / 86_400).cast("int")).cast("string"), F.lit("+"))
    return F.concat(day, F.lit("T"), part(F.floor(rest / 3600)), F.lit(":"), part(F.floor(rest % 3600 / 60)), F.lit(":"), part(rest % 60), F.lit("Z"))


def parsed(bodies: DataFrame) -> DataFrame:
    """``id, converted_at, source_name, body`` (JSON) to COLUMNS; bodies that are no JSON are left out.

    Missing strings are empty, but for ``class``; a size that is no whole number from 0 is 0.
    """
    d = F.col("document")
    size = F.try_variant_get(d, "$.output_bytes", "variant")
    whole = F.schema_of_variant(size) == "BIGINT"
    number = F.try_variant_get(d, "$.output_bytes", "long")
    found = bodies.withColumn("document", F.try_parse_json("body")).where(d.isNotNull())
    return found.select(
        F.col("id").cast("string").alias("id"), F.col("converted_at").cast("long").alias("converted_at"), "source_name", string_field(d, "output").alias("output_name"),
        F.when(whole & (number >= 0), number).otherwise(F.lit(0)).alias("output_bytes"), string_field(d, "content_id").alias("content_id"), string_field(d, "detected").alias("detected"),
        optional_field(d, "class").alias("class"), string_field(d, "tool").alias("tool"), F.coalesce(F.to_json(F.try_variant_get(d, "$.steps", "variant")), F.lit("[]")).alias("steps"),
    )


def insert(bodies: DataFrame, store: str, batch: str) -> None:
    """Adds a batch; the same batch again replaces itself."""
    parsed(bodies).write.mode("overwrite").parquet(f"{store}/receipts/batch={batch}")


def delete(ids: DataFrame, store: str, request: str) -> None:
    """Removes the receipts whose ``id`` is listed."""
    ids.select(F.col("id").cast("string").alias("id")).write.mode("overwrite").parquet(f"{store}/deleted/request={request}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def receipts(spark: SparkSession, store: str) -> DataFrame:
    """All receipts that are left; a store without any is empty."""
    return _read(spark, f"{store}/receipts", COLUMNS).join(_read(spark, f"{store}/deleted", "id string"), "id", "left_anti")


def newest(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of a store's list, newest first, ties by id."""
    page = found.orderBy(F.desc("converted_at"), F.desc("id")).offset(offset).limit(limit)
    return page.select("id", iso_time(F.col("converted_at")).alias("date"), "source_name", "output_name", F.greatest("output_bytes", F.lit(0)).alias("output_bytes"))


def compact(spark: SparkSession, store: str, into: str) -> None:
    """Writes what is left as the one batch of a new store; nobody reads a store half rewritten."""
    receipts(spark, store).write.mode("overwrite").parquet(f"{into}/receipts/batch=compacted")


def delete_all(spark: SparkSession, store: str) -> int:
    """Removes everything and returns how many receipts were left."""
    count = receipts(spark, store).count()
    for part, schema in (("receipts", COLUMNS), ("deleted", "id string")):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{store}/{part}")
    return count


def safe_message(message: Column) -> Column:
    """An engine's error for a receipt: no control characters, at most 300 characters, never empty."""
    clean = F.substring(F.regexp_replace(message, r"[\x00-\x1f\x7f-\x9f]", ""), 1, 300)
    return F.when(clean == "", "the engine reported an unprintable error").otherwise(clean)


# -- queries ---------------------------------------------------------------------------------


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as receipts: a purchase has no tool, every seventh a text for its size, every eleventh is torn."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "length(props) AS size")
    number = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit('"big"')).otherwise(F.col("size").cast("string"))
    tool = F.when(F.col("event_type") == "purchase", "7").otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    body = F.concat(F.lit('{"output":"out-'), F.col("event_id").cast("string"), F.lit('","output_bytes":'), number, F.lit(',"tool":'), tool, F.lit(',"class":null,"steps":["a","b"]'), F.when(F.pmod("event_id", F.lit(11)) == 0, "").otherwise("}"))
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") * 86_399).alias("converted_at"), F.col("event_type").alias("source_name"), body.alias("body"))


def receipts_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(_bodies(spark, sf_dir)).select("id", iso_time(F.col("converted_at")).alias("date"), "source_name", "output_name", "output_bytes", "class", "tool", "steps")


def safe_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as errors."""
    return table(spark, sf_dir, "documents").select("doc_id", safe_message(F.coalesce("text", F.lit(""))).alias("message"))


QUERIES = {"receipts_parsed": receipts_parsed, "safe_messages": safe_messages}
ORACLES = {
    "receipts_parsed": """
SELECT event_id::VARCHAR AS id, strftime(make_timestamp(event_id::BIGINT * 86399 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS date, event_type AS source_name, 'out-' || event_id AS output_name,
  CASE WHEN event_id % 7 = 0 THEN 0 ELSE length(props) END::BIGINT AS output_bytes, NULL::VARCHAR AS class, CASE WHEN event_type = 'purchase' THEN '' ELSE event_type END AS tool, '["a","b"]' AS steps
FROM events WHERE event_id % 11 <> 0""",
    "safe_messages": """
SELECT doc_id, CASE WHEN m = '' THEN 'the engine reported an unprintable error' ELSE m END AS message
FROM (SELECT doc_id, substr(regexp_replace(coalesce(text, ''), '[\\x{00}-\\x{1f}\\x{7f}-\\x{9f}]', '', 'g'), 1, 300) AS m FROM documents)""",
}
