"""Provenance: content ids, journals, resuming, budgets and receipts.

A journal is append-only JSON lines; torn lines are skipped, never fatal. Resuming is an anti-join
with the last completed entry of each source whose output still exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.prefix import running_sum
from weftline.session import table

JOURNAL = "source_name string, content_id string, plan_hash decimal(20,0), output_name string, outcome string, reason string, output_bytes long, receipt_path string, source_folder string, suggested string, suggested_score double, chosen_rank int"


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All whole lines of a journal; ``_corrupt_record`` lines are dropped."""
    lines = spark.read.schema(JOURNAL + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return lines.where("_corrupt_record IS NULL").drop("_corrupt_record")


def append_journal(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def completed(journal: DataFrame, order: Column) -> DataFrame:
    """The last entry of each source, if it completed: ``source_name, output_name``."""
    last = journal.groupBy("source_name").agg(F.max_by(F.struct("outcome", "output_name"), order).alias("e"))
    return last.where("e.outcome = 'completed'").select("source_name", "e.output_name")


def resume(files: DataFrame, journal: DataFrame, order: Column, outputs: DataFrame) -> DataFrame:
    """Files still to do: not completed, or completed with an output that is gone."""
    done = completed(journal, order).join(outputs, "output_name", "left_semi")
    return files.join(done, "source_name", "left_anti")


def within_budget(entries: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """Entries with a running total and whether it is within the limit, in order of a whole number."""
    return running_sum(entries, group, order, F.col(size), "running").withColumn("admitted", F.col("running") <= limit)


def refused(entries: DataFrame, group: str, order: str) -> DataFrame:
    """Groups that the limit refuses as a whole, each with the first entry beyond it."""
    return entries.where(~F.col("admitted")).groupBy(group).agg(F.min(order).alias("at"))


def batch_summary(journal: DataFrame, batch: str) -> DataFrame:
    return journal.groupBy(batch).agg(
        F.count_if(F.col("outcome") == "completed").alias("converted"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "completed", F.col("output_bytes"))), F.lit(0)).alias("bytes_out"),
    )


def manifest(journal: DataFrame, batch: str, order: str) -> DataFrame:
    """One JSON document per batch, its rows in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "source_name", "outcome")))
    return journal.groupBy(batch).agg(F.to_json(F.struct(F.count("*").alias("files"), rows.alias("rows"))).alias("manifest"))


def scrubbed(requests: DataFrame) -> DataFrame:
    """Requests with a password parameter keep nothing of their parameters."""
    secret = F.exists(F.map_keys("parameters"), lambda k: F.contains(F.lower(k), F.lit("password")))
    return requests.withColumn("parameters", F.when(~secret, F.col("parameters")))


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal: a user is a batch and a day-type pair a source."""
    kind = F.pmod("event_id", F.lit(7))
    outcome = F.when(kind == 0, "failed").when(kind == 1, "skipped").otherwise("completed")
    source = F.concat_ws("-", F.pmod("event_id", F.lit(997)).cast("string"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", "user_id", source.alias("source_name"), outcome.alias("outcome"), F.concat(F.lit("out-"), F.pmod("event_id", F.lit(500)).cast("string")).alias("output_name"), F.length("props").cast("long").alias("output_bytes"))


_JOURNAL = """SELECT event_id, user_id, (event_id % 997) || '-' || event_type AS source_name, CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'completed' END AS outcome,
  'out-' || (event_id % 500) AS output_name, length(props)::BIGINT AS output_bytes FROM events"""


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = _journal(spark, sf_dir)
    outputs = journal.where("NOT endswith(source_name, 'click')").select("output_name").distinct()  # what still exists
    return resume(journal.select("source_name").distinct(), journal, F.col("event_id"), outputs)


def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source in order of id, as entries of an archive with a limit on its total."""
    found = within_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 50_000)
    return found.select("doc_id", "source", "running", "admitted")


def budget_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refused(budget_running(spark, sf_dir), "source", "doc_id")


def journal_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_summary(_journal(spark, sf_dir), "user_id")


def receipts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty receipts, newest first."""
    return _journal(spark, sf_dir).orderBy(F.desc("event_id")).offset(50).limit(50).select("event_id", "source_name", "outcome")


def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_journal(spark, sf_dir), "user_id", "event_id").select("user_id", F.get_json_object("manifest", "$.files").cast("long").alias("files"), F.get_json_object("manifest", "$.rows[0].source_name").alias("first_source"))


def with_siblings(rows: DataFrame, own: str, *shared: str) -> DataFrame:
    """Rows that share ``shared`` with a row of another ``own``: by the extremes of each group, so that no pairs are tried."""
    names = [f"_{c}" for c in shared]
    groups = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(shared, names, strict=True)]).agg(F.min(own).alias("_low"), F.max(own).alias("_high")).where("_low < _high").select(*names)
    return rows.join(groups, [rows[c] == groups[n] for c, n in zip(shared, names, strict=True)], "left_semi")


def sibling_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose source also holds another with the same text length."""
    return with_siblings(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", "source", "n_chars").select("doc_id")


def stem_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders (users) where the same stem occurs with two extensions: how many stems."""
    e = table(spark, sf_dir, "events").select("user_id", (F.pmod("event_id", F.lit(40))).alias("stem"), "event_type")
    sources = e.where("event_type = 'click'").select("user_id", "stem").distinct()
    outputs = e.where("event_type = 'purchase'").select("user_id", "stem").distinct()
    return sources.join(outputs, ["user_id", "stem"]).groupBy("user_id").agg(F.count("*").alias("pattern"))


QUERIES = {"resume_anti": resume_anti, "budget_running": budget_running, "budget_refused": budget_refused, "journal_batch_summary": journal_batch_summary, "receipts_page": receipts_page, "batch_manifest": batch_manifest, "sibling_semi": sibling_semi, "stem_pattern_intersect": stem_pattern}
ORACLES = {
    "resume_anti": f"""
WITH j AS ({_JOURNAL}), l AS (SELECT source_name, arg_max(outcome, event_id) AS outcome, arg_max(output_name, event_id) AS output_name FROM j GROUP BY 1),
d AS (SELECT source_name FROM l WHERE outcome = 'completed' AND output_name IN (SELECT output_name FROM j WHERE NOT ends_with(source_name, 'click')))
SELECT DISTINCT source_name FROM j WHERE source_name NOT IN (SELECT source_name FROM d)""",
    "budget_running": "SELECT doc_id, source, running::BIGINT AS running, running <= 50000 AS admitted FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents)",
    "budget_refused": "SELECT source, min(doc_id) AS at FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running > 50000 GROUP BY source",
    "journal_batch_summary": f"""SELECT user_id, count(*) FILTER (outcome = 'completed') AS converted, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped,
  coalesce(sum(output_bytes) FILTER (outcome = 'completed'), 0)::BIGINT AS bytes_out FROM ({_JOURNAL}) GROUP BY user_id""",
    "receipts_page": f"SELECT event_id, source_name, outcome FROM ({_JOURNAL}) ORDER BY event_id DESC LIMIT 50 OFFSET 50",
    "batch_manifest": f"SELECT user_id, count(*) AS files, arg_min(source_name, event_id) AS first_source FROM ({_JOURNAL}) GROUP BY user_id",
    "sibling_semi": "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents o WHERE o.source = d.source AND o.n_chars = d.n_chars AND o.doc_id <> d.doc_id)",
    "stem_pattern_intersect": "SELECT user_id, count(*) AS pattern FROM (SELECT user_id, event_id % 40 AS stem FROM events WHERE event_type = 'click' INTERSECT SELECT user_id, event_id % 40 FROM events WHERE event_type = 'purchase') GROUP BY user_id",
}
