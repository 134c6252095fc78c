"""Operator 1, exact dedup: a persistent digest index, bucketed and sorted by hash.

The index is a set of runs, one catalog table per batch, each bucketed by digest with one sorted
file per bucket. A batch's rows are hashed and reduced to one row per digest before anything wide
moves; sort-merge anti-joins against the runs tell which digests are new, and those are written as
the batch's own run. Runs are read as they lie: neither shuffled nor sorted. Once there are more
than ``MAX_RUNS`` of them, they are merged into one.

A batch has a name, and a run is overwritten by a batch of the same name, whose digests never count
as seen before. So a job that died between the append and the use of its result can be run again:
it finds the same rows new. A run is complete or absent for readers, as Spark commits it.

Texts are equal when identical after lower-casing A-Z. Of equal texts in a batch, the row with the
largest ``doc_id`` stays, unless an earlier batch has the text. ``op1`` ingests the table in two
batches against one index, the larger ids first, so that what stays is the same as in one batch.
Rows that share both text and id are all marked as kept by ``ingest``; ``keep_new`` returns one of
them.

Cases: null text counts as empty, and all empty texts are one group; a null ``doc_id`` sorts below
every id and stays only if its whole group has null ids; an empty table gives an empty result and
an empty run; other columns pass through untouched.

Skew: a digest that holds more than ``1/HOT_SHARE`` of the batch is joined by broadcast. There can
be at most ``HOT_SHARE`` such digests whatever the size of the input, which bounds the broadcast;
all other digests go through the sort-merge join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.keep import kept_rows
from weftline.llm.scratch import written
from weftline.llm.text import documents, folded, whole

#: No more digests than this can each hold more than 1/HOT_SHARE of the rows.
HOT_SHARE = 2000
#: Runs an index may have before they are merged.
MAX_RUNS = 8


def text_digest(text: str | Column = "text") -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(folded(whole(text)).cast("binary"), 256))


class DigestIndex:
    """Runs ``(digest, keep_id, group_size, batch)`` in the catalog, bucketed and sorted by digest.

    One writer at a time; ``name`` must be a plain table name, each batch a plain word.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # A bucket's rows come in the order of its only file, so that no reader sorts them again.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def runs(self) -> list[str]:
        return sorted(r["tableName"] for r in self.spark.sql(f"SHOW TABLES LIKE '{self.name}__*'").collect())

    def read(self) -> DataFrame:
        """All rows; a digest has one, unless a job died while it merged runs."""
        empty = self.spark.createDataFrame([], "digest binary, keep_id long, group_size long, batch string")
        found = empty
        for run in self.runs():
            found = found.unionByName(self.spark.table(run))
        return found

    def write_run(self, run: str, rows: DataFrame) -> None:
        """One sorted file per bucket; replaces the run if it is there."""
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("overwrite").format("parquet").saveAsTable(run)

    def append(self, groups: DataFrame, batch: str) -> None:
        """``groups``: ``digest, keep_id, group_size``, without digests of earlier batches."""
        self.write_run(f"{self.name}__{batch}", groups.select("digest", F.col("keep_id").cast("long").alias("keep_id"), "group_size", F.lit(batch).alias("batch")))

    def new_groups(self, groups: DataFrame, batch: str = "") -> DataFrame:
        """The groups whose digest no other batch has: an anti-join with each run."""
        found = groups.repartition(self.buckets, "digest")
        for run in self.runs():
            if run == f"{self.name}__{batch}".lower():
                continue
            seen = self.spark.table(run).where(F.col("batch") != batch).select("digest")
            found = found.join(seen.hint("merge"), "digest", "left_anti")
        return found

    def compact(self) -> None:
        """Merge all runs into one. Runs go only after the merged one is complete."""
        old = self.runs()
        if len(old) > 1:
            self.write_run(f"{self.name}__merged_{uuid.uuid4().hex}", self.read().dropDuplicates(["digest"]))
            for run in old:
                self.spark.sql(f"DROP TABLE {run}")

    def drop(self) -> None:
        for run in self.runs():
            self.spark.sql(f"DROP TABLE {run}")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest)``, written out so that texts are hashed once."""
    return written(docs.select("doc_id", text_digest().alias("digest")), "digests")


def groups_of(hashed: DataFrame) -> DataFrame:
    """One row per digest, combined before the shuffle."""
    return hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def with_groups(hashed: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row of ``hashed`` with its group's columns, null where ``groups`` lacks the digest."""
    rows = hashed.count()
    hot = groups.where(F.col("group_size") * HOT_SHARE > rows).select("digest", F.struct("keep_id", "group_size").alias("hot"))
    # A row of a hot group gets a key that matches nothing, so that it is spread by its id.
    spread = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.col("doc_id").cast("string")).cast("binary"))
    found = hashed.join(F.broadcast(hot), "digest", "left").withColumn("key", F.coalesce(spread, F.lit(b"#")))
    cold = groups.where(F.col("group_size") * HOT_SHARE <= rows).select(F.col("digest").alias("key"), F.struct("keep_id", "group_size").alias("cold"))
    group = F.coalesce("hot", "cold")
    return found.join(cold.hint("merge"), "key", "left").select("doc_id", "digest", group["keep_id"].alias("keep_id"), group["group_size"].alias("group_size"))


def append_new(groups: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Append the groups of a batch whose digest is new; those, written out, as a later merge replaces the run."""
    if len(index.runs()) > MAX_RUNS:
        index.compact()
    fresh = written(index.new_groups(groups, batch), "new-groups")
    index.append(fresh, batch)
    return fresh


def ingest(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Deduplicate a batch against the index and itself, and append what is new.

    Returns ``doc_id, digest, keep_id, group_size, kept`` for every row of the batch; ``keep_id``
    is the id of the batch's row that stays, or null if an earlier batch had the text. A batch that
    is run again under its name gives the same rows again.
    """
    batch = batch or f"b{uuid.uuid4().hex}"
    hashed = digests(docs)
    joined = with_groups(hashed, append_new(groups_of(hashed), index, batch))
    return joined.withColumn("kept", F.col("keep_id").eqNullSafe(F.col("doc_id")) & F.col("group_size").isNotNull())


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"weftline_digests_{uuid.uuid4().hex}")


def ingest_all(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """A table in two batches, larger ids first: rows as ``ingest`` has them, groups over both.

    The first batch holds the ids over the middle between the smallest and the largest. Equal ids,
    and so all candidates of a group that could be preferred, are in one batch.
    """
    hashed = digests(docs)
    span = hashed.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    upper = F.col("doc_id") > (0 if span["low"] is None else (span["low"] + span["high"]) // 2)
    halves = [groups_of(hashed.where(half)) for half in (upper, F.coalesce(~upper, F.lit(True)))]
    halves = [written(half, "groups") for half in halves]
    for name, half in zip(("b1", "b2"), halves, strict=True):
        append_new(half, index, name)
    sizes = halves[0].unionByName(halves[1]).groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    groups = written(index.read().select("digest", "keep_id").join(sizes.hint("merge"), "digest"), "groups")
    joined = with_groups(hashed, groups)
    return joined.withColumn("kept", F.col("keep_id").eqNullSafe(F.col("doc_id")))


def _row_key(digest: Column) -> Column:
    return F.concat(digest, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"))


def kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found``, a result of ``ingest`` or ``ingest_all``, keeps; of repeats of one row, one."""
    return kept_rows(docs, _row_key(text_digest()), found.select(_row_key(F.col("digest")).alias("weftline_key"), "kept"))


def keep_new(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of a batch that stay, with all their columns; of repeats of one row, one stays."""
    return kept(docs, ingest(docs, index, batch))


def keep_first(docs: DataFrame) -> DataFrame:
    """A table's rows that stay, by ``ingest_all`` against an index that is dropped afterwards."""
    index = fresh_index(docs.sparkSession)
    found = ingest_all(docs, index)
    index.drop()  # the result reads its groups from a table of their own
    return kept(docs, found)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fresh_index(spark)
    found = ingest_all(documents(spark, sf_dir), index)
    index.drop()  # the result reads its groups from a table of their own
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op1_exact_dedup": op1}
ORACLES = {
    "op1_exact_dedup": """
WITH hashed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), grouped AS (
  SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM hashed
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM grouped
"""
}
