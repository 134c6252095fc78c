"""Operator 13, line dedup: sharded cuckoo filters in front of exact reference counts.

The index remembers, for every key of a line, how many lines have it and the smallest id that holds it.
Its tables in the catalog, one of each kind per batch:

* ``lines``: ``key, doc_id, row, pos``, every line that counts, so that a deletion can find what a
  document held and who is next to keep a line;
* ``counts``: ``key, refs, keep_id``, the exact reference counts of the keys that the batch touched,
  bucketed by key; of several rows of a key, the latest batch's counts;
* ``gone``: ``doc_id`` of documents that a batch deleted;
* ``filters``: ``shard, slot, data``, the cuckoo filters of all keys with references after the batch.

``ingest`` reduces a batch to one row per key, combined before the shuffle, and asks the filters.
Keys they deny are new and never meet the exact table; only affirmed keys are joined with ``counts``,
which tells true from false. Keys without references so far enter the filters, one copy each. ``delete``
subtracts references, finds the next keeper where the keeper went, and takes keys without references
out of the filters. So any sequence of insertions and deletions leaves the index as if only the
documents that remain had been inserted.

Both return the lines whose fate changed: ``dropped`` (of the batch, and of earlier documents where a
smaller id came later) and ``restored``. ``rendered`` removes dropped lines from texts.

A key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased, told apart by 128
bits of its SHA-256. Lines whose key is under ``LEAST`` code points are never dropped.

Cases: null and empty text are one empty line; rows of one id are one document, so a line that only they
hold stays in each; a null id comes after all others, so its rows keep a line only if no other document
holds it; empty tables give empty results; other columns pass through ``rendered``, except that ``n_lines``,
``n_dropped`` and ``kept_text`` are replaced. One writer at a time. A batch has a name; the last batch can be run
again under its name after a job was lost, and must be before another begins.

Skew: keys are counted before they are shuffled; keys with over ``1/HOT_SHARE`` of the lines, of which there
are at most ``HOT_SHARE``, are joined by broadcast, all others by sort-merge. A shard's filter takes some
2.5 bytes a key, and shards are chosen so that the first batch has ``SHARD_KEYS`` in each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.cuckoo import CuckooFilter
from weftline.llm.scratch import written
from weftline.llm.text import documents, folded, whole

LEAST = 10
#: No more keys than this can each have more than 1/HOT_SHARE of the lines.
HOT_SHARE = 2000
SHARD_KEYS = 100_000
_BLANK = " \t\n\x0b\x0c\r"
_ENTRY = "shard int, kind int, slot int, data binary, refs long, keep_id long, spread boolean"
_FILTER, _INSERT, _DELETE = 0, 1, 2


def row_hash() -> F.Column:
    """Tells rows of one id apart."""
    return F.xxhash64("doc_id", whole())


def lines_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``key, doc_id, row, pos``: every line that could be dropped."""
    lines = docs.select("doc_id", row_hash().alias("row"), F.posexplode(F.split(whole(), "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "row", "pos", folded(F.btrim("line", F.lit(_BLANK))).alias("line")).where(F.length("line") >= least)
    return lines.select(F.substring(F.unhex(F.sha2("line", 256)), 1, 16).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "row", "pos")


def _keys(data: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(-1, 16)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Rows of one shard and kind at a time; they come in order of shard and kind."""
    for batch in batches:
        shard, kind = batch["shard"].to_numpy(), batch["kind"].to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(shard[a]), int(kind[a]), batch.slice(a, b - a)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with what their shard's filter says of them."""
    at, filters = None, CuckooFilter()
    for shard, kind, rows in _shards(batches):
        if shard != at:
            at, filters = shard, CuckooFilter()
        if kind == _FILTER:
            filters.slots += CuckooFilter(rows["data"].to_pylist()).slots
        else:
            yield pa.RecordBatch.from_arrays([rows["data"], rows["refs"], rows["keep_id"], rows["spread"], pa.array(filters.contains(_keys(rows["data"])))], names=["key", "refs", "keep_id", "spread", "maybe"])


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters after insertions and deletions."""

    def out(shard: int, filters: CuckooFilter) -> pa.RecordBatch:
        n = len(filters.slots)
        return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([s.tobytes() for s in filters.slots], pa.binary())], names=["shard", "slot", "data"])

    at, filters = None, CuckooFilter()
    for shard, kind, rows in _shards(batches):
        if shard != at:
            if at is not None:
                yield out(at, filters)
            at, filters = shard, CuckooFilter()
        if kind == _FILTER:
            filters.slots += CuckooFilter(rows["data"].to_pylist()).slots
        else:
            (filters.insert if kind == _INSERT else filters.delete)(_keys(rows["data"]))
    if at is not None:
        yield out(at, filters)


class Changes(NamedTuple):
    """Lines, as ``doc_id, row, pos``, that a batch dropped or brought back."""

    dropped: DataFrame
    restored: DataFrame


class LineIndex:
    """The tables ``name__kind_version_batch``. ``name`` is a plain table name, batches are plain words."""

    def __init__(self, spark: SparkSession, name: str, shards: int | None = None):
        self.spark, self.name, self.shards = spark, name.lower(), shards

    # -- tables --------------------------------------------------------------------------------

    def tables(self, kind: str, before: int = 1 << 30) -> list[tuple[int, str, str]]:
        """``(version, batch, table)`` in order."""
        found = []
        for r in self.spark.sql(f"SHOW TABLES LIKE '{self.name}__{kind}_*'").collect():
            version, batch = r["tableName"].removeprefix(f"{self.name}__{kind}_").split("_", 1)
            found.append((int(version), batch, r["tableName"]))
        return sorted(x for x in found if x[0] < before)

    def begin(self, batch: str) -> int:
        """The version a batch writes; a batch that is run again has the version it had."""
        ended = {v for v, _, _ in self.tables("filters")}
        last = max((x for kind in ("lines", "gone", "counts", "filters") for x in self.tables(kind)), default=(0, "", ""))
        if last[1] == batch.lower():
            return last[0]
        if last[0] and last[0] not in ended:
            raise ValueError(f"batch {last[1]} has not ended; run it again first")
        return last[0] + 1

    def save(self, rows: DataFrame, kind: str, version: int, batch: str) -> DataFrame:
        table = f"{self.name}__{kind}_{version:06d}_{batch.lower()}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        write = rows
        if kind == "counts":
            write = rows.repartition(self.shards, "key").sortWithinPartitions("key")
        write = write.write.mode("overwrite").format("parquet").option("compression", "zstd")
        (write.bucketBy(self.shards, "key").sortBy("key") if kind == "counts" else write).saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for kind in ("filters", "counts", "lines", "gone"):
            for _, _, table in self.tables(kind):
                self.spark.sql(f"DROP TABLE {table}")

    def lines(self, before: int = 1 << 30) -> DataFrame | None:
        """Lines of documents that are there, without those a later batch deleted."""
        found = None
        for version, _, table in self.tables("lines", before):
            rows = self.spark.table(table)
            for later, _, gone in self.tables("gone", before):
                if later > version:
                    ids = self.spark.table(gone).select(F.col("doc_id").alias("gone_id"))
                    rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
            found = rows if found is None else found.unionByName(rows)
        return found

    def counts(self, keys: DataFrame | None = None, before: int = 1 << 30) -> DataFrame:
        """``key, refs, keep_id`` with references, of ``keys`` or of all: a merge join with each batch's table."""
        found = self.spark.createDataFrame([], "key binary, refs long, keep_id long, version int")
        for version, _, table in self.tables("counts", before):
            rows = self.spark.table(table)
            rows = rows if keys is None else rows.join(keys.hint("merge"), "key", "left_semi")
            found = found.unionByName(rows.withColumn("version", F.lit(version)))
        latest = found.groupBy("key").agg(F.max_by(F.struct("refs", "keep_id"), "version").alias("now"))
        return latest.select("key", "now.refs", "now.keep_id").where("refs > 0")

    def filters(self, version: int, entries: DataFrame | None) -> DataFrame:
        """The filters before a version, and entries, by shard in order of kind."""
        found = self.spark.createDataFrame([], _ENTRY) if entries is None else entries
        known = self.tables("filters", version)
        if known:
            table = self.spark.table(known[-1][2])
            found = found.unionByName(table.select("shard", F.lit(_FILTER).alias("kind"), "slot", "data"), allowMissingColumns=True)
        return found.repartition(self.shards, "shard").sortWithinPartitions("shard", "kind", "slot")

    def entries(self, keys: DataFrame, kind: int) -> DataFrame:
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        missing = [F.lit(None).cast(t).alias(c) for c, t in (("refs", "long"), ("keep_id", "long"), ("spread", "boolean")) if c not in keys.columns]
        return keys.select(shard.alias("shard"), F.lit(kind).alias("kind"), F.lit(0).alias("slot"), F.col("key").alias("data"), *(c for c in keys.columns if c in ("refs", "keep_id", "spread")), *missing)

    def close(self, changed: DataFrame, version: int, batch: str) -> None:
        """Writes the filters after a batch; with them, the batch has ended."""
        self.save(self.filters(version, changed).mapInArrow(_update, "shard int, slot int, data binary"), "filters", version, batch)

    def size(self, first_keys: int) -> None:
        """Shards are fixed by the first batch: the index's tables have that many buckets."""
        known = self.tables("counts")
        if known:
            self.shards = next(int(r["data_type"]) for r in self.spark.sql(f"DESCRIBE FORMATTED {known[0][2]}").collect() if r["col_name"] == "Num Buckets")
        self.shards = self.shards or max(8, -(-first_keys // SHARD_KEYS))

    # -- batches -------------------------------------------------------------------------------

    def ingest(self, docs: DataFrame, batch: str | None = None) -> Changes:
        """Add documents; ids that are in the index already should be deleted first."""
        batch = batch or f"b{uuid.uuid4().hex}"
        version = self.begin(batch)
        lines = self.save(lines_of(docs), "lines", version, batch)
        mixed = (F.min("doc_id") != F.max("doc_id")) | ((F.count("doc_id") > 0) & (F.count("doc_id") < F.count("*")))
        keys = written(lines.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("keep_id"), F.coalesce(mixed, F.lit(False)).alias("spread")), "line-keys")
        self.size(keys.count())
        if self.tables("filters", version):
            keys = written(self.filters(version, self.entries(keys, _INSERT)).mapInArrow(_probe, "key binary, refs long, keep_id long, spread boolean, maybe boolean"), "line-probes")
            # Keys that the filters deny skip the exact table.
            known = self.counts(keys.where("maybe").select("key"), version).select("key", F.struct("refs", "keep_id").alias("old"))
            merged = keys.where("maybe").join(known, "key", "left").unionByName(keys.where("NOT maybe"), allowMissingColumns=True)
        else:
            merged = keys.withColumn("old", F.lit(None).cast("struct<refs: long, keep_id: long>"))
        total = merged.select("key", "spread", "old", F.col("refs").alias("own"), (F.col("refs") + F.coalesce("old.refs", F.lit(0))).alias("refs"), F.least("keep_id", "old.keep_id").alias("keep_id"))
        total = written(total, "line-totals")
        self.save(total.select("key", "refs", "keep_id"), "counts", version, batch)
        self.close(self.entries(total.where("old IS NULL").select("key"), _INSERT), version, batch)
        dropped = others(lines, total.where("spread OR old IS NOT NULL").select("key", "own", "keep_id"))
        # A smaller id than the keeper's came later: the keeper's lines go.
        moved = total.where("old IS NOT NULL AND NOT old.keep_id <=> keep_id").select("key", F.col("old.keep_id").alias("left_id"))
        earlier = self.lines(version)
        if earlier is not None:
            dropped = dropped.unionByName(held(earlier, moved))
        return Changes(dropped, lines.select("doc_id", "row", "pos").limit(0))

    def delete(self, ids: DataFrame, batch: str | None = None) -> Changes:
        """Take documents out by ``doc_id``; ids that are not in the index have no effect."""
        batch = batch or f"d{uuid.uuid4().hex}"
        version = self.begin(batch)
        self.size(0)
        before = self.lines(version)
        gone = self.save(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "gone", version, batch)
        mine = before.join(gone.select(F.col("doc_id").alias("gone_id")), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi")
        lost = written(mine.groupBy("key").agg(F.count("*").alias("lost")), "line-losses")
        after = self.lines(version + 1).join(lost.select("key").hint("merge"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("next_id"))
        old = self.counts(lost.select("key"), version)
        total = old.join(lost, "key").join(after, "key", "left").select("key", (F.col("refs") - F.col("lost")).alias("refs"), F.col("keep_id").alias("old_id"), F.col("next_id").alias("keep_id"))
        total = written(total, "line-totals")
        self.save(total.select("key", "refs", "keep_id"), "counts", version, batch)
        self.close(self.entries(total.where("refs = 0").select("key"), _DELETE), version, batch)
        moved = total.where("refs > 0 AND NOT old_id <=> keep_id").select("key", F.col("keep_id").alias("left_id"))
        return Changes(mine.select("doc_id", "row", "pos").limit(0), held(self.lines(), moved))

    def dropped(self) -> DataFrame:
        """All lines of the index's documents that are dropped now."""
        return others(self.lines(), self.counts().select("key", F.col("refs").alias("own"), "keep_id"))


def held(lines: DataFrame, who: DataFrame) -> DataFrame:
    """The lines of ``who``'s keys in the document named there."""
    return lines.join(who.hint("merge"), (lines["key"] == who["key"]) & lines["doc_id"].eqNullSafe(who["left_id"])).select("doc_id", "row", "pos")


def others(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines of keys that another document keeps. ``own``: how many of ``lines`` have the key, at least."""
    n = lines.count()
    hot, cold = (keys.where(f"own * {HOT_SHARE} {test} {n}") for test in (">", "<="))
    by_broadcast = lines.join(F.broadcast(hot), "key")
    by_merge = lines.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold.hint("merge"), "key")
    return by_broadcast.unionByName(by_merge).where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "row", "pos")


def rendered(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines, n_dropped, kept_text``."""
    gone = dropped.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone")).select(F.col("doc_id").alias("gone_id"), "row", "gone")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    marked = docs.select(*kept).withColumn("weftline_row", row_hash())
    found = marked.join(gone.hint("merge"), (F.col("weftline_row") == gone["row"]) & F.col("doc_id").eqNullSafe(gone["gone_id"]), "left").select(*(marked[c] for c in kept), gone["gone"].alias("weftline_gone"))
    found = found.withColumn("weftline_lines", F.split(whole(), "\n"))
    n, lines = F.size("weftline_lines"), F.col("weftline_lines")
    left = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("weftline_gone")), lambda i: F.get(lines, i))
    text = F.when(F.col("weftline_gone").isNull(), whole()).otherwise(F.array_join(left, "\n"))
    return found.select(*kept, n.cast("long").alias("n_lines"), F.coalesce(F.array_size("weftline_gone"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"))


def fresh_index(spark: SparkSession) -> LineIndex:
    return LineIndex(spark, f"weftline_lines_{uuid.uuid4().hex}")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in two batches against one index, smaller ids first, so that no keeper changes."""
    docs, index = documents(spark, sf_dir).select("doc_id", "text"), fresh_index(spark)
    span = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    lower = F.coalesce(F.col("doc_id") <= (0 if span["low"] is None else (span["low"] + span["high"]) // 2), F.lit(False))
    first = index.ingest(docs.where(lower), "b1").dropped
    second = index.ingest(docs.where(~lower), "b2").dropped
    dropped = written(first.unionByName(second), "dropped-lines")
    index.drop()  # the result reads only the dropped lines
    return rendered(docs, dropped).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op13_line_dedup": op13}
ORACLES = {
    "op13_line_dedup": """
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), split AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), kept AS (
  SELECT *, length(key) >= 10 AND doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY r, doc_id
"""
}
