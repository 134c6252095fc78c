"""Operator 10, SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints of 64 bits link where at most four bits differ. A fingerprint is split into segments
of 23, 23 and 18 bits; a segment's keys are the indices of the Golay codewords near it (see
``golay``), so that segments that differ in two bits or fewer share a key. Four errors fall on
three segments in one of these ways, and each way shares one of a fingerprint's keys:

* no segment has more than two errors: keys of the first and second, and one of three parts of the
  third, as two errors leave one part clean;
* some segment has three or four errors: then one of the others is clean and the last has at most
  one: the clean segment itself, and keys of the last. Six such pairs.

Keys are joined and every link is verified by the number of differing bits. Equal fingerprints are
one row from the start, and of buckets with the same fingerprints one is kept. In a bucket, rows are first linked to the bucket's smallest fingerprint;
after components are found from those, only rows outside a bucket's most common component are
compared with the bucket, so a large group costs its size, not its square, and no link is lost.

Cases: null text counts as empty, and empty texts have the fingerprint zero; fewer words than a
shingle make one shingle; a null ``doc_id`` never names a component unless it is alone; repeated
rows are rows of one component; an empty table gives an empty result; extra columns are ignored
(``keep_one`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import golay
from weftline.llm.components import connected
from weftline.llm.keep import kept_rows
from weftline.llm.scratch import written
from weftline.llm.text import documents, whole

SHINGLE, SEED, RADIUS = 4, 42, 4
BLOCK = 1 << 16

#: Fingerprints whose keys one task makes, and the most tasks; beyond these, tasks grow.
TASK_FPS, MOST_TASKS = 8192, 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint, unsigned; zero without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    starts = [0, *(np.cumsum([len(p) for p in parts[:-1]]) + np.arange(1, len(parts))).tolist()]
    ends = [s - 1 for s in starts[shingle:]] + [len(joined)]
    digest, n = xxhash.xxh64_intdigest, len(ends)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : min(at + BLOCK, n)], ends[at : at + BLOCK], strict=True)], "<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch["text"].cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(found)], names=["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, fp``: one row per document, written out. ``text_key``: a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("text_key"), whole().alias("text"))
    return written(rows.mapInArrow(_fingerprints, "doc_id long, text_key long, fp long"), "fingerprints")


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of every key of every fingerprint; a key's top bits say which kind it is."""
    bits = fps.view(np.uint64)
    exact = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in ((0, 23), (23, 23), (46, 18))]
    fuzzy = [golay.keys(x, n) for x, n in zip(exact, (23, 23, 18), strict=True)]
    rows, keys = [], []

    def add(kind: int, values: np.ndarray, valid: np.ndarray) -> None:
        row, column = np.nonzero(valid)
        rows.append(row)
        keys.append(values[row, column] | kind << 48)

    pairs = (fuzzy[0][0][:, :, None] << 12 | fuzzy[1][0][:, None, :]).reshape(len(fps), -1)
    valid = (fuzzy[0][1][:, :, None] & fuzzy[1][1][:, None, :]).reshape(len(fps), -1)
    for part in range(3):
        add(part, pairs << 6 | (exact[2] >> 6 * part & 63)[:, None], valid)
    kind = 3
    for clean in range(3):
        for near in range(3):
            if near != clean:
                add(kind, exact[clean][:, None] << 12 | fuzzy[near][0], fuzzy[near][1])
                kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch["fp"].to_numpy()
        for at in range(0, len(fps), 4096):
            row, key = fuzzy_keys(fps[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[at : at + 4096][row])], names=["key", "fp"])


def _near(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def links(fps: DataFrame) -> DataFrame:
    """``(node, root)`` over distinct fingerprints: components of those within RADIUS bits."""
    # A small table is read by few tasks, and each fingerprint has about a hundred keys: spread them.
    tasks = min(MOST_TASKS, fps.count() // TASK_FPS + 1)
    keyed = fps.select("fp").repartition(tasks, "fp").mapInArrow(_keys, "key long, fp long")
    # Aggregates are combined before they are shuffled, and a join with their few rows can be split
    # where a bucket is crowded; a window could not.
    ends = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("mix")).where("n > 1")
    # Near copies share many keys, so many buckets hold the same fingerprints: one of them has all their links.
    # Buckets are told apart by their smallest fingerprint, their size and 64 bits of a hash of all.
    ends = ends.groupBy("low", "n", "mix").agg(F.min("key").alias("key")).select("key", "low")
    shared = written(keyed.join(written(ends, "shared-keys").hint("merge"), "key"), "buckets")
    stars = shared.where((F.col("fp") != F.col("low")) & _near("fp", "low")).select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    first = connected(stars)
    label = F.coalesce("root", "fp").alias("part")
    labelled = written(shared.join(first.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("key", "fp", label), "labelled")
    # Buckets that still hold more than one component.
    mixed = labelled.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("key")
    open_ = written(labelled.join(mixed.hint("merge"), "key", "left_semi"), "open-buckets")
    sizes = open_.groupBy("key", "part").count()
    common = sizes.groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("common"))
    few = open_.join(common.hint("merge"), "key").where("part <> common").select("key", F.col("fp").alias("x"), F.col("part").alias("a"))
    pairs = few.join(open_.withColumnRenamed("part", "b").hint("merge"), "key").where((F.col("a") != F.col("b")) & _near("x", "fp")).select("a", "b").distinct()
    between = written(pairs, "between")
    if not between.limit(1).count():
        return first
    second = connected(between)
    merged = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    moved = second.join(first, "node", "left_anti")  # parts of one fingerprint, and roots of the first round
    return written(merged.unionByName(moved.select("node", "root")).where("node <> root"), "links")


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, fp, first``; ``first`` is the struct (doc_id, text_key) of the component's smallest row."""
    rows = fingerprints(docs)
    own = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "text_key")
    fps = written(rows.groupBy("fp").agg(F.min(own).alias("own")), "distinct-fingerprints")
    found = links(fps)
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tops = rooted.groupBy("root").agg(F.min("own").alias("first"))
    named = written(rooted.join(tops, "root").select("fp", "first"), "named")
    return rows.join(named.hint("merge"), "fp").select("doc_id", "text_key", "fp", "first")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns of ``docs``."""
    row = lambda doc_id, text_key: F.struct(F.coalesce(doc_id.cast("long"), F.lit(0)), doc_id.isNull(), text_key)  # noqa: E731  no field is null, so structs are equal or not
    found = near_groups(docs).select(row(F.col("doc_id"), F.col("text_key")).alias("weftline_key"), (row(F.col("doc_id"), F.col("text_key")) == row(F.col("first.doc_id"), F.col("first.text_key"))).alias("kept"))
    return kept_rows(docs, row(F.col("doc_id"), F.xxhash64(whole())), found)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


QUERIES = {"op10_simhash": op10}
ORACLES: dict[str, str] = {}
