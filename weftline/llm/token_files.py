"""Operator 3, token ids in ORC files.

``write_tokens`` range-partitions documents by id, encodes each partition in order and writes one
ORC file per partition: ids are integer arrays, which ORC stores with run-length and bit-packed
encodings; row indexes and a Bloom filter on ``doc_id`` let a reader skip stripes and row groups,
and stripes are read in parallel. Each row also holds its shard and the ids before it in that
shard, so the place of a document in the whole stream needs one small sum per shard.

Cases: null text counts as empty, so a document is at least its end id; a null ``doc_id`` sorts
first; rows that share an id are ordered by a hash of their text, which also spreads many of them
over several files, and stay separate; an empty table gives
files without rows; extra columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.scratch import scratch_path
from weftline.llm.text import documents, whole
from weftline.llm.tokens import encoder

END_ID = 2
SCHEMA = "doc_id long, shard int, shard_start long, ids array<int>"
#: Small strides, as a row is a whole document; about 16 MB of packed ids a stripe.
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        end = np.array([end_id], code.dtype).tobytes()
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            packed = [code.ids(text) + end for text in batch["text"].to_pylist()]
            lengths = np.array([len(x) for x in packed], np.int64) // np.dtype(code.dtype).itemsize
            ends = np.cumsum(lengths)
            starts = before + ends - lengths
            before += int(lengths.sum())
            values = pa.array(np.frombuffer(b"".join(packed), code.dtype).astype(np.int32))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.full(len(packed), shard, np.int32)), pa.array(starts), pa.ListArray.from_arrays(offsets, values)],
                names=["doc_id", "shard", "shard_start", "ids"],
            )

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Write ``doc_id, shard, shard_start, ids`` in ascending order of ``doc_id``."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), F.xxhash64(whole()).alias("tie"), F.monotonically_increasing_id().alias("own"))
    # Even rows with one id and one text are dealt out: each has a number of its own.
    order = ("doc_id", "tie", "own")
    ordered = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; stripes without them are skipped by index and Bloom filter."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def shard_offsets(tokens: DataFrame) -> DataFrame:
    """``shard, shard_offset``: ids before each shard. One row per file."""
    totals = tokens.groupBy("shard").agg(F.sum(F.size("ids")).alias("total"))
    before = F.sum("total").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return totals.select("shard", F.coalesce(before, F.lit(0)).alias("shard_offset"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["ids"]
        offsets = lists.offsets.to_numpy()
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["shard"], batch["shard_start"], pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"],
        )


def digest_tokens(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files; one row per shard is broadcast."""
    rows = tokens.mapInArrow(_checksums, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    placed = rows.join(F.broadcast(shard_offsets(tokens)), "shard")
    return placed.select("doc_id", (F.col("shard_offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens-orc")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return digest_tokens(read_tokens(spark, path))


QUERIES = {"op3_token_files": op3}
ORACLES: dict[str, str] = {}
