"""Operator 5, media columns: Matroska bytes to packet tables, and texts stored as samples.

``parsed`` adds to each row of a media table the packets that the parser finds in its file, with
timestamp, track and byte range, and its cues; ``packets`` and ``cues`` have them as one row each. A
packet's bytes are cut out of the stored file by its range. The packets stay beside their file, so
nothing is shuffled.

``stored`` turns texts into a media table, 8-bit PCM in Matroska. The registered query writes that
table, reads it, parses the stored files and describes the samples that the packets' ranges hold.

Cases: null media give no packets; malformed bytes give one packet row with only ``error`` set, and
no features; null text counts as empty and is stored as 64 zero bytes; equal texts give equal values;
rows with the same id are treated one by one; empty tables give empty tables; extra columns are
ignored. Memory: one batch of documents at a time, whatever the size of the table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import matroska
from weftline.llm.scratch import written
from weftline.llm.text import documents, whole

ALIGN = 64
_PACKET = pa.struct([("track", pa.int32()), ("cluster", pa.int32()), ("lace", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_())])
_CUE = pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("cluster_offset", pa.int64())])
_PARSED = (
    "packets array<struct<track:int,cluster:int,lace:int,timestamp_ns:long,offset:long,size:long,keyframe:boolean>>, "
    "cues array<struct<track:int,timestamp_ns:long,cluster_offset:long>>, error string"
)


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    flat = [x for row in rows for x in row]
    columns = zip(*flat, strict=True) if flat else [[]] * kind.num_fields
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packets, cues, errors = [], [], []
        for data in batch["media"].to_pylist():
            try:
                found, error = matroska.parse(data if data is not None else b""), None
            except ValueError as e:
                found, error = matroska.Media(), str(e)
            packets.append([(track, cluster, lace, time, at, size, key) for track, time, at, size, key, lace, cluster in found.packets])
            cues.append([(track, time, at) for time, track, at in found.cues])
            errors.append(error)
        yield pa.RecordBatch.from_arrays([*batch.columns, _lists(packets, _PACKET), _lists(cues, _CUE), pa.array(errors, pa.string())], names=[*batch.schema.names, "packets", "cues", "error"])


def parsed(media: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a table with a column ``media``, and ``packets``, ``cues``, ``error``."""
    names = list(dict.fromkeys([*columns, "media"]))
    kept = media.select(*names)
    return kept.mapInArrow(_parse, ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + f", {_PARSED}")


def packets(media: DataFrame) -> DataFrame:
    """``(doc_id, media)`` to one row per packet, or one with the error of a malformed file."""
    rows = parsed(media, "doc_id").select("doc_id", "error", F.explode_outer("packets").alias("packet"))
    return rows.where("packet IS NOT NULL OR error IS NOT NULL").select("doc_id", "packet.*", "error")


def cues(media: DataFrame) -> DataFrame:
    """``(doc_id, media)`` to one row per cue; malformed media have none."""
    return parsed(media, "doc_id").select("doc_id", F.explode("cues").alias("cue")).select("doc_id", "cue.*")


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % ALIGN if data else ALIGN)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch["data"].cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array([matroska.mux_pcm8(padded(x)) for x in raw], pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as a Matroska file of 8-bit samples."""
    return docs.select("doc_id", whole().cast("binary").alias("data")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


BUCKETS = 8


def describe(samples: bytes, n_packets: int) -> str:
    """Duration, level, crossings of the middle and peaks of eight parts, in whole numbers."""
    values = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    level = np.abs(values)
    crossings = int(np.count_nonzero((values[1:] < 0) != (values[:-1] < 0)))
    starts = np.arange(BUCKETS) * len(values) // BUCKETS
    peaks = np.maximum.reduceat(level, starts)
    seconds = len(values) * 1000 // matroska.SAMPLE_RATE
    return f"ms={seconds};packets={n_packets};sum={values.sum()};energy={(values * values).sum()};crossings={crossings};peaks={','.join(map(str, peaks))}"


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads a file's bytes at the ranges of the packets of its first track, in order of time."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        lists, rows = batch["packets"], []
        bounds = lists.offsets.to_numpy()
        track, time, at, size = (lists.values.field(c).to_numpy() for c in ("track", "timestamp_ns", "offset", "size"))
        for i, data in enumerate(batch["media"].to_pylist()):
            here = np.arange(bounds[i], bounds[i + 1])
            here = here[track[here] == 1]
            if data is None or not len(here):
                rows.append((None,) * 6)
                continue
            here = here[np.lexsort((at[here], time[here]))]
            payload = b"".join([data[a : a + n] for a, n in zip(at[here].tolist(), size[here].tolist(), strict=True)])
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), describe(payload, len(here))))
        found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *found], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold at their packets' ranges: ``doc_id, n_bytes, media`` to the contract's columns."""
    return parsed(media, "doc_id", "n_bytes").select("doc_id", "n_bytes", "media", "packets").mapInArrow(_describe, _FEATURES)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(written(stored(documents(spark, sf_dir)), "media"))


QUERIES = {"op5_media_columns": op5}
ORACLES: dict[str, str] = {}
