"""Archives as tables: entries of zip, tar and gzip files, and repacking between them.

Files come from ``spark.read.format("binaryFile")`` or any ``(path, content)`` table. Limits on
entries, nesting and running bytes hold before an entry is handed on; names that leave the archive's
folder are refused. A refused archive gives one row with ``error`` set and no content.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.batches import slices
from weftline.session import table

ENTRIES = "path string, pos int, name string, size long, content binary, error string"


@dataclass(frozen=True)
class Limits:
    entries: int = 100_000
    total: int = 8 << 30
    depth: int = 32


def problem(name: str, limits: Limits) -> str | None:
    parts = name.replace("\\", "/").split("/")
    if not name or name.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
        return "escapes its folder"
    return "nested too deep" if len(parts) > limits.depth else None


def unpacked(data: bytes, limits: Limits) -> list[tuple[str, bytes]]:
    """Entries in order; raises ValueError where a limit or a name forbids it."""
    out: list[tuple[str, bytes]] = []
    total = 0

    def take(name: str, size: int, read) -> None:
        nonlocal total
        total += size
        if found := problem(name, limits):
            raise ValueError(f"{name}: {found}")
        if len(out) >= limits.entries or total > limits.total:
            raise ValueError(f"{name}: over the archive's limit")
        out.append((name, read()))

    try:
        if data[:4] == b"PK\x03\x04" or data[:4] == b"PK\x05\x06":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        take(info.filename, info.file_size, lambda info=info: z.read(info))
            return out
        if data[:2] == b"\x1f\x8b":
            with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
                data = g.read(limits.total + 1)
            if len(data) > limits.total:
                raise ValueError("over the archive's limit")
        if data[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for member in t:
                    if member.isfile():
                        take(member.name, member.size, lambda member=member: t.extractfile(member).read())
            return out
    except (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError) as e:
        raise ValueError(f"not readable: {e}") from e
    raise ValueError("not an archive")


def packed(entries: list[tuple[str, bytes]], kind: str) -> bytes:
    """``zip``, ``tar`` or ``gzip`` (a compressed tar), without times, so equal entries give equal bytes."""
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in entries:
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return gzip.compress(out.getvalue(), mtime=0) if kind == "gzip" else out.getvalue()


def entries(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(path, content)`` to one row per entry."""
    schema = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    rows = [(path, i, name, len(body), body, None) for i, (name, body) in enumerate(unpacked(data or b"", limits))]
                except ValueError as e:
                    rows = [(path, None, None, None, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, ENTRIES)


def repack(files: DataFrame, kind: str, limits: Limits = Limits()) -> DataFrame:
    """``path, content, error``: each archive as another kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    rows.append((path, packed(unpacked(data or b"", limits), kind), None))
                except ValueError as e:
                    rows.append((path, None, str(e)))
            types = (pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")


def pack(rows: DataFrame, kind: str) -> DataFrame:
    """``(path, name, content)`` to one archive per path, entries by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [packed([(e["name"], e["content"]) for e in es], kind) for es in batch["entries"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(made, pa.binary())], names=["path", "content"])

    grouped = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("entries"))
    return grouped.mapInArrow(run, "path string, content binary")


def archive_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation packed as a zip, repacked as tar, gzip and zip again, then read."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.format_string("turn/%05d.txt", F.col("turn")).alias("name"), F.col("text").cast("binary").alias("content"))
    files = pack(turns, "zip")
    for kind in ("tar", "gzip", "zip"):
        files = repack(files, kind)
    return entries(files).select("path", "pos", "name", "size", F.sha2("content", 256).alias("content_sha256"))


QUERIES = {"archive_chain": archive_chain}
ORACLES = {
    "archive_chain": "SELECT conv_id::VARCHAR AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, printf('turn/%05d.txt', turn) AS name, strlen(text) AS size, sha256(text) AS content_sha256 FROM conversations",
}
