"""Image headers and pixels without codecs: dimensions, JPEG metadata removal, pixel arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import table


def _number(head: Column, at: int, size: int, little: bool) -> Column:
    """An unsigned number of ``size`` bytes at a place counted from 0."""
    places = range(size) if little else range(size - 1, -1, -1)
    total = F.lit(0).cast("long")
    for i, power in enumerate(places):
        total = total + F.conv(F.hex(F.substring(head, at + i + 1, 1)), 16, 10).cast("long") * (1 << 8 * power)
    return total


def probe(head: Column) -> Column:
    """Width and height from the header of a PNG, GIF, BMP or extended WebP image; null for others."""
    starts = lambda signature, at=1: F.hex(F.substring(head, at, len(signature) // 2)) == signature
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return (
        F.when(starts("89504E470D0A1A0A") & (F.length(head) >= 24), size(_number(head, 16, 4, False), _number(head, 20, 4, False)))
        .when((starts("474946383961") | starts("474946383761")) & (F.length(head) >= 10), size(_number(head, 6, 2, True), _number(head, 8, 2, True)))
        .when(starts("424D") & (F.length(head) >= 26), size(_number(head, 18, 4, True), _number(head, 22, 4, True)))
        .when(starts("57454250", 9) & starts("56503858", 13) & (F.length(head) >= 30), size(_number(head, 24, 3, True) + 1, _number(head, 27, 3, True) + 1))
    )


#: JPEG segments that hold metadata: APP1, APP2, APP12 to APP14 and comments.
METADATA = {0xE1: "APP1", 0xE2: "APP2", 0xEC: "APP12", 0xED: "APP13", 0xEE: "APP14", 0xFE: "COM"}


def strip_jpeg(data: bytes) -> tuple[bytes, list[str]]:
    """The file without metadata segments, and which were removed; other bytes are as they were."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    kept, removed, at = [data[:2]], [], 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if end > len(data) or end < at + 4:
            raise ValueError(f"the segment at byte {at} is cut short")
        if data[at + 1] in METADATA:
            removed.append(METADATA[data[at + 1]])
        else:
            kept.append(data[at:end])
        at = end
    return b"".join([*kept, data[at:]]), removed


def strip_metadata(files: DataFrame) -> DataFrame:
    """``(path, content)`` of JPEG files to ``path, content, removed, error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.binary(), pa.list_(pa.string()), pa.string())
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    rows.append((path, *strip_jpeg(data or b""), None))
                except ValueError as e:
                    rows.append((path, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=["path", "content", "removed", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, removed array<string>, error string")


def greyscale(pixels: Column) -> Column:
    """(r, g, b, a) values to (luminance, a) values."""
    at = lambda i, k: F.get(pixels, i * 4 + k)
    pairs = F.transform(F.sequence(F.lit(0), (F.size(pixels) / 4).cast("int") - 1), lambda i: F.array(((at(i, 0) * 2126 + at(i, 1) * 7152 + at(i, 2) * 722) / 10000).cast("int"), at(i, 3)))
    return F.when(F.size(pixels) >= 4, F.flatten(pairs)).otherwise(F.array().cast("array<int>"))


def coverage(alpha: Column) -> Column:
    """The share of opaque pixels."""
    return F.size(F.filter(alpha, lambda a: a >= 128)) / F.size(alpha)


def image_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GIF headers built from parts' sizes and keys, read back."""
    low = lambda c: F.format_string("%02X%02X", F.pmod(c, F.lit(256)), F.pmod(F.floor(c / 256).cast("long"), F.lit(256)))
    part = table(spark, sf_dir, "part")
    head = F.unhex(F.concat(F.lit("474946383961"), low(F.col("p_size").cast("long") * 31), low(F.col("p_partkey")), F.lit("F70000")))
    return part.select("p_partkey", probe(head).alias("p")).select("p_partkey", "p.width", "p.height")


def pixel_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings read as pixels: sums of the grey image and the share of opaque pixels."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("int")).alias("px"))
    grey = greyscale(F.col("px"))
    return v.select("vec_id", F.aggregate(grey, F.lit(0), lambda a, x: a + x).alias("total"), F.round(coverage(F.col("px")), 6).alias("opaque"))


QUERIES = {"image_probe": image_probe, "pixel_levels": pixel_levels}
ORACLES = {
    "image_probe": "SELECT p_partkey, (p_size * 31) % 65536 AS width, p_partkey % 65536 AS height FROM part",
    "pixel_levels": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x::DOUBLE) * 1000) % 256)::INTEGER) AS px FROM embeddings)
SELECT vec_id, list_sum(list_transform(range(len(px) // 4), lambda i: (px[i * 4 + 1] * 2126 + px[i * 4 + 2] * 7152 + px[i * 4 + 3] * 722) // 10000 + px[i * 4 + 4]))::INTEGER AS total,
  round(len(list_filter(px, lambda a: a >= 128)) / len(px), 6) AS opaque FROM v""",
}
