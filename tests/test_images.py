import struct

import pytest
from pyspark.sql import functions as F

from weftline.sources import images


def test_headers(spark):
    heads = {
        "png": b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 70_000), "gif": b"GIF89a" + struct.pack("<HH", 12, 300), "bmp": b"BM" + bytes(16) + struct.pack("<II", 5, 6),
        "webp": b"RIFF\x00\x00\x00\x00WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (199).to_bytes(3, "little"), "short": b"GIF89a", "text": b"hello", "empty": b"",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "name string, head binary").select("name", images.probe(F.col("head")).alias("p"))
    found = {r["name"]: tuple(r["p"]) if r["p"] else None for r in df.collect()}
    assert found == {"png": (640, 70_000), "gif": (12, 300), "bmp": (5, 6), "webp": (100, 200), "short": None, "text": None, "empty": None}


def segment(kind, body):
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def test_metadata_goes_and_pixels_stay(spark):
    jfif, scan = segment(0xE0, b"JFIF"), b"\xff\xda\x00\x04ab\xff\xe1pixels\xff\xd9"
    data = b"\xff\xd8" + jfif + segment(0xE1, b"Exif") + segment(0xFE, b"note") + scan
    assert images.strip_jpeg(data) == (b"\xff\xd8" + jfif + scan, ["APP1", "COM"])
    with pytest.raises(ValueError):
        images.strip_jpeg(b"\xff\xd8\xff\xe1\xff\xffx")
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"x")), ("c", None)], "path string, content binary")
    assert {r["path"]: r["removed"] for r in images.strip_metadata(df).collect()} == {"a": ["APP1", "COM"], "b": None, "c": None}
