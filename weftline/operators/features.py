"""Features for models: log-mel spectra of sound, boxes of masks, best classes, probabilities.

A spectrum needs a Fourier transform and a box needs labels that spread over a whole mask, so both
are numpy inside tasks, over one bounded window or mask at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import dealt, table

# Fixed values of the speech model's input: rate, transform, hop, bands, seconds of a window.
RATE, SIZE, HOP, BANDS, SECONDS = 16_000, 400, 160, 80, 30
FRAMES = SECONDS * RATE // HOP


def mel_filters() -> np.ndarray:
    """``BANDS`` triangles over the transform's bins, equal in area: even steps below 1 kHz, even ratios above."""
    corner = 15.0  # the mel number of 1 kHz, at 200/3 Hz a mel
    ratio = np.log(6.4) / 27
    top = corner + np.log(RATE / 2 / 1000) / ratio
    mels = np.linspace(0.0, top, BANDS + 2)
    edges = np.where(mels < corner, mels * 200 / 3, 1000 * np.exp((mels - corner) * ratio))
    bins = np.arange(SIZE // 2 + 1) * RATE / SIZE
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)), 0, None) * 2 / (high - low)


def mel_of(samples: np.ndarray, filters: np.ndarray, frames: int = FRAMES) -> np.ndarray:
    """The first ``frames`` of ``FRAMES`` rows of ``BANDS`` values of one window of mono sound; what is missing of it is silence."""
    x = np.asarray(samples, float)[: SECONDS * RATE]
    half = SIZE // 2
    if len(x):
        ahead = x[np.minimum(np.arange(half, 0, -1), len(x) - 1)]
        behind = x[np.maximum(len(x) - 1 - np.arange(1, half + 1), 0)]
        x = np.concatenate([ahead, x, behind])
    # A frame that begins behind the sound has no power, and needs no transform.
    heard = min(FRAMES, -(-len(x) // HOP))
    x = np.pad(x, (0, max(0, heard * HOP + SIZE - len(x))))
    heard_frames = np.lib.stride_tricks.sliding_window_view(x, SIZE)[: heard * HOP : HOP]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / SIZE)
    power = np.abs(np.fft.rfft(heard_frames * window)) ** 2
    logs = np.full((FRAMES, BANDS), -10.0)
    logs[:heard] = np.log10(np.maximum(power @ filters.T, 1e-10))
    return (np.maximum(logs[:frames], logs.max() - 8) + 4) / 4


def log_mel(windows: DataFrame, frames: int = FRAMES) -> DataFrame:
    """``id, xs`` (mono sound of up to 30 seconds) to ``id, frame, mel``; null counts as silence. ``frames``: hand on only the first."""

    def _mels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = mel_filters()
        numbers = pa.array(range(frames), pa.int32())
        for batch in batches:
            for key, samples in zip(batch["id"].to_pylist(), batch["xs"], strict=True):
                sound = np.empty(0) if not samples.is_valid else np.where(samples.values.is_null().to_numpy(zero_copy_only=False), np.nan, samples.values.to_numpy(zero_copy_only=False))
                found = mel_of(sound, filters, frames)
                values = pa.ListArray.from_arrays(pa.array(range(0, frames * BANDS + 1, BANDS), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([key] * frames, pa.int64()), numbers, values], names=["id", "frame", "mel"])

    return windows.select(F.col("id").cast("long").alias("id"), F.col("xs").cast("array<double>").alias("xs")).mapInArrow(_mels, "id long, frame int, mel array<double>")


def boxes_of(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``x0, y0, x1, y1`` of each part whose cells touch by a side, in order of its first cell.

    Every row is cut into runs; a run joins the parts of the runs above that it overlaps.
    """
    parent: list[int] = []
    box: list[list[int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        steps = np.diff(np.concatenate([[0], (row != 0).astype(np.int8), [0]]))
        runs, at = [], 0
        for a, b in zip(np.flatnonzero(steps == 1).tolist(), (np.flatnonzero(steps == -1) - 1).tolist(), strict=True):
            part = len(parent)
            parent.append(part)
            box.append([a, y, b, y])
            while at < len(above) and above[at][1] < a:
                at += 1
            k = at
            while k < len(above) and above[k][0] <= b:
                one, other = sorted((root(above[k][2]), root(part)))
                if one != other:
                    parent[other] = one
                    p, q = box[one], box[other]
                    box[one] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]
                k += 1
            runs.append((a, b, part))
        above = runs
    return [tuple(box[i]) for i in range(len(parent)) if parent[i] == i]


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "part", "x0", "y0", "x1", "y1"]
    for batch in batches:
        rows = []
        for key, width, data in zip(batch["id"].to_pylist(), batch["width"].to_pylist(), batch["mask"].to_pylist(), strict=True):
            if data and width and width > 0 and len(data) % width == 0:
                rows += [(key, i, *b) for i, b in enumerate(boxes_of(np.frombuffer(data, np.uint8).reshape(-1, width)))]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "id" else pa.int32()) for n, c in zip(names, columns, strict=True)], names=names)


def mask_boxes(masks: DataFrame) -> DataFrame:
    """``id, width, mask`` (a byte a cell, row by row) to ``id, part, x0, y0, x1, y1``; a mask of another size has none."""
    return masks.select(F.col("id").cast("long").alias("id"), F.col("width").cast("int").alias("width"), F.col("mask").cast("binary").alias("mask")).mapInArrow(_boxes, "id long, part int, x0 int, y0 int, x1 int, y1 int")


def argmax(xs: Column) -> Column:
    """The place of the largest value, from 0; the first of equals; null for an empty array."""
    return F.when(F.size(xs) > 0, F.array_position(xs, F.array_max(xs)).cast("int") - 1)


def probability(x: Column) -> Column:
    """A value from 0 to 1 as it is, any other as a logit."""
    return F.when(x.between(0, 1), x).otherwise(1 / (1 + F.exp(-x)))


# -- queries ---------------------------------------------------------------------------------


def best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", argmax(xs).alias("best"), F.round(probability(F.array_max(xs) * 3 - 1), 9).alias("p"))


def mel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as sound: its values, repeated for a tenth of a second, and the sums of the first ten frames."""
    sound = dealt(table(spark, sf_dir, "embeddings"), 1024).select(F.col("vec_id").alias("id"), F.slice(F.flatten(F.array_repeat("embedding", 200)), 1, RATE // 10).alias("xs"))
    return log_mel(sound, 10).select("id", "frame", F.round(F.aggregate("mel", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def embedding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a mask of eight cells a row, set where positive."""
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "01").otherwise("00")), "")
    return mask_boxes(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.unhex(bits).alias("mask")))


QUERIES = {"best_class": best_class, "mel_frames": mel_frames, "embedding_boxes": embedding_boxes}
ORACLES = {
    "best_class": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS xs FROM embeddings), m AS (SELECT vec_id, xs, list_max(xs) AS top FROM v)
SELECT vec_id, (list_position(xs, top) - 1)::INTEGER AS best, round(CASE WHEN top * 3 - 1 BETWEEN 0 AND 1 THEN top * 3 - 1 ELSE 1 / (1 + exp(-(top * 3 - 1))) END, 9) AS p FROM m""",
    "embedding_boxes": """
WITH RECURSIVE v AS (SELECT vec_id AS id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
c AS (SELECT id, i, i % 8 AS x, i // 8 AS y FROM v WHERE v.x > 0),
e AS (SELECT a.id, a.i, b.i AS j FROM c a JOIN c b ON a.id = b.id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
r AS (SELECT id, i, i AS s FROM c UNION SELECT r.id, e.j, r.s FROM r JOIN e ON e.id = r.id AND e.i = r.i),
g AS (SELECT id, i, min(s) AS s FROM r GROUP BY id, i)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::INTEGER AS part, x0::INTEGER AS x0, y0::INTEGER AS y0, x1::INTEGER AS x1, y1::INTEGER AS y1
FROM (SELECT g.id, g.s, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM g JOIN c ON c.id = g.id AND c.i = g.i GROUP BY g.id, g.s)""",
}
