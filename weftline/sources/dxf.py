"""ASCII DXF drawings to paths: pairs of lines, entities, and curves flattened to points.

Reading is sequential within a drawing and curves are numpy, so both run on Arrow batches inside
tasks, a drawing and an entity at a time; neither needs a shuffle.

Reading stops at a code that is no integer. A null text, and one without an ENTITIES section, has no
entities. An entity that lacks a needed number, a polyline of one vertex and a spline without enough
knots give no path; numbers that are not finite are lacking. Types that are not drawn are counted by
``undrawn``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.batches import slices
from weftline.session import dealt, table

DRAWN = ("LINE", "CIRCLE", "ARC", "LWPOLYLINE", "SPLINE")
#: Segments of a full turn; bounds of the degree and of the steps of a spline.
TURN_SEGMENTS = 64
MOST_DEGREE, LEAST_STEPS, MOST_STEPS = 7, 16, 1024
TINY = 1e-12

_INTEGER = re.compile(r"[+-]?[0-9]{1,9}")


def pairs(text: str) -> Iterator[tuple[int, str]]:
    lines = iter(text.split("\n"))
    for code, value in zip(lines, lines, strict=False):
        if not _INTEGER.fullmatch(code.strip()):
            return
        yield int(code), value.strip()


def read(text: str) -> list[tuple[str, list[tuple[int, str]]]]:
    """``(kind, body)`` of each entity of a drawing."""
    found, before, inside = [], None, False
    for pair in pairs(text):
        if not inside:
            inside = before == (0, "SECTION") and pair == (2, "ENTITIES")
        elif pair == (0, "ENDSEC"):
            break
        elif pair[0] == 0:
            found.append((pair[1], []))
        elif found:
            found[-1][1].append(pair)
        before = pair
    return found


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, numbers, kinds, codes, values, ends = [], [], [], [], [], [0]
        for at, text in enumerate(batch["text"].to_pylist()):
            for number, (kind, body) in enumerate(read(text or "")):
                rows.append(at)
                numbers.append(number)
                kinds.append(kind)
                codes += [c for c, _ in body]
                values += [v for _, v in body]
                ends.append(len(codes))
        bodies = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(codes, pa.int32()), pa.array(values, pa.string())], names=["code", "value"]))
        yield pa.RecordBatch.from_arrays([batch["drawing"].take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string()), bodies], names=["drawing", "entity", "kind", "body"])


def entities(drawings: DataFrame) -> DataFrame:
    """``drawing, text`` to ``drawing, entity, kind, body``: a row per entity of the ENTITIES section."""
    key = drawings.schema["drawing"].dataType.simpleString()
    return drawings.select("drawing", "text").mapInArrow(_entities, f"drawing {key}, entity int, kind string, body array<struct<code:int,value:string>>")


def _number(value: str) -> float | None:
    try:
        found = float(value)
    except ValueError:
        return None
    return found if math.isfinite(found) else None


def sweep(centre: tuple[float, float], r: float, start: float, span: float) -> np.ndarray:
    """Points of an arc, both ends included; angles in radians."""
    steps = int(min(max(math.ceil(abs(span) / math.tau * TURN_SEGMENTS), 2), 4 * TURN_SEGMENTS))
    angles = start + span * (np.arange(steps + 1) / steps)
    return np.stack([centre[0] + r * np.cos(angles), centre[1] + r * np.sin(angles)], axis=1)


def bulged(a: np.ndarray, b: np.ndarray, bulge: float) -> np.ndarray:
    """Points strictly between two vertices; ``bulge`` is the tangent of a quarter of the arc's angle, and 0 a line."""
    dx, dy = b - a
    if abs(bulge) <= TINY or math.hypot(dx, dy) < TINY:
        return np.empty((0, 2))
    # The centre lies on the chord's normal, at (1 - bulge^2) / (4 bulge) chords from its middle.
    centre = (a + b) / 2 + np.array([-dy, dx]) * (1 - bulge * bulge) / (4 * bulge)
    away = a - centre
    return sweep(tuple(centre), math.hypot(*away), math.atan2(away[1], away[0]), 4 * math.atan(bulge))[1:-1]


def polyline(numbers: list[tuple[int, float]], closed: bool) -> np.ndarray | None:
    """A vertex per y that has an x before it; a bulge belongs to the vertex before it."""
    vertices, bulges, x = [], [], None
    for code, value in numbers:
        if code == 10:
            x = value
        elif code == 20 and x is not None:
            vertices.append((x, value))
            bulges.append(0.0)
            x = None
        elif code == 42 and bulges:
            bulges[-1] = value
    if len(vertices) < 2:
        return None
    at = np.array(vertices)
    runs = []
    for i, bulge in enumerate(bulges):
        runs.append(at[i : i + 1])
        if closed or i + 1 < len(at):
            runs.append(bulged(at[i], at[(i + 1) % len(at)], bulge))
    return np.concatenate(runs)


def spline(degree: int, knots: np.ndarray, weights: np.ndarray, control: np.ndarray) -> np.ndarray | None:
    """Points of a rational B-spline: weighted control points blended by the Cox-de Boor basis."""
    n = len(control)
    if n <= degree or len(knots) < n + degree + 1 or not knots[degree] < knots[n]:
        return None
    t = np.linspace(knots[degree], knots[n], min(max(8 * n, LEAST_STEPS), MOST_STEPS) + 1)
    t = np.minimum(t, np.nextafter(knots[n], -np.inf))
    span = np.clip(np.searchsorted(knots[: n + 1], t, side="right") - 1, degree, n - 1)
    basis = (np.arange(len(knots) - 1)[None, :] == span[:, None]).astype(float)
    for d in range(1, degree + 1):
        width = len(knots) - 1 - d
        rise, fall = knots[d : d + width] - knots[:width], knots[d + 1 : d + 1 + width] - knots[1 : 1 + width]
        up = np.divide(t[:, None] - knots[:width], rise, out=np.zeros((len(t), width)), where=np.abs(rise) > TINY)
        down = np.divide(knots[d + 1 : d + 1 + width] - t[:, None], fall, out=np.zeros((len(t), width)), where=np.abs(fall) > TINY)
        basis = up * basis[:, :width] + down * basis[:, 1 : width + 1]
    weights = np.concatenate([weights, np.ones(max(0, n - len(weights)))])[:n]
    mass = basis[:, :n] @ weights
    return basis[:, :n] @ (control * weights[:, None]) / np.where(np.abs(mass) < TINY, 1.0, mass)[:, None]


def path(kind: str, body: list[tuple[int, str]]) -> tuple[bool, np.ndarray | None]:
    """Whether an entity closes, and its points if it has what it needs."""
    first: dict[int, float | None] = {}
    numbers = []
    for code, text in body:
        value = _number(text)
        first.setdefault(code, value)
        if value is not None:
            numbers.append((code, value))
    every = lambda code: np.array([v for c, v in numbers if c == code])
    get = lambda code, otherwise: otherwise if first.get(code) is None else first[code]
    flag = int(get(70, 0.0)) & 1 == 1
    has = lambda *codes: all(first.get(c) is not None for c in codes)
    if kind == "LINE":
        return False, np.array([(first[10], first[20]), (first[11], first[21])]) if has(10, 20, 11, 21) else None
    if kind == "LWPOLYLINE":
        return flag, polyline(numbers, flag)
    if kind == "SPLINE":
        xs, ys = every(10), every(20)
        n = min(len(xs), len(ys))
        return flag, spline(int(min(max(get(71, 3.0), 1.0), MOST_DEGREE)), every(40), every(41), np.stack([xs[:n], ys[:n]], axis=1))
    if not has(10, 20, 40):
        return kind == "CIRCLE", None
    if kind == "CIRCLE":
        return True, sweep((first[10], first[20]), first[40], 0.0, math.tau)
    start, end = math.radians(get(50, 0.0)), math.radians(get(51, 360.0))
    # An arc runs counter-clockwise, so its end is never before its start.
    return False, sweep((first[10], first[20]), first[40], start, end - start if end >= start else (end - start) % math.tau)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        parts = batch["body"].flatten()
        pairs_, ends = list(zip(parts.field("code").to_pylist(), parts.field("value").to_pylist(), strict=True)), np.cumsum(batch["body"].value_lengths().to_numpy(zero_copy_only=False)).tolist()
        rows, closed, points = [], [], []
        for at, (kind, a, b) in enumerate(zip(batch["kind"].to_pylist(), [0, *ends], ends, strict=False)):
            closes, found = path(kind, pairs_[a:b])
            if found is not None:
                rows.append(at)
                closed.append(closes)
                points.append(found)
        xy = np.concatenate([np.empty((0, 2)), *points])
        borders = np.cumsum([0, *map(len, points)])
        lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], names=["x", "y"]))
        kept = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*[batch[c].take(kept) for c in ("drawing", "entity", "kind")], pa.array(closed, pa.bool_()), lists], names=["drawing", "entity", "kind", "closed", "points"])


def flattened(found: DataFrame) -> DataFrame:
    """Rows of ``entities`` to ``drawing, entity, kind, closed, points``."""
    key = found.schema["drawing"].dataType.simpleString()
    drawn = found.where(F.col("kind").isin(*DRAWN)).select("drawing", "entity", "kind", "body")
    return drawn.mapInArrow(_paths, f"drawing {key}, entity int, kind string, closed boolean, points array<struct<x:double,y:double>>")


def undrawn(found: DataFrame) -> DataFrame:
    """How many entities of each type that is not drawn a drawing has."""
    return found.where(~F.col("kind").isin(*DRAWN)).groupBy("drawing", "kind").agg(F.count("*").alias("n"))


def _plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing per part: a line, an arc, a bulged polyline, a circle and, for some, a text."""
    size, turn = "CAST(p_size AS STRING)", "CAST(p_partkey % 360 AS STRING)"
    lines = f"""concat_ws('\\n', '0', 'SECTION', '2', 'HEADER', '0', 'ENDSEC', '0', 'SECTION', '2', 'ENTITIES',
      '0', 'LINE', '10', '0', '20', '0', '11', {size}, '21', '2.5',
      '0', 'ARC', '10', '1', '20', '2', '40', {size}, '50', {turn}, '51', concat(CAST(p_partkey * 7 % 360 AS STRING), '.3'),
      IF(p_partkey % 3 = 0, '0\\nTEXT\\n1\\nplate', '0\\nCIRCLE\\n10\\n0\\n20\\n0\\n40\\n4'),
      '0', 'LWPOLYLINE', '70', CAST(p_partkey % 2 AS STRING), '10', '0', '20', '0', '42', '1', '10', {size}, '20', '0', '10', {size}, '20', '9', '0', 'ENDSEC', '0', 'EOF')"""
    return dealt(table(spark, sf_dir, "part"), 4096).selectExpr("p_partkey AS drawing", f"{lines} AS text")


def dxf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of each part's drawing: number of points, and the first and middle one."""
    at = lambda i, axis: (F.round(F.get("points", i)[axis], 4) + F.lit(0.0))
    middle = F.floor(F.size("points") / 2).cast("int")
    found = flattened(entities(_plates(spark, sf_dir)))
    return found.select("drawing", "entity", "kind", "closed", F.size("points").alias("n"), at(F.lit(0), "x").alias("x0"), at(F.lit(0), "y").alias("y0"), at(middle, "x").alias("xm"), at(middle, "y").alias("ym"))


def dxf_undrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return undrawn(entities(_plates(spark, sf_dir)))


# A half circle below the chord, in 32 steps: its middle point of the whole path is the 18th (open: 34 points).
QUERIES = {"dxf_paths": dxf_paths, "dxf_undrawn": dxf_undrawn}
ORACLES = {
    "dxf_paths": f"""
WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS s, radians((p_partkey % 360)::DOUBLE) AS f, radians(p_partkey * 7 % 360 + 0.3::DOUBLE) AS e FROM part),
a AS (SELECT k, s, f, CASE WHEN e < f THEN e - f + 2 * pi() ELSE e - f END AS w FROM p),
n AS (SELECT *, greatest(ceil(w / (2 * pi()) * {TURN_SEGMENTS}), 2)::INTEGER AS c FROM a),
r AS (
SELECT k AS drawing, 0 AS entity, 'LINE' AS kind, false AS closed, 2 AS n, 0.0 AS x0, 0.0 AS y0, s AS xm, 2.5 AS ym FROM n
UNION ALL SELECT k, 1, 'ARC', false, c + 1, 1 + s * cos(f), 2 + s * sin(f), 1 + s * cos(f + w * (((c + 1) // 2) / c::DOUBLE)), 2 + s * sin(f + w * (((c + 1) // 2) / c::DOUBLE)) FROM n
UNION ALL SELECT k, 2, 'CIRCLE', true, {TURN_SEGMENTS} + 1, 4, 0, -4, 0 FROM n WHERE k % 3 <> 0
UNION ALL SELECT k, 3, 'LWPOLYLINE', k % 2 = 1, 34, 0, 0, s / 2 + s / 2 * cos(pi() + pi() * 17 / 32), s / 2 * sin(pi() + pi() * 17 / 32) FROM n)
SELECT drawing, entity::INTEGER AS entity, kind, closed, n::INTEGER AS n, round(x0, 4) + 0.0 AS x0, round(y0, 4) + 0.0 AS y0, round(xm, 4) + 0.0 AS xm, round(ym, 4) + 0.0 AS ym FROM r""",
    "dxf_undrawn": "SELECT p_partkey AS drawing, 'TEXT' AS kind, 1::BIGINT AS n FROM part WHERE p_partkey % 3 = 0",
}
