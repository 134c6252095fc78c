import math
import random

import pytest

from weftline.operators import masks

SCHEMA = "image int, ord int, restore boolean, radius double, points array<struct<x: double, y: double>>"


def every_pair(strokes, w, h):
    """Each pixel against each stamp of each stroke in turn."""
    out = {}
    for _, restore, radius, points in sorted(strokes):
        r = max(radius * min(w, h), 1.0)
        for i, (bx, by) in enumerate(points):
            ax, ay = points[max(i - 1, 0)]
            dx, dy = (bx - ax) * w, (by - ay) * h
            steps = max(math.ceil(math.hypot(dx, dy) / (r * 0.5)), 1)
            for k in range(steps + 1):
                x, y = ax * w + dx * k / steps, ay * h + dy * k / steps
                for px in range(w):
                    for py in range(h):
                        if math.hypot(px + 0.5 - x, py + 0.5 - y) <= r:
                            out[px, py] = restore
    return out


def test_strokes_against_every_pair(spark):
    rng = random.Random(2)
    images = {i: [(k, rng.random() < 0.5, rng.uniform(0.001, 0.2), [(rng.choice([0.0, 1.0, rng.random()]), rng.random()) for _ in range(rng.randint(0, 4))]) for k in range(rng.randint(0, 5))] for i in range(6)}
    sizes = {i: (rng.randint(1, 50), rng.randint(1, 50)) for i in images}
    strokes = spark.createDataFrame([(i, *s) for i, ss in images.items() for s in ss], SCHEMA)
    found = masks.masked(strokes, spark.createDataFrame([(i, *s) for i, s in sizes.items()], "image int, w int, h int"), tile=8)
    got = {}
    for r in found.collect():
        got.setdefault(r["image"], {})[r["px"], r["py"]] = r["restore"]
    assert got == {i: e for i, ss in images.items() if (e := every_pair(ss, *sizes[i]))}


def test_restore_then_erase(spark):
    strokes = spark.createDataFrame([(1, 0, True, 0.1, [(0.5, 0.5)]), (1, 1, False, 0.05, [(0.5, 0.5)])], SCHEMA)
    changes = masks.masked(strokes, spark.createDataFrame([(1, 20, 20)], "image int, w int, h int"))
    pixels = spark.createDataFrame([(1, x, y, 0, 255) for x, y in ((10, 10), (11, 10), (0, 0))], "image int, px int, py int, alpha int, source_alpha int")
    assert {(r["px"], r["py"]): r["alpha"] for r in masks.painted(pixels, changes).collect()} == {(10, 10): 0, (11, 10): 255, (0, 0): 0}


@pytest.mark.parametrize("radius,point,why", [(2.0, (0.5, 0.5), "invalid brush"), (0.1, (1.5, 0.5), "invalid brush"), (float("nan"), (0.5, 0.5), "invalid brush"), (0.1, (0.5, float("nan")), "invalid brush")])
def test_bad_brushes_are_refused(spark, radius, point, why):
    with pytest.raises(Exception, match=why):
        masks.checked(spark.createDataFrame([(1, 0, True, radius, [point])], SCHEMA)).collect()


def test_too_many_points_are_refused(spark):
    with pytest.raises(Exception, match="too many"):
        masks.checked(spark.createDataFrame([(1, k, True, 0.1, []) for k in range(501)], SCHEMA)).collect()
