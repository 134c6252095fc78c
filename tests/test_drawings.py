import math

import numpy as np
import pytest

from weftline.sources import dxf


def drawing(*entities, head="0\nSECTION\n2\nENTITIES", tail="0\nENDSEC\n0\nEOF"):
    return "\n".join([head, *("\n".join(str(x) for x in e) for e in entities), tail])


def paths(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "drawing long, text string")
    found = dxf.flattened(dxf.entities(rows)).collect()
    return {(r["drawing"], r["entity"]): (r["kind"], r["closed"], np.array([(p["x"], p["y"]) for p in r["points"]])) for r in found}


def test_lines_circles_and_arcs_over_zero_degrees(spark):
    found = paths(spark, drawing((0, "LINE", 10, 1, 20, 2, 11, 3, 21, 4), (0, "CIRCLE", 10, 5, 20, 6, 40, 2), (0, "ARC", 10, 0, 20, 0, 40, 1, 50, 350, 51, 10)))
    kind, closed, points = found[0, 0]
    assert (kind, closed, points.tolist()) == ("LINE", False, [[1, 2], [3, 4]])
    _, closed, points = found[0, 1]
    assert closed and len(points) == 65 and np.allclose(np.hypot(*(points - (5, 6)).T), 2)
    _, closed, points = found[0, 2]
    angles = np.unwrap(np.arctan2(points[:, 1], points[:, 0]))
    assert not closed and angles[-1] - angles[0] == pytest.approx(math.radians(20)) and len(points) == math.ceil(20 / 360 * 64) + 1


@pytest.mark.parametrize("bulge", [1.0, -1.0, 0.3, -2.5])
def test_a_bulge_is_the_tangent_of_a_quarter_of_its_angle(spark, bulge):
    found = paths(spark, drawing((0, "LWPOLYLINE", 70, 1, 10, 0, 20, 0, 42, bulge, 10, 2, 20, 1, 10, 5, 20, 5)))
    _, closed, points = found[0, 0]
    theta = 4 * math.atan(bulge)
    steps = max(2, math.ceil(abs(theta) / math.tau * 64))
    assert closed and len(points) == 3 + steps - 1 and points[-2:].tolist() == [[2, 1], [5, 5]]
    radius = math.hypot(2, 1) / (2 * math.sin(abs(theta) / 2))
    chords = np.hypot(*np.diff(points[: steps + 1], axis=0).T)
    assert np.allclose(chords, 2 * radius * math.sin(abs(theta) / steps / 2))
    # Turning left is positive: the arc bulges to the right of the chord.
    side = 2 * points[1:steps, 1] - points[1:steps, 0]
    assert (np.sign(side) == -np.sign(bulge)).all()


def test_splines_are_curves_with_weights(spark):
    quarter = (0, "SPLINE", 71, 2, *(x for k in (0, 0, 0, 1, 1, 1) for x in (40, k)), 41, 1, 41, math.sqrt(0.5), 41, 1, 10, 1, 20, 0, 10, 1, 20, 1, 10, 0, 20, 1)
    control = np.array([(0, 0), (1, 3), (4, -2), (5, 1)], float)
    bezier = (0, "SPLINE", 71, 3, *(x for k in (0, 0, 0, 0, 1, 1, 1, 1) for x in (40, k)), *(x for p in control.tolist() for x in (10, p[0], 20, p[1])))
    short = (0, "SPLINE", 71, 3, 40, 0, 40, 1, 10, 0, 20, 0)
    found = paths(spark, drawing(quarter, bezier, short))
    assert set(found) == {(0, 0), (0, 1)}
    assert np.allclose(np.hypot(*found[0, 0][2].T), 1) and np.allclose(found[0, 0][2][[0, -1]], [(1, 0), (0, 1)])
    t = np.linspace(0, 1, 33)[:, None]
    bernstein = sum(math.comb(3, i) * t**i * (1 - t) ** (3 - i) * control[i] for i in range(4))
    assert np.allclose(found[0, 1][2], bernstein)


def test_what_gives_no_path(spark):
    lacking = (0, "LINE", 10, 1, 20, 2, 11, 3)
    single = (0, "LWPOLYLINE", 10, 1, 20, 1)
    good = (0, "LINE", 10, 1, 20, 2, 11, 3, 21, 4)
    texts = ["", "x", drawing(good, head="0\nSECTION\n2\nBLOCKS"), drawing(lacking, single), drawing(good, ("zero", "LINE"), good), drawing(), None]
    assert set(paths(spark, *texts)) == {(4, 0)}
    after = paths(spark, drawing(good) + "\n0\nLINE\n10\n9\n20\n9\n11\n9\n21\n9")
    assert set(after) == {(0, 0)}


def test_a_vertex_takes_its_own_bulge_and_x(spark):
    found = paths(spark, drawing((0, "LWPOLYLINE", 42, 7, 10, 8, 10, 0, 20, 0, 20, 5, 10, 1, 20, 0, 10, 1, 20, 3)))
    assert found[0, 0][2].tolist() == [[0, 0], [1, 0], [1, 3]]


def test_undrawn_types_are_counted(spark):
    text = drawing((0, "TEXT", 1, "a"), (0, "HATCH", 2, "b"), (0, "TEXT", 1, "c"), (0, "LINE", 10, 1))
    rows = dxf.undrawn(dxf.entities(spark.createDataFrame([(1, text)], "drawing long, text string"))).collect()
    assert sorted((r["kind"], r["n"]) for r in rows) == [("HATCH", 1), ("TEXT", 2)]
