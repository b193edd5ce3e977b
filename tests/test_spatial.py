import math
import random

import numpy as np
import pytest

from lexanchor.operators.spatial import VantagePointTree, angles, cells_of, containing_regions, haversine_km, place_points, radius_pairs, unit_vectors, valid_points
from tests.conftest import rows

SCHEMA = "geonameid string, lat double, lon double, a string, home boolean"


def brute(points, radius):
    out = set()
    for i, x, y in points:
        for j, u, v in points:
            if i < j and float(haversine_km(x, y, u, v)) < radius:
                out.add((i, j))
    return sorted(out)


def make(n, seed=1):
    rng = random.Random(seed)
    centres = [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(6)] + [(89.99, 10.0), (0.5, 179.99), (-0.5, -179.99)]
    out = []
    for k in range(n):
        la, lo = rng.choice(centres)
        la = max(-90.0, min(90.0, la + rng.gauss(0, 0.05)))
        lo = (lo + rng.gauss(0, 0.05) + 180) % 360 - 180
        out.append((f"{k:05d}", la, lo))
    return out


@pytest.mark.parametrize("settings", [{}, {"points_per_pivot": 20}, {"points_per_pivot": 50, "max_cell": 15}, {"max_cell": 7}])
def test_pairs_equal_brute_force(spark, settings):
    points = make(300)
    df = spark.createDataFrame([(i, x, y, "x", True) for i, x, y in points], SCHEMA)
    got = rows(radius_pairs(df, "geonameid", "lat", "lon", 5.0, **settings))
    assert got == brute(points, 5.0)


def test_hot_spot_of_a_third_of_all_rows(spark):
    points = [(f"{k:04d}", 10.0, 20.0) for k in range(60)] + make(120, 3)[60:]
    df = spark.createDataFrame([(i, x, y, "x", True) for i, x, y in points], SCHEMA)
    assert rows(radius_pairs(df, "geonameid", "lat", "lon", 5.0, max_cell=10)) == brute(points, 5.0)


def test_unusable_coordinates_repeats_and_empty(spark):
    bad = [("a", None, 1.0), ("b", math.nan, 1.0), ("c", math.inf, 1.0), ("d", 91.0, 1.0), ("e", 1.0, -181.0), ("f", 0.0, 0.0), ("g", 0.0, 0.0), (None, 1.0, 1.0)]
    good = [("h", 1.0, 1.0), ("h", 1.0, 1.0), ("i", 1.0, 1.0), ("j", 1.0, 2.0)]
    df = spark.createDataFrame([(*p, None, None) for p in bad + good], SCHEMA)
    assert rows(radius_pairs(df, "geonameid", "lat", "lon", 5.0)) == [("h", "i")]
    assert rows(radius_pairs(df.limit(0), "geonameid", "lat", "lon", 5.0)) == []


def test_tree_is_complete():
    rng = np.random.default_rng(0)
    xyz = unit_vectors(rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400))
    xyz[50:120] = xyz[0]
    q, m = VantagePointTree(xyz).within(xyz, 0.3)
    want = angles(xyz[:, None, :], xyz[None, :, :]) <= 0.3
    assert sorted(zip(q.tolist(), m.tolist())) == sorted(zip(*map(list, np.nonzero(want))))


def test_crowded_cells_get_pivots_of_their_own(spark):
    points = make(500, 7) + [(f"x{k}", 50.0 + k / 1e5, 3.0) for k in range(80)]
    df = spark.createDataFrame([(i, x, y, "x", True) for i, x, y in points], SCHEMA)
    usable = valid_points(df, "geonameid", "lat", "lon")
    placed = place_points(usable, len(points), 2 * 5.0 / 6371.0, 20, 3, 40)
    cells = {r.cell for r in placed.select("cell").collect()}
    assert any("/" in c for c in cells) and any(c.endswith("!") for c in cells)
    assert placed.where("home").count() == len(points)
    got = rows(radius_pairs(df, "geonameid", "lat", "lon", 5.0, points_per_pivot=20, max_pivots=3, max_cell=40))
    assert got == brute(points, 5.0)


def test_nearest_pivot():
    rng = np.random.default_rng(3)
    pivots = unit_vectors(rng.uniform(-90, 90, 700), rng.uniform(-180, 180, 700))
    asked = unit_vectors(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300))
    every = angles(asked[:, None, :], pivots[None, :, :])
    assert np.allclose(VantagePointTree(pivots).nearest(asked), every.min(axis=1))
    row, cell, home = cells_of(VantagePointTree(pivots), asked, 0.05)
    assert (cell[home] == every.argmin(axis=1)).all()
    assert len(row) == (every <= every.min(axis=1)[:, None] + 0.05).sum()


def in_polygon(x, y, xs, ys):
    """Winding number, with the border tested by itself."""
    n, wound = len(xs), 0
    for k in range(n):
        x1, y1, x2, y2 = xs[k], ys[k], xs[(k + 1) % n], ys[(k + 1) % n]
        side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if y1 <= y < y2 and side > 0:
            wound += 1
        elif y2 <= y < y1 and side < 0:
            wound -= 1
    return wound != 0


@pytest.mark.parametrize("settings", [{}, {"points_per_pivot": 20}, {"points_per_pivot": 10, "max_pivots": 9, "max_cell": 20}])
def test_regions_equal_brute_force(spark, settings):
    points = make(300, 5) + [("corner", 10.0, 20.0), ("edge", 10.5, 20.0)]
    rng = random.Random(1)
    shapes = [("square", [10.0, 10.0, 11.0, 11.0], [20.0, 21.0, 21.0, 20.0]), ("wide", [-80.0, -80.0, 85.0, 85.0], [-170.0, 175.0, 175.0, -170.0])]
    for k in range(40):
        _, la, lo = rng.choice(points)
        star = [(rng.uniform(0.01, 1.5), 2 * math.pi * i / 7) for i in range(7)]
        shapes.append((f"r{k}", [la + r * math.sin(t) for r, t in star], [lo + r * math.cos(t) for r, t in star]))
    want = sorted((i, name) for i, x, y in points for name, ys, xs in shapes if in_polygon(y, x, xs, ys))
    assert ("corner", "square") in want and ("edge", "square") in want and len(want) > 400
    odd = [("short", [1.0, 2.0], [1.0, 2.0]), ("null", [1.0, None, 2.0], [1.0, 2.0, 3.0]), ("uneven", [1.0, 2.0, 3.0], [1.0, 2.0]), ("none", None, None), (None, [0.0, 0.0, 9.0], [0.0, 9.0, 0.0])]
    regions = spark.createDataFrame([*shapes, *odd, shapes[0]], "region string, lats array<double>, lons array<double>")
    df = spark.createDataFrame([(i, x, y, "x", True) for i, x, y in points + points[:5]], SCHEMA)
    assert rows(containing_regions(df, "geonameid", "lat", "lon", regions, **settings)) == want
    assert rows(containing_regions(df.limit(0), "geonameid", "lat", "lon", regions)) == []
    assert rows(containing_regions(df, "geonameid", "lat", "lon", regions.limit(0))) == []
