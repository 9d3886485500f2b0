"""Zones and grid cells against literal ray casting, on outlines of any kind and length."""

import math
import random

import numpy as np
import pytest

from fieldspark.operators import spatial

PARTS = "array<array<array<struct<x:double,y:double>>>>"


def crossings(x, y, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y):
                n += x < (bx - ax) * (y - ay) / (by - ay) + ax
    return n


def touches(edge, x0, y0, x1, y1):
    (ax, ay), (bx, by) = edge
    low, high = 0.0, 1.0
    for a, b, lo, hi in ((ax, bx, x0, x1), (ay, by, y0, y1)):
        if a == b:
            if not lo <= a <= hi:
                return False
            continue
        t0, t1 = sorted(((lo - a) / (b - a), (hi - a) / (b - a)))
        low, high = max(low, t0), min(high, t1)
    return low <= high


def shapes(seed, scale):
    """Zones of several parts with holes, long edges, corners on tile borders, and one that crosses itself."""
    rng = random.Random(seed)
    corner = lambda: (rng.choice([rng.uniform(-scale, scale), float(rng.randint(-3, 3) * scale / 4)]), rng.uniform(-scale, scale))
    zones = []
    for zone in range(12):
        parts = []
        for _ in range(rng.randint(1, 3)):
            cx, cy = corner()
            size = rng.uniform(0.02, 1.2) * scale
            n = rng.randint(3, 40)
            angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
            ring = [(cx + size * rng.uniform(0.4, 1) * math.cos(t), cy + size * rng.uniform(0.4, 1) * math.sin(t)) for t in angles]
            hole = [(cx + 0.2 * size * math.cos(t), cy + 0.2 * size * math.sin(t)) for t in angles]
            parts.append([ring, hole] if zone % 2 else [ring])
        zones.append((zone, parts))
    box = float(scale / 2)
    zones.append((20, [[[(0.0, 0.0), (box, 0.0), (box, box), (0.0, box), (0.0, 0.0)]]]))
    zones.append((21, [[[corner() for _ in range(9)]]]))
    return zones


def frame(spark, zones):
    rows = [(z, [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]) for z, parts in zones]
    return spark.createDataFrame(rows, f"zone_id bigint, parts {PARTS}")


@pytest.mark.parametrize("tile,rows", [(5.0, 16), (2.5, 1), (40.0, 3), (0.7, 2)])
def test_zone_of_point_everywhere(spark, tile, rows):
    zones = shapes(1, 10)
    rng = random.Random(2)
    points = [(rng.uniform(-14, 14), rng.uniform(-14, 14)) for _ in range(700)]
    points += [v for _, parts in zones for part in parts for ring in part for v in ring]
    points += [(tile * i, tile * j / rows) for i in range(-3, 4) for j in range(-6, 7)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id int, lon double, lat double")
    got = {r["id"]: r["zone_id"] for r in spatial.zone_of_point(df, frame(spark, zones), "id", tile, -1, rows).collect()}
    for i, (x, y) in enumerate(points):
        inside = [z for z, parts in zones if crossings(x, y, [r for p in parts for r in p]) % 2]
        assert got[i] == min(inside, default=-1), (x, y)


@pytest.mark.parametrize("size", [1.0, 5.0, 0.6])
def test_cover_grid_everywhere(spark, size):
    zones = shapes(3, 8)
    got = {(r["zone_id"], r["cell_x"], r["cell_y"]) for r in spatial.cover_grid(frame(spark, zones), size).collect()}
    want = set()
    for z, parts in zones:
        rings = [r for p in parts for r in p]
        edges = [e for r in rings for e in zip(r, r[1:] + r[:1])]
        xs, ys = [math.floor(v[0] / size) for r in rings for v in r], [math.floor(v[1] / size) for r in rings for v in r]
        for cx in range(min(xs), max(xs) + 1):
            for cy in range(min(ys), max(ys) + 1):
                x, y = cx * size, cy * size
                if any(touches(e, x, y, x + size, y + size) for e in edges) or crossings(x, y, rings) % 2:
                    want.add((z, cx, cy))
    assert got == want


def long_outline(n):
    angles = np.linspace(0, 2 * math.pi, n, endpoint=False)
    radius = 30 + 3 * np.sin(angles * 911) + np.sin(angles * 7)
    return list(zip((radius * np.cos(angles)).tolist(), (radius * np.sin(angles)).tolist()))


def test_outline_of_a_hundred_thousand_corners(spark):
    ring = long_outline(100_000)
    zones = frame(spark, [(1, [[ring]])])
    rng = random.Random(4)
    points = [(40 * math.sqrt(rng.random()), rng.uniform(0, 2 * math.pi)) for _ in range(3000)]
    points = [(r * math.cos(t), r * math.sin(t)) for r, t in points]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id int, lon double, lat double")
    found = {r["id"]: r["zone_id"] for r in spatial.zone_of_point(df, zones, "id").collect()}
    edge = np.array(ring)
    ax, ay = edge[:, 0], edge[:, 1]
    bx, by = np.roll(ax, -1), np.roll(ay, -1)
    for i, (x, y) in enumerate(points):
        spans = (ay > y) != (by > y)
        at = (bx[spans] - ax[spans]) * (y - ay[spans]) / (by[spans] - ay[spans]) + ax[spans]
        assert found[i] == (1 if (x < at).sum() % 2 else -1)
    # a candidate carries a small part of the outline, and tiles inside carry none
    index = spatial.tile_edge_index(zones, 5.0, 5.0 / 16)
    most, bare = index.selectExpr("max(size(edges))", "count_if(size(edges) = 0 and odd = 1)").first()
    assert most < 10_000 and bare > 100


def test_zone_plan(spark):
    """No edges are exploded behind the join, and only the exchange by point follows it."""
    zones = frame(spark, shapes(1, 10))
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id int, lon double, lat double")
    plan = spatial.zone_of_point(points, zones, "id")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert above.count("Exchange") == 1 and "Generate" not in above


def test_overlapping_zones_stay_off_the_driver(spark):
    """A tile lists no zone above the lowest that holds all of it, and the index is never broadcast."""
    squares = [(z, [[[(-h, -h), (h, -h), (h, h), (-h, h)]]]) for z in range(120) for h in (20.0 + z % 7,)]
    zones = frame(spark, squares)
    index = spatial.tile_edge_index(zones, 5.0, 5.0)
    listed = lambda df, tx: df.where(f"tx = {tx} and ty = 0").count()
    assert [listed(index, 0), listed(index, 4)] == [120, 120]
    assert [listed(spatial._up_to_whole(index), tx) for tx in (0, 4)] == [1, 6]
    rng = random.Random(5)
    places = [(rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(500)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "id int, lon double, lat double")
    found = spatial.zone_of_point(points, zones, "id")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["zone_id"] for r in found.collect()}
    for i, (x, y) in enumerate(places):
        assert got[i] == next((z for z in range(7) if max(abs(x), abs(y)) < 20 + z), -1)


def test_slope_exchanges_values_uncombined(spark):
    """No aggregation fills a task's memory between a cell and the exchange to its neighbours."""
    dem = spark.createDataFrame([(x, y, float(x * y)) for x in range(4) for y in range(4)], "gx int, gy int, z double")
    got = spatial.slope(dem, 1.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Aggregate" not in plan[plan.index("Exchange") : plan.index("Generate")]
    inner = {(r["gx"], r["gy"]): r["slope"] for r in got.collect() if r["slope"] is not None}
    assert inner == {(x, y): pytest.approx(math.degrees(math.atan(math.hypot(x, y)))) for x in (1, 2) for y in (1, 2)}
