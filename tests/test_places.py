"""Points in areas and labels in texts against loops over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusstat.operators import places, profiles


def slow_place(points, areas, near):
    """By all edges of all areas."""
    out = {}
    for key, x, y in points:
        if x is None or y is None or not np.isfinite([x, y]).all():
            out[key] = (None, "unplaced")
            continue
        inside, gaps = [], []
        for name, rings in sorted(areas):
            odd, gap = False, np.inf
            for ring in rings:
                for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                    if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                        odd = not odd
                    u = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / max((bx - ax) ** 2 + (by - ay) ** 2, 1e-300)))
                    gap = min(gap, np.hypot(x - ax - u * (bx - ax), y - ay - u * (by - ay)))
            if odd:
                inside.append(name)
            gaps.append((gap, name))
        best = min(gaps, default=(np.inf, None))
        out[key] = (inside[0], "inside") if inside else (best[1], "nearest") if best[0] <= near else (None, "unplaced")
    return out


def made(seed=1):
    r = random.Random(seed)
    areas = []
    for i in range(14):
        mx, my, n = r.uniform(-4, 4), r.uniform(40, 46), r.randint(3, 60)
        size = r.choice([0.05, 0.4, 1.5])
        ring = [[mx + size * r.uniform(0.3, 1) * np.cos(2 * np.pi * k / n), my + size * r.uniform(0.3, 1) * np.sin(2 * np.pi * k / n)] for k in range(n)]
        rings = [ring, [[mx + 0.2 * size * a, my + 0.2 * size * b] for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1))]]
        areas.append((f"a{i:02d}", [[list(map(float, p)) for p in q] for q in rings]))
    areas.append(("square", [[[0.0, 41.0], [3.0, 41.0], [3.0, 42.5], [0.0, 42.5], [0.0, 41.0]]]))  # sides on the grid's lines
    points = [(i, r.uniform(-6, 6), r.uniform(38, 48)) for i in range(1500)]
    points += [(2000 + i, r.choice([0.0, 0.15, 1.5, 3.0, 2.9999]), r.choice([41.0, 42.5, 41.25, 42.0])) for i in range(30)]
    points += [(3000, None, 41.0), (3001, float("nan"), 41.0), (3002, float("inf"), 41.0), (3003, 1e300, -1e300), (3004, 0.5, 41.5)]
    return areas, points


@pytest.mark.parametrize("near", [0.15, 0.02, 2.0])
def test_areas_by_cells(spark, near):
    areas, points = made()
    table = spark.createDataFrame(areas, "id string, rings array<array<array<double>>>")
    rows = spark.createDataFrame([(*p, 1, 2, "a") for p in points], "key int, x double, y double, cx int, edges int, area string")
    got = {r.key: (r.area, r.method) for r in places.inside_areas(rows, table, "key", "x", "y", near).collect()}
    want = slow_place(points, areas, near)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert {"inside", "nearest", "unplaced"} == {m for _, m in got.values()}


def test_points_on_edges(spark):
    """Points on an edge, or a rounding step beside it, lie where x < (bx - ax) * (y - ay) / (by - ay) + ax puts them."""
    areas, _ = made(3)
    r, points = random.Random(4), []
    edges = [(a, b) for _, rings in areas for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]) if a[1] != b[1]]
    for i in range(1200):
        (ax, ay), (bx, by) = r.choice(edges)
        y = ay + r.random() * (by - ay)
        x = (bx - ax) * (y - ay) / (by - ay) + ax
        points.append((i, r.choice([x, np.nextafter(x, -99.0), np.nextafter(x, 99.0)]), y))
    points = [(i, float(x), float(y)) for i, x, y in points]
    got = {r.key: r.area if r.method == "inside" else None for r in places.inside_areas(spark.createDataFrame(points, "key int, x double, y double"), spark.createDataFrame(areas, "id string, rings array<array<array<double>>>"), "key", "x", "y").collect()}
    want = {k: a if m == "inside" else None for k, (a, m) in slow_place(points, areas, 0.15).items()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_areas_without_limits(spark):
    """A ring of many corners, no areas, repeated keys."""
    n = 40_000
    circle = [[float(np.cos(2 * np.pi * k / n)), float(np.sin(2 * np.pi * k / n))] for k in range(n)]
    table = spark.createDataFrame([("disk", [circle])], "id string, rings array<array<array<double>>>")
    rows = spark.createDataFrame([(i % 50, 1.3 * math.cos(i), 0.02 * i * math.sin(i)) for i in range(100)], "key int, x double, y double")
    got = sorted((r.key, r.area, r.method) for r in places.inside_areas(rows, table, "key", "x", "y", 0.1).na.fill("").collect())
    want = []
    for r in rows.collect():
        far = np.hypot(r.x, r.y)
        want.append((r.key, "disk" if far <= 1.1 else "", "inside" if far < 1 else "nearest" if far <= 1.1 else "unplaced"))
    assert got == sorted(want)
    assert {(r.area, r.method) for r in places.inside_areas(rows, table.limit(0), "key", "x", "y").collect()} == {(None, "unplaced")}


def slow_match(text, labels):
    text = (text or "").lower().strip(" ")
    if not text:
        return None
    if text in labels:
        return text
    return min((x for x in labels if x in text or text in x), key=lambda x: (-len(x), x), default=None)


def test_labels_by_pieces(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé😀") for _ in range(r.randint(1, 5)))
    labels = {" ".join(word() for _ in range(r.randint(1, 4))): i for i in range(400)}
    labels |= {"technical director": 1001, "software engineer": 1002, "data scientist": 1003}
    texts = ["Technical Director", "Senior Software Engineer", " software engineer ", "nonexistent made-up title", "softwaer enginer", None, "", "  ", "a", "é", "😀", "engineer", "SCIENTIST", "x" * 20_000 + " data scientist"]
    texts += [" ".join(word() for _ in range(r.randint(1, 7))) for _ in range(300)] + texts[:3]
    rows = spark.createDataFrame([(i, t, "c", "s", 1) for i, t in enumerate(texts)], "id int, job string, outer string, piece string, n int")
    table = spark.createDataFrame([(k.upper() if v % 2 else k, v) for k, v in labels.items()] + [(" ", 5), (None, 6), ("Data Scientist", 2000)], "name string, uri int")
    got = {g.id: (g.name, g.uri) for g in profiles.match_labels(rows, "job", table, "name", "uri").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = slow_match(t, labels)
        assert got[i] == (want, labels[want] if want else None), (t[:40] if t else t, got[i], want)
    assert profiles.match_labels(rows, "job", table.limit(0), "name", "uri").where("uri is not null").count() == 0
    assert profiles.match_labels(rows.limit(0), "job", table, "name", "uri").collect() == []


def test_labels_beyond_a_broadcast(spark):
    """More labels than the nested loop allowed."""
    labels = spark.range(60_000).select(F.concat(F.lit("worker of kind "), F.md5(F.col("id").cast("string"))).alias("name"), F.col("id").alias("uri"))
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Senior worker of kind "), F.md5(F.col("id").cast("string")), F.lit(" (m/f)"))).when(F.col("id") % 3 == 1, F.substring(F.md5(F.col("id").cast("string")), 3, 25)).otherwise(F.lit("none")).alias("job"))
    got = {g.id: g.uri for g in profiles.match_labels(rows, "job", labels, "name", "uri").collect()}
    assert got == {i: i if i % 3 < 2 else None for i in range(300)}
