"""Intervals, neighbours, nearest dates, areas, readers and sinks against brute force and made-up files."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from corpusstat.operators import graph, places, relate, series, vectors
from corpusstat.sources import readers, sinks


def test_within_day_interval(spark):
    cells = [("a", f"2024-01-{d:02d}", 40, 10, 80.0) for d in range(1, 11)] + [("b", "2024-01-01", 10, 0, 10.0)]
    df = spark.createDataFrame(cells, "g string, day string, n long, c long, W double")
    got = {r.g: r for r in series.within_day_interval(df, ["g"], 2000).collect()}
    spread = (0.25 * 0.75 / 400) ** 0.5
    assert abs(got["a"].share - 0.25) < 1e-9 and abs(got["a"].low - (0.25 - 1.96 * spread)) < 0.01 and abs(got["a"].high - (0.25 + 1.96 * spread)) < 0.01
    assert (got["b"].share, got["b"].low, got["b"].high) == (0, 0, 0)
    again = {r.g: r for r in series.within_day_interval(df.repartition(7), ["g"], 2000).collect()}
    assert got == again


def test_ratio_interval(spark):
    side = lambda g, late, c: [(g, late, f"2024-0{1 + late}-{d:02d}", 50, c, 50.0) for d in range(1, 21)]
    df = spark.createDataFrame(side("up", False, 5) + side("up", True, 10) + side("new", False, 0) + side("new", True, 3) + side("gone", False, 2), "g string, late boolean, day string, n long, c long, W double")
    got = {r.g: r for r in series.ratio_of_shares(df, ["g"], "late").collect()}
    assert got["up"].ratio == pytest.approx(2) and 1.5 < got["up"].low < 2 < got["up"].high < 2.7
    assert got["new"].ratio is None and got["new"].low is None and got["gone"].ratio == 0


def brute(points, k):
    keys, m = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    c = np.round(m @ m.T, 6)
    return {int(keys[i]): sorted(((-c[i, j], int(keys[j])) for j in range(len(keys)) if j != i))[:k] for i in range(len(keys))}


def test_neighbour_graph(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 8))
    points = [(i, (centres[i % 12] + 0.4 * r.standard_normal(8)).tolist()) for i in range(1500)]
    points += [(2000 + i, points[5][1]) for i in range(700)] + [(9000, [0.0] * 8)]  # a third are copies of one vector
    df = spark.createDataFrame(points, "id long, v array<double>")
    got: dict[int, list] = {}
    for x in vectors.neighbour_graph(df, "id", "v", 5).collect():
        got.setdefault(x.query, []).append((-x.cosine, x.neighbour))
    want = brute(points, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    recall = np.mean([len({n for _, n in got[i]} & {n for _, n in want[i]}) / 5 for i in want])
    assert recall >= 0.9
    assert all(sorted(got[i]) == want[i] for i in (5, 2000, 2699))  # ties by key among the copies
    asked = df.where("id % 100 = 0")
    exact: dict[int, list] = {}
    for x in vectors.nearest(asked, df, "id", "v", 5).collect():
        exact.setdefault(x.query, []).append((-x.cosine, x.neighbour))
    assert all(sorted(exact[i]) == want[i] for i in exact)
    assert vectors.neighbour_graph(df.limit(0), "id", "v", 5).count() == 0


def test_laplacian_scores(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (3, 1, 0.2)], "query long, neighbour long, cosine double")
    edges = graph.heat_edges(pairs, "query", "neighbour", "cosine")
    w = {(r.a, r.b): r.w for r in edges.collect()}
    t = np.mean([0.2, 0.2, 1.6])
    assert w[1, 2] == w[2, 1] == pytest.approx(np.exp(-0.2 / t)) and w[1, 3] == w[3, 1] == pytest.approx(np.exp(-1.6 / t))
    members = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, item string")
    d = {i: sum(v for (a, _), v in w.items() if a == i) for i in (1, 2, 3)}
    all_, fd = sum(d.values()), d[1] + d[2]
    want = (fd - 2 * w[1, 2]) / (fd - fd * fd / all_)
    assert {r.item: r.score for r in graph.laplacian_scores(edges, members, "id", "item").collect()}["x"] == pytest.approx(want)


@pytest.mark.parametrize("width", [7, 1000])
def test_nearest_dates(spark, width):
    r = random.Random(width)
    at = datetime(2024, 1, 1)
    rows = [(i, r.choice("aab") if i < 150 else "c", at + timedelta(hours=i) if r.random() < 0.3 and (i < 40 or i > 80) else None) for i in range(0, 400, 2)]
    got = {x.id: x.near_id for x in relate.nearest_dated(spark.createDataFrame(rows, "id long, page string, at timestamp"), "id", "page", "at", width).collect()}
    want = {}
    for i, p, t in rows:
        if t is None:
            others = [(abs(i - j), j) for j, q, s in rows if s is not None and q != p]
            want[i] = min(others)[1] if others else None
    assert got == want


def test_areas(spark, tmp_path):
    square = lambda x: [[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]
    feature = lambda name, kind, c, level=2, land="XX": {"properties": {"NUTS_ID": name, "LEVL_CODE": level, "CNTR_CODE": land}, "geometry": {"type": kind, "coordinates": c}}
    hole = [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6], [0.4, 0.4]]
    made = {"features": [feature("A", "Polygon", [square(0), hole]), feature("B", "MultiPolygon", [[square(5)], [square(7)]]), feature("C", "Polygon", [square(0)], 3), feature("D", "Polygon", [square(0)], 2, "YY")]}
    (tmp_path / "areas.json").write_text(json.dumps(made, indent=1))
    areas = readers.features(spark, str(tmp_path / "areas.json"), "XX", 2)
    assert [r.id for r in areas.orderBy("id").collect()] == ["A", "B"]
    points = [(1, 0.1, 0.1), (2, 0.5, 0.5), (3, 7.5, 0.5), (4, 6.1, 0.5), (5, 3.0, 3.0), (6, None, 1.0)]
    got = {r.id: (r.area, r.method) for r in places.inside_areas(spark.createDataFrame(points, "id int, x double, y double"), areas, "id", "x", "y").collect()}
    assert got == {1: ("A", "inside"), 2: ("A", "nearest"), 3: ("B", "inside"), 4: ("B", "nearest"), 5: (None, "unplaced"), 6: (None, "unplaced")}


def test_readers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    lines = put("a.jsonl", '{"id": 1}\n\n{"id": 2}\n')
    assert readers.json_lines(spark, [lines, put("b.jsonl", '{"id": 3}\n')], "id int").count() == 3
    assert [tuple(r) for r in readers.csv(spark, put("c.csv", '﻿term,note\na,"x\ny"\n')).collect()] == [("a", "x\ny")]
    page = {"day": "2024-01-01", "total": 9, "page": 1, "items": [{"id": 1, "title": "t"}, {"id": 2}]}
    assert [(r.day, r.total, r.item, r.id, r.title) for r in readers.pages(spark, put("p.jsonl", json.dumps(page))).collect()] == [("2024-01-01", 9, 0, 1, "t"), ("2024-01-01", 9, 1, 2, None)]
    assert {tuple(r) for r in readers.keyed_counts(spark, put("k.json", '{"a|b": 3, "c|d": 4}'), ["x", "y"]).collect()} == {("a", "b", 3), ("c", "d", 4)}
    for i, text in enumerate(('[{"n": 1}]', '{"data": [{"n": 1}]}', '{"rows": [{"n": 1}]}')):
        assert [r.n for r in readers.unwrapped(spark, put(f"u{i}.json", text), "n: int").collect()] == [1]
    assert readers.unwrapped(spark, put("u.json", '{"other": 1}'), "n: int").count() == 0
    places = put("g.txt", '1\tMalmö\tMalmo\tMalmoe,Malmø\t55.6\t13.0\tP\tPPLA\tSE\n2\tLake "L"\tLake\t\t1\t1\tH\tLK\tSE\n3\tParish\tParish\t\t1\t1\tA\tADM4\tSE\n')
    assert sorted(r.name for r in readers.gazetteer(spark, places).collect()) == ["Malmo", "Malmoe", "Malmö", "Malmø", "Parish"]
    put("trend_my-board.json", '[{"location_code": "SE", "Date": "03/2025", "Freq": 7}]')
    assert [tuple(r) for r in readers.trends(spark, str(tmp_path / "trend_*.json")).collect()] == [("my-board", "SE", "2025-03", 7)]
    assert {tuple(r) for r in readers.code_counts(spark, put("s.jsonl", '{"x": "SE", "count": 5}\n{"total": 7, "loc": "FR", "z": 9}\n{"q": "none"}\n')).collect()} == {("SE", 5), ("FR", 7)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "b")], "id int, t string")
    at = str(tmp_path / "out")
    for _ in range(2):
        sinks.append_new(rows, at, "id")
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [1, 2]
    sinks.replaced(spark.read.parquet(at).where("id = 1"), at)
    assert [r.id for r in spark.read.parquet(at).collect()] == [1]
    sinks.sheet(rows, str(tmp_path / "sheet"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.sheet(rows, str(tmp_path / "sheet"))
    assert sinks.markdown(spark.createDataFrame([("a|b", None)], "x string, y string")) == "| x | y |\n| --- | --- |\n| a\\|b |  |"
