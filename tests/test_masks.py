"""Mask forms against painted pictures."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slidemesh.functions import masks, pixels
from slidemesh.operators import outlines as O

BOX = "k int, x0 long, y0 long, x1 long, y1 long"


def painted(rows, h=40, w=40):
    out = {}
    for k, x0, y0, x1, y1 in rows:
        out.setdefault(k, np.zeros((h, w), int))[y0:y1, x0:x1] += 1
    return out


def boxes(n, keys, size=40, seed=1):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        x, y = rnd.randrange(size - 1), rnd.randrange(size - 1)
        rows.append((i % keys, x, y, rnd.randrange(x + 1, min(size, x + 9) + 1), rnd.randrange(y + 1, min(size, y + 9) + 1)))
    return rows


def test_outlines_refill_to_the_mask(spark):
    rows = boxes(300, 12) + [(20, 5, 5, 10, 10), (20, 10, 10, 15, 15), (20, 10, 0, 15, 5), (21, 0, 0, 30, 30)] + [(22, 0, y, 30, y + 3) for y in (0, 27)] + [(22, x, 0, x + 3, 30) for x in (0, 27)]
    want = painted(rows)
    rects = O.disjoint(spark.createDataFrame(rows, BOX), ["k"])
    for diagonal in (True, False):
        rings = O.outlines(rects, ["k"], diagonal=diagonal)
        got = {k: np.zeros((40, 40), int) for k in want}
        for r in O.polygon_runs(rings, ["k"]).collect():
            got[r.k][r.y, r.x0:r.x1] += 1
        assert all((got[k] == (want[k] > 0)).all() for k in want)
        area = {r.k: r.a for r in rings.groupBy("k").agg(F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))).alias("a")).collect()}
        assert area == {k: float((v > 0).sum()) for k, v in want.items()}
        assert rings.where("k = 20 and not hole").count() == (1 if diagonal else 3)
        assert rings.where("k = 22").count() == 2 and rings.where("k = 22 and hole").count() == 1
    lists = {r.k: r.vertices for r in O.vertex_lists(O.outlines(rects, ["k"], diagonal=False), ["k"]).collect()}
    assert lists[21] is None and lists[22] is None and lists[20] is None


def test_simplified_ring_stays_within_tolerance(spark):
    steps = [(1, 0, 2 * i, 10 + i % 2, 2 * i + 2) for i in range(15)] + [(1, 0, 30, 40, 40)]
    rects = O.disjoint(spark.createDataFrame(steps, BOX), ["k"])
    exact, rough = (O.outlines(rects, ["k"], tolerance=t).first() for t in (0.0, 1.5))
    assert len(rough.points) < len(exact.points) and {tuple(p) for p in rough.points} <= {tuple(p) for p in exact.points}
    got = sum(r.x1 - r.x0 for r in O.polygon_runs(O.outlines(rects, ["k"], tolerance=1.5), ["k"]).collect())
    assert abs(got - exact.area) <= 1.5 * 30
    assert O.outlines(rects, ["k"], min_area=1e6).count() == 0


def test_run_lengths_both_ways(spark):
    rows = boxes(120, 6) + [(30, 3, 0, 9, 40), (31, 0, 0, 40, 40), (32, 0, 20, 40, 40), (32, 39, 0, 40, 40)]
    want = painted(rows)
    counts = O.rects_counts(O.disjoint(spark.createDataFrame(rows, BOX), ["k"]), ["k"], F.lit(40), F.lit(40))
    for r in counts.collect():
        flat, at = np.zeros(1600, bool), 0
        for i, c in enumerate(r.counts):
            assert c > 0 or i == 0
            flat[at:at + c] = i % 2 == 1
            at += c
        assert at == 1600 and (flat.reshape(40, 40).T == (want[r.k] > 0)).all()
    got = {k: np.zeros((40, 40), int) for k in want}
    for r in O.counts_rects(counts, ["k"]).collect():
        got[r.k][r.y0:r.y1, r.x0:r.x1] += 1
    assert all((got[k] == (want[k] > 0)).all() for k in want)


def test_polygons_by_pixel_centres(spark):
    flat = spark.createDataFrame([(1, [0.0, 0.0, 10.0, 0.0, 0.0, 10.0]), (2, [2.5, 2.5, 7.5, 2.5, 7.5, 7.5, 2.5, 7.5]), (3, [1.0, 1.0])], "k int, flat array<double>")
    runs = O.polygon_runs(flat.select("k", O.polygon_points(F.col("flat")).alias("points")), ["k"])
    got = {(r.k, r.y): (r.x0, r.x1) for r in runs.collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, y): (0, 9 - y) for y in range(9)} | ({(1, 9): got[1, 9]} if (1, 9) in got else {})
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, y): (2, 7) for y in range(2, 7)}


@pytest.mark.parametrize("limit", [1000, 10])
def test_coverage_in_tiles(spark, monkeypatch, limit):
    monkeypatch.setattr(pixels, "HOT_COVER", limit)
    rows = boxes(400, 3) + [(9, 0, 0, 40, 40)] * 5 + [(10, 1, 1, 1, 5)]
    want = painted(rows)
    df = spark.createDataFrame(rows, BOX)
    got = {r.k: (r.covered, r.overlapped) for r in pixels.union_area(df, ["k"]).collect()}
    assert got == {k: ((v > 0).sum(), (v > 1).sum()) for k, v in want.items() if v.any()}
    halves = df.select("k", *[(F.col(c) / 2 - 7.25).alias(c) for c in ("x0", "y0", "x1", "y1")])
    for r in pixels.union_area(halves, ["k"]).collect():
        assert (r.covered * 4, r.overlapped * 4) == pytest.approx(got[r.k])


@pytest.mark.parametrize("limit", [200, 3])
def test_residuals_in_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(masks, "HOT_MASKS", limit)
    rows = [(k, i, x0, y0, x1, y1) for i, (k, x0, y0, x1, y1) in enumerate(boxes(90, 4, seed=4))]
    df = spark.createDataFrame(rows, "k int, mask_id long, x0 long, y0 long, x1 long, y1 long")
    order = df.select("k", "mask_id", F.row_number().over(Window.partitionBy("k").orderBy("mask_id")).alias("seq"))
    got = {(r.k, r.mask_id): (r.left_px, r.kept) for r in masks.residual_pixels(df, order, ["k"], 5, 0.4).collect()}
    taken, want = {}, {}
    for k, i, x0, y0, x1, y1 in rows:
        page = taken.setdefault(k, np.zeros((40, 40), bool))
        left, total = int((~page[y0:y1, x0:x1]).sum()), (x1 - x0) * (y1 - y0)
        keep = left > 0 and left >= 5 and left / total >= 0.4
        if keep:
            page[y0:y1, x0:x1] = True
        want[k, i] = (left, keep)
    assert got == want and {k for _, k in want.values()} == {True, False}


def test_pairs_of_rectangles_equal_pairs_of_rows(spark):
    """Masks of several rectangles: the same intersections and ratios as row by row, without a row for each pixel line."""
    rects = O.disjoint(spark.createDataFrame([(i % 5, *b[1:], i % 7) for i, b in enumerate(boxes(120, 5))], BOX + ", mask_id int"), ["k", "mask_id"])
    rows = O.row_runs(rects, ["k", "mask_id"])
    cols = ["k", "a", "b", "inter", "iou", "iom"]
    by_rows, by_rects = (masks.mask_pairs(t.where("mask_id % 2 = 0"), t.where("mask_id % 2 = 1"), ["k"]).select(*cols) for t in (rows, rects))
    got = sorted(map(tuple, by_rects.collect()))
    assert got == sorted(map(tuple, by_rows.collect())) and len(got) == 20


def test_upright_bands_are_not_taken_row_by_row(spark):
    """Upright edges give one rectangle a band however high; slanted ones a row each; gaps and holes as even-odd counting has them."""
    shapes = {1: [[(0, 0), (9, 0), (9, 30_000), (0, 30_000)], [(3, 100), (6, 100), (6, 200), (3, 200)]], 2: [[(0, 0), (20, 0), (20, 10), (0, 30)]]}
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, rings in shapes.items() for r in rings], f"k int, points {O.POINTS}")
    got = O.polygon_rects(df, ["k"]).collect()
    assert sorted((r.y0, r.y1, r.x0, r.x1) for r in got if r.k == 1) == [(0, 100, 0, 9), (100, 200, 0, 3), (100, 200, 6, 9), (200, 30_000, 0, 9)]
    want = {(y, x) for y in range(30) for x in range(20) if y + 0.5 < 30 - (x + 0.5)}
    assert {(y, x) for r in got if r.k == 2 for y in range(r.y0, r.y1) for x in range(r.x0, r.x1)} == want
