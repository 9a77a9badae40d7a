"""Per-slide walks: one partition per slide, no joins on (slide, position) in between, and the same results by every path."""

import random

import pytest
from pyspark.sql import functions as F

from slidemesh.functions import masks
from slidemesh.operators import layout, zorder
from slidemesh.operators.assign import per_key


def _boxes(n_slides=4, n=9, seed=3):
    r = random.Random(seed)
    return [(g, p, f"f{p}", x := r.randrange(60), y := r.randrange(60), x + r.randrange(8, 50), y + r.randrange(8, 50)) for g in range(n_slides) for p in range(n)]


SCHEMA = "slide_id long, pos long, filename string, x0 long, y0 long, x1 long, y1 long"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_carve_needs_three_shuffles(spark):
    c = spark.createDataFrame(_boxes(), SCHEMA).withColumn("filename", F.when(F.col("pos") != 7, F.col("filename")))
    d = layout.overlap_to_arbitrate(c, 1.0).withColumns({"first_owns": F.col("overlap_px") % 3 == 0, "second_owns": F.col("overlap_px") % 3 == 1})
    plan = _plan(layout.carve_overlaps(c, d, 1.0))
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("Join") <= 1


def test_carve_paths_agree(spark, monkeypatch):
    """Boxes, winners and outlines of the walk and of the rounds; a decision that is there twice counts once, one on a missing file not at all."""
    c = spark.createDataFrame(_boxes(), SCHEMA)
    d = layout.overlap_to_arbitrate(c, 1.0).select("slide_id", "first", "second", (F.col("overlap_px") % 3 == 0).alias("first_owns"), (F.col("overlap_px") % 3 == 1).alias("second_owns"))
    d = d.union(d.where("slide_id = 1")).union(spark.createDataFrame([(0, "f0", "gone", False, True), (0, "f1", None, False, True)], d.schema))
    got = []
    for limit in (10**6, 0):
        monkeypatch.setattr(layout, "FOLD_EDGES", limit)
        got.append(sorted((r.slide_id, r.pos, r.x0, r.y0, r.x1, r.y1, r.carved_by, str(r.vertices)) for r in layout.carve_overlaps(c, d, 1.0).collect()))
    assert got[0] == got[1] and sum(r[6] is not None for r in got[0]) > 3


def test_paint_order_needs_one_shuffle(spark):
    c = spark.createDataFrame(_boxes(), SCHEMA)
    r = spark.createDataFrame([(g, i, j, (i * 7 + g) % 10 / 10, (j * 3) % 10 / 10) for g in range(4) for i in range(9) for j in range(i + 1, 9) if (i + j + g) % 3 == 0],
                              "slide_id long, i long, j long, ratio_i double, ratio_j double")
    plan = _plan(zorder.paint_order(c, r, ["slide_id"]))
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("split", [False, True])
def test_residuals_without_a_grid(spark, monkeypatch, split):
    """Rectangles cut one by one leave what a grid leaves, also for masks of several rectangles."""
    rows = []
    for g, p, _, x0, y0, x1, y1 in _boxes(6, 6, 5):
        at = (x0 + x1) // 2 if split else x1
        rows += [(g, p, x0, y0, at, y1)] + [(g, p, at, y0, x1, y1)] * split
    m = spark.createDataFrame(rows, "k long, mask_id long, x0 long, y0 long, x1 long, y1 long")
    order = m.select("k", "mask_id").distinct().withColumn("seq", F.col("mask_id"))
    got = []
    for few in (100, 0):
        monkeypatch.setattr(masks, "FEW_RECTS", few)
        got.append(sorted(map(tuple, masks.residual_pixels(m, order, ["k"], 20, 0.3).collect())))
    assert got[0] == got[1] and any(not r[3] for r in got[0])


def test_per_key_works_on_arrow(spark):
    """Groups stay whole across batches, null keys are one group, and no pandas frame is made."""
    df = spark.createDataFrame([(None if k % 7 == 0 else k % 7, k) for k in range(500)], "k long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = per_key(df, ["k"], ["v"], ["v"], lambda v: [(len(v), float(sum(v)), [v[0]], None)], "n long, s double, f array<long>, e string")
        assert "MapInArrow" in _plan(out)
        got = {r.k: (r.n, r.s, r.f, r.e) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in range(500):
        want.setdefault(None if k % 7 == 0 else k % 7, []).append(k)
    assert got == {k: (len(v), float(sum(v)), [v[0]], None) for k, v in want.items()}


def test_raster_measures_stay_in_arrow(spark):
    """Measures look at one image at a time in Arrow's buffers: no row becomes Python objects, and the block means are those of plain slices."""
    import numpy as np

    from slidemesh.functions import pixels
    img = np.random.default_rng(2).integers(0, 256, (37, 21, 3), np.uint8)
    df = spark.createDataFrame([(bytearray(img.tobytes()), 37, 21, 3)], "data binary, h int, w int, c int")
    a = [F.col(k) for k in ("data", "h", "w", "c")]
    box = F.array(*[F.lit(v) for v in (2.0, 1.0, 20.0, 30.0)])
    out = df.select(pixels.mean_rgb(*a, box, F.lit(8)).alias("m"), pixels.content_runs(*a).alias("r"), pixels.white_ratio(*a, box).alias("white"))
    p, r = img[1:30, 2:20].astype(float), out.first()
    ys, xs = np.linspace(0, 29, 9).astype(int), np.linspace(0, 18, 9).astype(int)
    means = [p[y:max(y + 1, v), x:max(x + 1, u)].reshape(-1, 3).mean(axis=0).round() for y, v in zip(ys, ys[1:]) for x, u in zip(xs, xs[1:])]
    assert r.m == [int(v) for v in (np.sum(means, axis=0) // 64)[::-1]] and r.white == 0.0 and all(x.x0 < x.x1 for x in r.r)
    old = F.pandas_udf(pixels.psnr, "double", 200).evalType       # scalar pandas functions hold a whole batch as objects
    assert all(f.evalType != old for f in (pixels.content_runs, pixels.mean_rgb, pixels.white_ratio))


def test_counts_of_a_filtered_set_need_no_numbering_of_objects(spark):
    """Links to dropped rows do not count, and the counts join no renumbered table: one window (the queries') is in their plan."""
    from slidemesh.operators import training as T
    q = spark.createDataFrame([(1, k, f"q{k}", 3) for k in range(4)], "datapoint long, query_id long, query_text string, n_out long")
    o = spark.createDataFrame([(1, 0, k) for k in range(5)], "datapoint long, image_id long, object_id long")
    links = spark.createDataFrame([(1, a, 0, b) for a in range(4) for b in range(5) if (a + b) % 2 == 0], "datapoint long, query_id long, image_id long, object_id long")
    qs, new_links, objects = T.apply_filter(q, links, o, q.where("query_id = 1").select(*T.Q), o.where("object_id IN (0, 3)").select(*T.O))
    assert [tuple(r) for r in qs.orderBy("query_id").select("query_id", "query_text", "n_out").collect()] == [(0, "q0", 2), (1, "q2", 2), (2, "q3", 1)]
    assert sorted((r.query_id, r.object_id) for r in new_links.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 0)] and objects.count() == 3
    assert _plan(qs).count("Window [") + _plan(qs).count("Window(") == 1
