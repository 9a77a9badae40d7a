"""Merge-group refinement, reconstruction and planning on hand-made slides."""

import numpy as np

from slidemesh.functions import pixels
from slidemesh.operators import refine, tracks


def test_refine_routes(spark):
    comps = spark.createDataFrame([
        ("s", 0, "a", "photo", 0, 0, 40, 40), ("s", 1, "b", "photo", 60, 60, 100, 100), ("s", 2, "corner", "photo", 70, -10, 120, 30),
        ("s", 3, "in", "photo", 90, 90, 120, 120), ("s", 4, "vis", "photo", 0, 80, 30, 120), ("s", 5, "txt", "label", 40, 40, 60, 60)],
        "slide_id string, pos int, filename string, label string, x0 int, y0 int, x1 int, y1 int")
    groups = spark.createDataFrame([("s", 0, "diagram", ["a", "b"], 0, 0, 100, 100)],
                                   "slide_id string, group_idx int, merged_class string, member_filenames array<string>, x0 int, y0 int, x1 int, y1 int")
    dec = spark.createDataFrame([("s", 0, "corner", False, False), ("s", 0, "in", True, True), ("s", 0, "vis", False, True), ("s", 0, "txt", False, True)],
                                "slide_id string, group_idx int, filename string, should_merge boolean, visually_overlaps boolean")
    r = refine.refine_groups(groups, comps, dec).first()
    assert r.members == ["a", "b", "in"] and r.erases == ["vis"] and not r.rectangular
    assert (r.x0, r.y0, r.x1, r.y1) == (0, 0, 120, 120)
    assert r.area == 100 * 100 - 30 * 30 + 30 * 30 - 10 * 10


def test_hole_is_not_cut(spark):
    b, members, erases, area, rect = refine._refine((0, 0, 100, 100), False, {"a": (0, 0, 100, 100)}, [("x", False, (40, 40, 60, 60), False, False)], {"a"})
    assert (area, rect, erases) == (10000.0, True, [])


def test_plan_frames(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    dets = spark.createDataFrame([(1, 0, 1, 0.9, .4, .4, .6, .6), (1, 0, 2, 0.8, .1, .1, .3, .3), (1, 0, 3, 0.7, .6, .6, .9, .9), (1, 1, 1, 0.9, .0, .4, .04, .6)], f"video_id long, frame_idx long, det_id long, score double, {box}")
    trk = spark.createDataFrame([(1, 0, 7, .4, .4, .6, .6), (1, 1, 7, .7, .7, .9, .9)], f"video_id long, frame_idx long, trk_id long, {box}")
    vid = spark.createDataFrame([(1, 7)], "video_id long, max_obj_id long")
    got = [(r.frame_idx, r.det_id, r.obj_id) for r in tracks.plan_frames(dets, trk, vid, 2).collect()]
    assert got == [(0, 2, 8)]  # matched, then limit 2 leaves one place, border one dropped


def test_groups_without_live_candidates_need_no_cells(monkeypatch):
    """Verdicts on members, absorbed or outlying components change nothing; the box cut to its members is then found directly."""
    cases = [((0, 0, 100, 100), {"a": (10, 10, 40, 40), "b": (50, 50, 90, 80)}, [("a", False, (10, 10, 40, 40), True, True), ("z", False, (200, 0, 220, 9), True, True)], {"a", "b"}, ((8, 8, 92, 82), 84.0 * 74, True)),
             ((0, 0, 100, 100), {}, [("q", False, (0, 0, 50, 50), True, True)], {"q"}, ((0, 0, 100, 100), 10000.0, True)),
             ((0, 0, 10, 10), {"a": (50, 50, 60, 60)}, [], {"a"}, ((0, 0, 10, 10), 100.0, True))]
    made = []
    monkeypatch.setattr(refine, "_Cells", lambda b, own=refine._Cells: made.append(b) or own(b))
    for box, members, cands, absorbed, (bounds, area, rect) in cases:
        b, m, erases, a, r = refine._refine(box, False, dict(members), cands, set(absorbed))
        assert (tuple(b), m, erases, a, r) == (bounds, sorted(members), [], area, rect)
    assert not made


def test_registered_groups_heed_their_verdicts(spark):
    """Boxes that are no members are absorbed, cut out or erased, and every slide of two or more boxes has its group."""
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    rows = entry.queries()["refined_groups"](spark, sf).collect()
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert sorted(r.slide_id for r in rows) == sorted(r.l_orderkey for r in li.groupBy("l_orderkey").count().where("count >= 2").collect())
    assert any(r.members.count(" ") > 1 for r in rows) and any(r.erases for r in rows) and any(not r.rectangular for r in rows)
    assert all(r.members.startswith("f0 f1") and not set(r.members.split()) & set(r.erases.split()) for r in rows)


def test_cells_of_an_area_and_its_runs():
    """Holes, parts, bounds and runs of an area kept as bits, also where it touches the first and last cells of neighbouring rows."""
    g = refine._Cells([(0, 0, 30, 30), (10, 10, 20, 20), (0, 10, 10, 20), (20, 0, 30, 10)])
    ring = g.rect((0, 0, 30, 30)) & ~g.rect((10, 10, 20, 20))
    assert g.has_hole(ring) and g.area(ring) == 800.0 and g.largest(ring) == ring
    ends = g.rect((20, 0, 30, 10)) | g.rect((0, 10, 10, 20))    # neighbours in the numbering, not on the slide
    assert g.largest(ends) == g.rect((20, 0, 30, 10)) and not g.has_hole(ends) and g.bounds(ends) == (0.0, 0.0, 30.0, 20.0)
    assert g.boxes(ring) == [(0, 0, 30, 10), (0, 10, 10, 20), (20, 10, 30, 20), (0, 20, 30, 30)]
    b, members, erases, area, rect = refine._refine((0, 0, 100, 100), False, {"a": (0, 0, 40, 40)}, [("x", False, (30, 30, 60, 60), True, True), ("y", False, (0, 0, 10, 10), False, False)], {"a"})
    assert (b, members, erases, area, rect) == ((0.0, 0.0, 62.0, 62.0), ["a", "x"], [], 62.0 * 62 - 100, False)
