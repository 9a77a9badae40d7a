"""Operators against brute-force twins on small random data; hot-key paths against ordinary ones."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.operators import assign, layout, pairs, scan, suppress, tracks, zorder


def rand_boxes(seed, n=60, groups=3):
    r = random.Random(seed)
    out = []
    for pos in range(n):
        x, y, w, h = r.randrange(300), r.randrange(200), r.randrange(20, 150), r.randrange(20, 120)
        out.append((pos % groups, pos // groups, "abc"[r.randrange(3)], r.randrange(10**6), x, y, x + w, y + h, w * h))
    return out


COLS = "slide_id long, pos long, label string, score long, x0 long, y0 long, x1 long, y1 long, area long"


@pytest.fixture(scope="module")
def boxes(spark):
    rows = rand_boxes(3)
    return rows, spark.createDataFrame(rows, COLS).cache()


def inter(a, b):
    return max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))


def iou(a, b):
    i = inter(a, b)
    return i / (a[8] + b[8] - i)


def keys(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def greedy(rows, order, conflict):
    kept = []
    for c in sorted(rows, key=order):
        if not any(k[0] == c[0] and conflict(k, c) for k in kept):
            kept.append(c)
    return sorted((k[0], k[1]) for k in kept)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_pairs_grid_equals_plain(boxes, limit):
    rows, df = boxes
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and inter(a, b) > 0)
    tiny = df.withColumns({c: df[c] / 5000 - 0.01 for c in ("x0", "y0", "x1", "y1")})
    for d, cell in ((df, 37), (df, None), (tiny, None)):
        got = pairs.box_pairs(d, ["slide_id"], lambda a, b: a("pos") < b("pos"), limit=limit, cell=cell)
        assert keys(got, "slide_id", "a.pos", "b.pos") == want


@pytest.mark.parametrize("limit", [10**6, 0])
def test_points_grid_equals_plain(spark, boxes, limit):
    rows, df = boxes
    points = spark.createDataFrame([(g, i, 17 * i % 300, 29 * i % 300) for g in {r[0] for r in rows} for i in range(30)], df.select("slide_id").schema.add("p", "long").add("cx", "long").add("cy", "long"))
    want = sorted((g, p, b[1]) for g, p, x, y in points.collect() for b in rows if b[0] == g and b[4] <= x <= b[6] and b[5] <= y <= b[7])
    assert keys(pairs.points_in_boxes(points, df, ["slide_id"], limit=limit), "slide_id", "a.p", "b.pos") == want


@pytest.mark.parametrize("fold", [10**6, 0])
def test_frame_nms(boxes, fold, monkeypatch):
    rows, df = boxes
    monkeypatch.setattr(suppress.drop_in_order, "__defaults__", (fold,))
    want = greedy(rows, lambda c: (-c[3], c[1]), lambda k, c: iou(k, c) >= 0.2)
    assert keys(suppress.frame_nms(df, ["slide_id"], 0.2), "slide_id", "pos") == want


@pytest.mark.parametrize("fold", [10**6, 0])
def test_near_duplicates(boxes, fold, monkeypatch):
    rows, df = boxes
    monkeypatch.setattr(suppress.drop_in_order, "__defaults__", (fold,))
    want = []
    for g in {r[0] for r in rows}:
        c = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        active = [True] * len(c)
        again = True
        while again:
            again = False
            for i, j in itertools.combinations(range(len(c)), 2):
                a, b = c[i], c[j]
                if active[i] and active[j] and a[2] != b[2] and inter(a, b) >= 1 and inter(a, b) / min(a[8], b[8]) >= 0.5:
                    first = (a[3], a[8]) > (b[3], b[8]) if (a[3], a[8]) != (b[3], b[8]) else a[2] < b[2]
                    active[j if first else i] = False
                    again = True
                    break
        want += [(g, x[1]) for x, ok in zip(c, active) if ok]
    assert keys(suppress.near_duplicate_filter(df, ["slide_id"], 0.5), "slide_id", "pos") == sorted(want)


def test_same_label_cap(boxes):
    rows, df = boxes
    want = []
    for g, lab in {(r[0], r[2]) for r in rows}:
        kept = []
        for c in sorted((r for r in rows if (r[0], r[2]) == (g, lab)), key=lambda r: (-r[8], -r[3], r[1])):
            if not any(inter(k, c) >= 1 for k in kept):
                kept.append(c)
            if len(kept) >= 2:
                break
        want += [(k[0], k[1]) for k in kept]
    assert keys(suppress.same_label_filter(df, ["slide_id"], max_per_label=2), "slide_id", "pos") == sorted(want)


@pytest.mark.parametrize("limit", [10**6, 5])
def test_running_scan(boxes, limit):
    rows, df = boxes
    got = scan.running(df, ["slide_id"], ["score", "pos"], sums={"s": F.col("area")}, lasts={"l": F.when(F.col("label") == "a", F.col("pos"))}, limit=limit)
    want = []
    for g in {r[0] for r in rows}:
        s, last = 0, None
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1])):
            s += r[8]
            last = r[1] if r[2] == "a" else last
            want.append((g, r[1], s, -1 if last is None else last))
    assert keys(got.fillna(-1, ["l"]), "slide_id", "pos", "s", "l") == sorted(want)
    nxt = scan.next_row(df, ["slide_id"], ["score", "pos"], ["pos"], limit=limit)
    order = {g: [r[1] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1]))] for g in {r[0] for r in rows}}
    assert keys(nxt.where("next_pos is not null"), "slide_id", "pos", "next_pos") == sorted((g, a, b) for g, o in order.items() for a, b in zip(o, o[1:]))


@pytest.mark.parametrize("limit", [10**6, 0])
def test_assignment_is_optimal(spark, limit):
    r = random.Random(5)
    rows = [(g, i, j, r.random(), 0.0) for g in range(4) for i in range(5) for j in range(6) if r.random() < 0.6]
    df = spark.createDataFrame([(*x[:4], x[3]) for x in rows], "g long, r long, c long, value double, sim double")
    got = assign.best_assignment(df, ["g"], limit).collect()
    for g in range(4):
        v = {(x[1], x[2]): x[3] for x in rows if x[0] == g}
        best = max(sum(v.get((i, p[i]), 0) for i in range(5)) for p in itertools.permutations(range(6), 5))
        mine = [x for x in got if x.g == g]
        assert abs(sum(x.value for x in mine) - best) < 1e-9
        assert len({x.r for x in mine}) == len(mine) == len({x.c for x in mine})


@pytest.mark.parametrize("limit", [10**6, 0])
def test_carve(spark, boxes, limit, monkeypatch):
    rows, df = boxes
    monkeypatch.setattr(layout, "FOLD_EDGES", limit)
    c = df.where("pos < 12").withColumn("filename", F.format_string("f%03d", "pos"))
    d = layout.overlap_to_arbitrate(c).withColumns({"first_owns": F.lit(True), "second_owns": F.lit(False)})
    got = {(r.slide_id, r.pos): (r.x0, r.y0, r.x1, r.y1) for r in layout.carve_overlaps(c, d).collect()}
    for g in {r[0] for r in rows}:
        box = {r[1]: tuple(map(float, r[4:8])) for r in rows if r[0] == g and r[1] < 12}
        for i in sorted(box):
            for j in sorted(box):
                if j < i:  # the lower filename owns, so only j < i cuts i
                    left = layout._carve_one(box[i], box[j], 100.0)
                    if left is not None:
                        box[i] = left
                        break
        assert {p: got[g, p] for p in box} == box


@pytest.mark.parametrize("limit", [10**6, 0])
def test_carve_inside_the_slide(spark, limit, monkeypatch):
    """Clamped to 200 x 150: 1 is cut and clamped, 3 would leave the slide by its first cut and takes the second; tight and original boxes follow."""
    monkeypatch.setattr(layout, "FOLD_EDGES", limit)
    box = {0: (0., 0., 60., 100.), 1: (-20., 0., 300., 90.), 2: (150., -5., 200., 400.), 3: (150., -5., 260., 400.), 4: (230., -5., 260., 400.), 5: (5., 110., 40., 140.)}
    c = spark.createDataFrame([("s", p, f"f{p}", *v, 200, 150, [v[0] + 1, v[1] + 1, v[2] - 1, v[3] - 1], [9.0] * 4 if p == 1 else None) for p, v in box.items()],
                              "slide_id string, pos long, filename string, x0 double, y0 double, x1 double, y1 double, sw int, sh int, tight_bbox array<double>, original_bbox array<double>")
    d = spark.createDataFrame([("s", f"f{i}", f"f{j}", False, True) for i, j in ((1, 2), (3, 2), (3, 4))], "slide_id string, first string, second string, first_owns boolean, second_owns boolean")
    got = {r.pos: r for r in layout.carve_overlaps(c, d, slide_size=("sw", "sh")).collect()}
    want = {1: layout._carve_one(box[1], box[2], 100.0, 200, 150), 3: layout._carve_one(box[3], box[2], 100.0, 200, 150) or layout._carve_one(box[3], box[4], 100.0, 200, 150)}
    for p, r in got.items():
        new = want.get(p, box[p])
        assert (r.x0, r.y0, r.x1, r.y1) == new
        if p in want:
            t = [max(box[p][0] + 1, new[0]), max(box[p][1] + 1, new[1]), min(box[p][2] - 1, new[2]), min(box[p][3] - 1, new[3])]
            assert r.tight_bbox == t and r.original_bbox == ([9.0] * 4 if p == 1 else list(box[p]))
        else:
            assert r.original_bbox is None and r.tight_bbox[0] == box[p][0] + 1
    assert want[1][2] <= 200 and want[3] == (150.0, 0.0, 200.0, 150.0) and got[3].carved_by == 4


@pytest.mark.parametrize("limit", [10**6, 0])
def test_carve_sees_later_boxes_uncut(spark, limit, monkeypatch):
    """Component 1 loses to 0 and 3, and 3 loses to 6: 1 must meet the uncut 3 although 3 settles first."""
    monkeypatch.setattr(layout, "FOLD_EDGES", limit)
    box = {0: (0., 0., 100., 100.), 1: (50., 200., 300., 300.), 3: (200., 190., 400., 310.), 5: (0., 50., 30., 300.), 6: (150., 180., 290., 320.)}
    c = spark.createDataFrame([("s", p, f"f{p}", *v) for p, v in box.items()], "slide_id string, pos long, filename string, x0 double, y0 double, x1 double, y1 double")
    lose = [(0, 5), (1, 0), (1, 3), (3, 6)]
    d = spark.createDataFrame([("s", f"f{i}", f"f{j}", False, True) for i, j in lose], "slide_id string, first string, second string, first_owns boolean, second_owns boolean")
    want = dict(box)
    moved = {}
    for i, j in lose:
        if i not in moved:
            left = layout._carve_one(box[i], moved[j] if j < i and j in moved else box[j], 100.0)
            if left is not None:
                want[i] = moved[i] = left
    assert {r.pos: (r.x0, r.y0, r.x1, r.y1) for r in layout.carve_overlaps(c, d).collect()} == want and want[1] == (50., 200., 200., 300.)


def test_subtract_box(spark):
    r = random.Random(1)
    rows = [tuple(sorted(r.sample(range(12), 2)) + sorted(r.sample(range(12), 2)) + sorted(r.sample(range(12), 2)) + sorted(r.sample(range(12), 2))) for _ in range(300)]
    rows = [(a, c, b, d, e, g, f, h) for a, b, c, d, e, f, g, h in rows]
    df = spark.createDataFrame(rows, "x0 int, y0 int, x1 int, y1 int, bx0 int, by0 int, bx1 int, by1 int")
    d = df.withColumn("d", B.subtract_box(B.box(), B.box("b"))).withColumn("pa", B.polygon_area(F.col("d.vertices")))
    for x in d.collect():
        cells = {(i, j) for i in range(x.x0, x.x1) for j in range(x.y0, x.y1)} - {(i, j) for i in range(x.bx0, x.bx1) for j in range(x.by0, x.by1)}
        hull = (x.d.x1 - x.d.x0) * (x.d.y1 - x.d.y0)
        if x.d.kind in ("none", "rect"):
            assert hull == len(cells)
        elif x.d.kind == "poly":
            assert x.pa == len(cells)
        elif x.d.kind == "empty":
            assert not cells


def heap_order(area, edges):
    need = {v: 0 for v in area}
    for _, o in edges:
        need[o] += 1
    heap = [(-area[v], v) for v in area if not need[v]]
    heapq.heapify(heap)
    out = []
    while heap:
        _, v = heapq.heappop(heap)
        out.append(v)
        for u, o in edges:
            if u == v:
                need[o] -= 1
                if not need[o]:
                    heapq.heappush(heap, (-area[o], o))
    return out if len(out) == len(area) else sorted(area, key=lambda v: (-area[v], v))


@pytest.mark.parametrize("limit", [10**6, 0])
def test_z_order(spark, boxes, limit, monkeypatch):
    rows, df = boxes
    monkeypatch.setattr(zorder, "HOT_EDGES", limit)
    r = random.Random(9)
    ratios = [(a[0], a[1], b[1], r.random(), r.random()) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and r.random() < 0.03]
    rat = spark.createDataFrame(ratios, "slide_id long, i long, j long, ratio_i double, ratio_j double")
    got = zorder.z_order(df, rat, ["slide_id"]).collect()
    for g in {x[0] for x in rows}:
        edges = []
        for s, i, j, a, b in ratios:
            if s == g and a < b - 0.02:
                edges.append((j, i))
            elif s == g and b < a - 0.02:
                edges.append((i, j))
        want = heap_order({x[1]: x[8] for x in rows if x[0] == g}, edges)
        assert [x.pos for x in sorted((x for x in got if x.slide_id == g), key=lambda x: x.z_index)] == want


@pytest.mark.parametrize("block", [4096, 3])
def test_keep_alive_blocks(spark, block):
    r = random.Random(4)
    rows = [(v, f, r.random() < 0.55) for v in range(3) for f in range(50)]
    df = spark.createDataFrame(rows, "v long, frame_idx long, matched boolean")
    got = {(x.v, x.frame_idx): x.keep_alive for x in tracks.keep_alive(df, ["v"], block=block).collect()}
    for v in range(3):
        a = 0
        for _, f, m in (x for x in rows if x[0] == v):
            a = min(8, a + 1) if m else max(-4, a - 1)
            assert got[v, f] == a


def test_track_nms_counts_shared_frames_only(spark):
    rows = [(1, 1, f, 0, 0, 10, 10) for f in range(4)] + [(1, 2, f, 0, 0, 10, 8) for f in range(2)] + [(1, 3, f, 50, 50, 60, 60) for f in range(4)]
    fr = spark.createDataFrame(rows, "video_id long, track_id long, frame_idx long, x0 long, y0 long, x1 long, y1 long")
    sc = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)], "video_id long, track_id long, score double")
    out = suppress.track_nms(fr, sc, 0.75).collect()
    assert len(out) == len(rows)
    assert {r.track_id for r in out if r.x0 is None} == {2}


def test_masks_have_every_row(spark, monkeypatch):
    """Overlaps, boxes and rests of full-box masks against painted pixels; no row of the first overlap is divisible by 16."""
    import numpy as np

    from slidemesh.plans import training_queries as Q
    boxes = [(0, 1, 30, 14), (10, 3, 40, 15), (5, 10, 25, 60), (20, 17, 50, 31), (0, 0, 8, 80), (60, 5, 70, 6)]
    rows = [(1, k, f"1/c{k}", "l", k, *b, (b[2] - b[0]) * (b[3] - b[1])) for k, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "slide_id long, pos long, node_id string, label string, score long, x0 long, y0 long, x1 long, y1 long, area long")
    monkeypatch.setattr(Q.V, "components", lambda spark, sf: df)
    px = np.zeros((len(boxes), 100, 100), bool)
    for k, (x0, y0, x1, y1) in enumerate(boxes):
        px[k, y0:y1, x0:x1] = True
    want = {(a, b): (i, round(i / (px[a] | px[b]).sum(), 9), round(i / min(px[a].sum(), px[b].sum()), 9)) for a in range(0, 6, 2) for b in range(1, 6, 2) if (i := int((px[a] & px[b]).sum()))}
    assert (0, 1) in want and {(r.a, r.b): (r.inter, r.iou, r.iom) for r in Q.mask_iou(spark, "").collect()} == want
    assert {(r.mask_id): (r.x0, r.y0, r.x1, r.y1) for r in Q.mask_boxes(spark, "").collect()} == dict(enumerate(boxes))
    taken, left = np.zeros((100, 100), bool), {}
    for k in sorted(range(6), key=lambda k: (rows[k][-1], -k)):
        rest = int((px[k] & ~taken).sum())
        left[k] = (rest, rest >= 32 and rest >= 0.1 * px[k].sum())
        taken |= px[k] if left[k][1] else False
    got = {r.mask_id: r for r in Q.residual_masks(spark, "").collect()}
    assert {k: r.left_px for k, r in got.items()} == {k: v[0] for k, v in left.items() if k in got}
    assert set(got) >= {k for k, v in left.items() if v[1]}


def test_partitions_follow_the_rows(spark, monkeypatch):
    """A keyed table beyond what a few tasks hold gets partitions in proportion to its rows, on which later steps of the key stay; a hot key does not count."""
    from slidemesh import runtime
    monkeypatch.setattr(runtime, "ROWS_A_TASK", 10)
    rows = [(k, v) for k in range(200) for v in range(3)] + [(-1, v) for v in range(100)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = scan.positions(df, ["k"], ["v"], limit=50)
    cold = got.where("k >= 0").withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.max("pos").alias("top"), F.first("p").alias("p")).collect()
    assert len(cold) == 200 and all(r.top == 2 for r in cold) and 40 < len({r.p for r in cold}) <= 60
    assert [r.pos for r in got.where("k = -1").orderBy("v").collect()] == list(range(100))
