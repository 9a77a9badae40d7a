"""Evaluation metrics against plain numpy twins."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidemesh.plans import average_precision as AP
from slidemesh.plans import concept_f1 as CF
from slidemesh.plans import tracking_metrics as TM


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


def box(r):
    x, y = r.randrange(60), r.randrange(60)
    return x, y, x + r.randrange(20, 60), y + r.randrange(20, 60)


def jitter(r, b):
    d = [r.randrange(-6, 7) for _ in range(2)]
    return b[0] + d[0], b[1] + d[1], b[2] + d[0], b[3] + d[1]


def best_perm(m):
    n, k = m.shape
    if n > k:
        return [(i, j) for j, i in best_perm(m.T)]
    p = max(itertools.permutations(range(k), n), key=lambda q: sum(m[i, q[i]] for i in range(n)))
    return [(i, p[i]) for i in range(n)]


@pytest.fixture(scope="module")
def images(spark):
    r = random.Random(11)
    gt, dt = [], []
    for im in range(12):
        for g in range(r.randrange(0, 5)):
            b = box(r)
            gt.append((im, g, 1 + g % 2, *b))
            if r.random() < 0.8:
                dt.append((im, len(dt), 1 + g % 2, r.randrange(100) / 100, *jitter(r, b)))
        for _ in range(r.randrange(0, 2)):
            dt.append((im, len(dt), 1, r.randrange(100) / 100, *box(r)))
    g = spark.createDataFrame(gt, "image_id long, gt_id long, category_id long, x0 long, y0 long, x1 long, y1 long").withColumn("iscrowd", F.lit(False))
    d = spark.createDataFrame(dt, "image_id long, dt_id long, category_id long, score double, x0 long, y0 long, x1 long, y1 long")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return gt, dt, g.withColumn("area", area).cache(), d.withColumn("area", area).cache()


def test_concept_f1(spark, images):
    gt, dt, g, d = images
    im = spark.range(14).withColumnRenamed("id", "image_id")
    rows = {r.iou: r for r in CF.accumulate(CF.per_image(im, g, d, 0.3)).collect()}
    il = dict(tp=0, fp=0, tn=0, fn=0)
    tot = {t: dict(tp=0, fp=0, fn=0, pfp=0, lf=0.0) for t in CF.THRESHOLDS}
    for i in range(14):
        a, b = [x[3:] for x in gt if x[0] == i], [x[4:] for x in dt if x[0] == i and x[3] >= 0.3]
        il["tp" if a and b else "fp" if b else "fn" if a else "tn"] += 1
        if not a and not b:
            continue
        m = np.array([[iou(x, y) for y in b] for x in a]).reshape(len(a), len(b))
        sims = [m[i, j] for i, j in best_perm(m)] if a and b else []
        for t in CF.THRESHOLDS:
            tp = sum(s >= t for s in sims)
            fp, fn = len(b) - tp, len(a) - tp
            p, q = tp / (tp + fp + 1e-4), tp / (tp + fn + 1e-4)
            z = tot[t]
            z["tp"] += tp; z["fp"] += fp; z["fn"] += fn  # noqa: E702
            if a:
                z["pfp"] += fp
                z["lf"] += 2 * p * q / (p + q + 1e-4) if b else 0.0
    mcc = (il["tp"] * il["tn"] - il["fp"] * il["fn"]) / (((il["tp"] + il["fp"]) * (il["tp"] + il["fn"]) * (il["tn"] + il["fp"]) * (il["tn"] + il["fn"])) ** 0.5 + 1e-6)
    for t, z in tot.items():
        r = rows[t]
        assert (r.tp, r.fp, r.fn, r.positive_micro_fp) == (z["tp"], z["fp"], z["fn"], z["pfp"])
        p, q = z["tp"] / (z["tp"] + z["pfp"] + 1e-4), z["tp"] / (z["tp"] + z["fn"] + 1e-4)
        assert r.cgf1 == pytest.approx(2 * p * q / (p + q + 1e-4) * mcc)
        assert r.positive_macro_f1 == pytest.approx(z["lf"] / il["tp"])


def coco_ap(gt, dt, cat, t, lo, hi):
    flags = []
    n = sum(1 for g in gt if g[2] == cat and lo <= (g[5] - g[3]) * (g[6] - g[4]) <= hi)
    for im in {x[0] for x in dt}:
        gs = [g for g in gt if g[0] == im and g[2] == cat]
        gs.sort(key=lambda g: not (lo <= (g[5] - g[3]) * (g[6] - g[4]) <= hi))
        ign = [not (lo <= (g[5] - g[3]) * (g[6] - g[4]) <= hi) for g in gs]
        used = set()
        for d in sorted((d for d in dt if d[0] == im and d[2] == cat), key=lambda d: (-d[3], d[1])):
            best, m = t, -1
            for k, g in enumerate(gs):
                if k in used or (m > -1 and not ign[m] and ign[k]) or iou(g[3:], d[4:]) < best:
                    continue
                best, m = iou(g[3:], d[4:]), k
            if m >= 0:
                used.add(m)
            ignored = ign[m] if m >= 0 else not lo <= (d[6] - d[4]) * (d[7] - d[5]) <= hi
            if not ignored:
                flags.append((-d[3], im, d[1], m >= 0))
    flags.sort()
    tp = np.cumsum([f[3] for f in flags])
    fp = np.cumsum([not f[3] for f in flags])
    prec, rec = tp / np.maximum(tp + fp, 1), tp / n
    prec = np.maximum.accumulate(prec[::-1])[::-1]
    at = np.searchsorted(rec + 1e-11, [i / 100 for i in range(101)], side="left")
    return float(np.mean([prec[k] if k < len(prec) else 0.0 for k in at])) if len(prec) else 0.0


@pytest.mark.parametrize("hot", [50_000, 0])
def test_average_precision(images, hot, monkeypatch):
    gt, dt, g, d = images
    monkeypatch.setattr(AP, "HOT_PAIRS", hot)
    for r in AP.evaluate(g, d).collect():
        lo, hi = AP.AREAS[r.area_range]
        assert r.ap == pytest.approx(coco_ap(gt, dt, r.category_id, r.iou, lo, hi), abs=1e-9), (r.category_id, r.area_range, r.iou)


def test_hota(spark):
    r = random.Random(2)
    gt, tk = [], []
    for s in range(3):
        for f in range(5):
            for i in range(3):
                b = box(r)
                gt.append((s, f, i, *b))
                if r.random() < 0.8:
                    tk.append((s, f, i if r.random() < 0.7 else 10 + i, *jitter(r, b)))
    tk = list({(x[0], x[1], x[2]): x for x in tk}.values())
    g = spark.createDataFrame(gt, "seq long, frame long, gt_id long, x0 long, y0 long, x1 long, y1 long")
    t = spark.createDataFrame(tk, "seq long, frame long, tk_id long, x0 long, y0 long, x1 long, y1 long")
    got = {(x.seq, x.alpha): x for x in TM.hota_scores(TM.hota_sums(g, t, ["seq"])).collect()}
    for s in range(3):
        gi = sorted({x[2] for x in gt if x[0] == s}); ti = sorted({x[2] for x in tk if x[0] == s})  # noqa: E702
        pot, gc, tc = np.zeros((len(gi), len(ti))), np.zeros(len(gi)), np.zeros(len(ti))
        frames = []
        for f in range(5):
            a, b = [x for x in gt if x[:2] == (s, f)], [x for x in tk if x[:2] == (s, f)]
            m = np.array([[iou(x[3:], y[3:]) for y in b] for x in a]).reshape(len(a), len(b))
            frames.append((a, b, m))
            den = m.sum(0)[None] + m.sum(1)[:, None] - m
            for i, x in enumerate(a):
                gc[gi.index(x[2])] += 1
                for j, y in enumerate(b):
                    if den[i, j] > 0:
                        pot[gi.index(x[2]), ti.index(y[2])] += m[i, j] / den[i, j]
            for y in b:
                tc[ti.index(y[2])] += 1
        ga = pot / (gc[:, None] + tc[None] - pot)
        for alpha in TM.ALPHAS:
            tp = loc = 0
            cnt = np.zeros_like(pot)
            for a, b, m in frames:
                if not a or not b:
                    continue
                w = np.array([[ga[gi.index(x[2]), ti.index(y[2])] * m[i, j] for j, y in enumerate(b)] for i, x in enumerate(a)])
                for i, j in best_perm(w):
                    if m[i, j] >= alpha - 2e-16:
                        tp += 1
                        loc += m[i, j]
                        cnt[gi.index(a[i][2]), ti.index(b[j][2])] += 1
            ass = (cnt * cnt / np.maximum(1, gc[:, None] + tc[None] - cnt)).sum() / max(1, tp)
            det = tp / max(1, gc.sum() + tc.sum() - tp)
            r_ = got[s, alpha]
            assert r_.tp == tp
            assert r_.ass_a == pytest.approx(ass)
            assert r_.hota == pytest.approx((det * ass) ** 0.5)
            assert r_.loc_a == pytest.approx(max(1e-10, loc) / max(1e-10, tp))


def test_rollup_totals_equal_combined(spark):
    b = (0, 0, 10, 10)
    g = spark.createDataFrame([(s, f, 1, *b) for s in range(2) for f in range(3)], "seq long, frame long, gt_id long, x0 long, y0 long, x1 long, y1 long")
    t = g.where("frame > 0").withColumnRenamed("gt_id", "tk_id")
    sums = TM.hota_sums(g, t, ["seq"])
    roll = TM.combine(sums, ["seq"], "rollup").where("seq is null").orderBy("alpha").collect()
    flat = TM.combine(sums).orderBy("alpha").collect()
    assert [(r.alpha, r.tp, r.fn) for r in roll] == [(r.alpha, r.tp, r.fn) for r in flat]


def test_teta_perfect_tracker(spark):
    b = (0, 0, 10, 10)
    g = spark.createDataFrame([(1, f, 1, 7, *b) for f in range(4)], "seq long, frame long, gt_id long, cls long, x0 long, y0 long, x1 long, y1 long")
    t = g.withColumnRenamed("gt_id", "tk_id")
    r = TM.teta_scores(TM.teta_sums(g, t, ["seq"]), ["cls"]).first()
    assert (r.loc_a, r.assoc_a, r.cls_a, r.teta) == (1.0, 1.0, 1.0, 1.0)


def test_average_precision_over_slices(spark):
    """Many slices a class, ties of scores and a class without ground truth: the same as one plain ordered walk, with one row a matched detection."""
    r = random.Random(5)
    gt, dt = [], []
    for im in range(60):
        for k in range(4):
            b = box(r)
            gt.append((im, k, k % 2, *b))
            dt.append((im, k, k % 2, r.randrange(6), *jitter(r, b)))
        dt.append((im, 9, 7, 3, *box(r)))
    cols = "image_id long, {} long, category_id long, {}x0 long, y0 long, x1 long, y1 long"
    area = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")
    g, d = (spark.createDataFrame(rows, cols.format(*c)).select("*", area) for rows, c in ((gt, ("gt_id", "")), (dt, ("dt_id", "score long, "))))
    g = g.withColumn("iscrowd", F.lit(False))
    got = AP.evaluate(g, d).collect()
    assert {x.category_id for x in got} == {0, 1} and len(got) == 60
    for x in got:
        assert x.ap == pytest.approx(coco_ap(gt, dt, x.category_id, x.iou, *AP.AREAS[x.area_range]), abs=1e-9)
    keys = ["image_id", "category_id"]
    assert AP.match(g, d, keys).groupBy(*keys, "dt_id").count().where("count > 1").isEmpty()
    assert len(AP.evaluate(g.drop("category_id"), d.drop("category_id"), category=None).collect()) == 30


def test_one_against_many_takes_the_best():
    from slidemesh.operators.assign import solve
    one, many = np.zeros(4, dtype="int64"), np.arange(4)
    for r, c in ((one, many), (many, one)):
        assert solve(r, c, np.array([0.2, 0.9, 0.9, 0.1])).tolist() == [1]


def test_best_of_subsets_is_best_of_and_moves_rows_once(spark, images, monkeypatch):
    """The same rows as two scorings and their join, in the walk and, for images above its limit, by joins; no pair is written or dealt."""
    _, _, g, d = images
    im = spark.range(14).withColumnRenamed("id", "image_id")
    g = g.withColumn("iscrowd", F.col("gt_id") == 3)
    rows = lambda df: sorted((r.image_id, r.n_gt, r.n_dt, tuple(r.tp)) for r in df.collect())
    want = rows(CF.best_of([CF.per_image(im, g, d, 0.3), CF.per_image(im, g.where("gt_id % 2 = 0"), d, 0.3)]))
    both = [F.lit(True), F.expr("gt_id % 2 = 0")]
    assert len(want) == 14 and rows(CF.best_of_subsets(im, g, d, both, 0.3)) == want
    assert rows(CF.best_of_subsets(im, g.where("image_id < 0"), d, both, 0.3)) == rows(CF.best_of([CF.per_image(im, g.where("image_id < 0"), d, 0.3)] * 2))
    monkeypatch.setattr(CF, "WALK_BOXES", 5)
    assert rows(CF.best_of_subsets(im, g, d, both, 0.3)) == want


def test_registered_best_of_deals_few_rows(spark):
    """The rows of images are dealt a few times at most, not once a step and ground truth."""
    import __spark_entry__ as entry
    plan = entry.queries()["concept_f1_best_of"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
