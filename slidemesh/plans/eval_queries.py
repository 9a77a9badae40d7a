"""Queries over ground truth and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.plans import average_precision as AP
from slidemesh.plans import concept_f1 as CF
from slidemesh.plans import views as V
from slidemesh.plans.registry import A_AREA, B_AREA, HIT, INTER, IOU, query, sql


def _sets(spark, sf):
    c = V.components(spark, sf)
    return V.ground_truth(c).withColumn("iscrowd", F.lit(False)), V.detections(c)


@query("gt_dt_iou", sql(f"SELECT a.image_id, a.gt_id, b.dt_id, round({IOU}, 9) AS iou FROM gt a JOIN dt b ON a.image_id = b.image_id WHERE {HIT}", "components", "gt", "dt"))
def gt_dt_iou(spark, sf):
    gt, dt = _sets(spark, sf)
    return CF.gt_dt_pairs(gt, dt).select("image_id", F.col("r").alias("gt_id"), F.col("c").alias("dt_id"), F.round("sim", 9).alias("iou"))


@query("crowd_iou", sql(f"SELECT a.image_id, a.gt_id, b.dt_id, round(CASE WHEN a.iscrowd THEN CAST({INTER} AS DOUBLE) / ({B_AREA}) ELSE {IOU} END, 9) AS iou FROM gt a JOIN dt b ON a.image_id = b.image_id WHERE {HIT}", "components", "gt", "dt"))
def crowd_iou(spark, sf):
    c = V.components(spark, sf)
    return CF.gt_dt_pairs(V.ground_truth(c), V.detections(c)).select("image_id", F.col("r").alias("gt_id"), F.col("c").alias("dt_id"), F.round("sim", 9).alias("iou"))


def _scored(spark, sf):
    gt, dt = _sets(spark, sf)
    images = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    return CF.per_image(images, gt, dt, 5000)


# the assignment of largest total IoU per image: ground truth boxes one by one, the best total for every set of used detections
_BEST = f"""c1 AS (SELECT a.image_id, a.gt_id, list({{'c': b.dt_id, 's': {IOU}}}) AS o FROM gt a JOIN dt b ON a.image_id = b.image_id AND b.score >= 5000 WHERE {HIT} GROUP BY 1, 2),
ord AS (SELECT image_id, o, row_number() OVER (PARTITION BY image_id ORDER BY gt_id) AS k FROM c1),
walk AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS DOUBLE) AS total, CAST([] AS DOUBLE[]) AS sims FROM ord UNION ALL
 SELECT image_id, k, used, total, sims FROM (SELECT v.image_id, n.k, v.used + CASE WHEN n.x IS NULL THEN 0 ELSE CAST(1 AS BIGINT) << n.x.c END AS used, v.total + coalesce(n.x.s, 0) AS total, CASE WHEN n.x IS NULL THEN v.sims ELSE list_append(v.sims, n.x.s) END AS sims
  FROM walk v JOIN (SELECT image_id, k, unnest(list_append(o, NULL)) AS x FROM ord) n ON n.image_id = v.image_id AND n.k = v.k + 1 AND (n.x IS NULL OR (v.used >> n.x.c) % 2 = 0)) q
 QUALIFY row_number() OVER (PARTITION BY image_id, used ORDER BY total DESC) = 1),
top AS (SELECT image_id, arg_max(sims, k * 100 + total) AS sims FROM walk GROUP BY 1),
cnt AS (SELECT o.o_orderkey AS image_id, coalesce(g.n, 0) AS n_gt, coalesce(d.n, 0) AS n_dt, coalesce(top.sims, []) AS sims FROM orders o LEFT JOIN (SELECT image_id, count(*) AS n FROM gt GROUP BY 1) g ON g.image_id = o.o_orderkey
 LEFT JOIN (SELECT image_id, count(*) AS n FROM dt WHERE score >= 5000 GROUP BY 1) d ON d.image_id = o.o_orderkey LEFT JOIN top ON top.image_id = o.o_orderkey),
per AS (SELECT image_id, n_gt, n_dt, i, round(0.5::DOUBLE + 0.05::DOUBLE * i, 2) AS iou, len(list_filter(sims, lambda s: s >= round(0.5::DOUBLE + 0.05::DOUBLE * i, 2))) AS tp FROM cnt, range(10) r(i)),
loc AS (SELECT *, n_dt - tp AS fp, n_gt - tp AS fn, tp / (n_dt + 1e-4::DOUBLE) AS pr, tp / (n_gt + 1e-4::DOUBLE) AS re FROM per),
tot AS (SELECT i, iou, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(CASE WHEN n_gt > 0 THEN fp ELSE 0 END) AS BIGINT) AS pfp, sum(CASE WHEN n_gt > 0 AND n_dt > 0 THEN 2 * pr * re / (pr + re + 1e-4::DOUBLE) ELSE 0 END) AS lf,
 count(*) FILTER (n_gt > 0 AND n_dt > 0)::DOUBLE AS a, count(*) FILTER (n_gt = 0 AND n_dt > 0)::DOUBLE AS b, count(*) FILTER (n_gt > 0 AND n_dt = 0)::DOUBLE AS c, count(*) FILTER (n_gt = 0 AND n_dt = 0)::DOUBLE AS n FROM loc GROUP BY 1, 2)"""


@query("concept_f1_images", sql("SELECT image_id, n_gt, n_dt, CAST(max(tp) FILTER (i = 0) AS BIGINT) AS tp50, CAST(max(tp) FILTER (i = 5) AS BIGINT) AS tp75 FROM per GROUP BY 1, 2, 3", "components", "gt", "dt", extra=_BEST, recursive=True))
def concept_f1_images(spark, sf):
    """Matching counts per image; orders without lines are empty images."""
    s = _scored(spark, sf)
    return s.select("image_id", "n_gt", "n_dt", F.col("tp")[0].alias("tp50"), F.col("tp")[5].alias("tp75"))


@query("concept_f1", sql("""SELECT iou, tp, fp, fn, pfp AS positive_micro_fp, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r + 1e-4::DOUBLE), 9) AS f1, round(pm, 9) AS positive_micro_f1, round(lf / a, 9) AS positive_macro_f1,
 round(mcc, 9) AS il_mcc, round(pm * mcc, 9) AS cgf1 FROM (SELECT *, 2 * pp * r / (pp + r + 1e-4::DOUBLE) AS pm, (a * n - b * c) / (sqrt((a + b) * (a + c) * (n + b) * (n + c)) + 1e-6::DOUBLE) AS mcc FROM (
 SELECT *, tp / (tp + fp + 1e-4::DOUBLE) AS p, tp / (tp + fn + 1e-4::DOUBLE) AS r, tp / (tp + pfp + 1e-4::DOUBLE) AS pp FROM tot) x) y""", "components", "gt", "dt", extra=_BEST, recursive=True))
def concept_f1(spark, sf):
    a = CF.accumulate(_scored(spark, sf))
    return a.select(F.round("iou", 2).alias("iou"), "tp", "fp", "fn", "positive_micro_fp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "positive_micro_f1", "positive_macro_f1", "il_mcc", "cgf1")])


# where every image has at most one box a side the matching is forced and SQL can state the whole metric
_ONE = f"""g1 AS (SELECT image_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM gt GROUP BY 1), d1 AS (SELECT image_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM dt WHERE score >= 5000 GROUP BY 1),
per AS (SELECT o.o_orderkey AS image_id, (g.image_id IS NOT NULL)::INT AS n_gt, (d.image_id IS NOT NULL)::INT AS n_dt,
 CASE WHEN g.x0 < d.x1 AND d.x0 < g.x1 AND g.y0 < d.y1 AND d.y0 < g.y1 THEN CAST((least(g.x1, d.x1) - greatest(g.x0, d.x0)) * (least(g.y1, d.y1) - greatest(g.y0, d.y0)) AS DOUBLE)
  / ((g.x1 - g.x0) * (g.y1 - g.y0) + (d.x1 - d.x0) * (d.y1 - d.y0) - (least(g.x1, d.x1) - greatest(g.x0, d.x0)) * (least(g.y1, d.y1) - greatest(g.y0, d.y0))) ELSE 0 END AS iou
 FROM orders o LEFT JOIN g1 g ON g.image_id = o.o_orderkey LEFT JOIN d1 d ON d.image_id = o.o_orderkey),
th AS (SELECT CAST(0.5 AS DOUBLE) + 0.05::DOUBLE * i AS t, i FROM range(10) r(i)),
acc AS (SELECT i, CAST(sum((iou >= round(t, 2))::INT) AS BIGINT) AS tp, CAST(sum(n_dt - (iou >= round(t, 2))::INT) AS BIGINT) AS fp, CAST(sum(n_gt - (iou >= round(t, 2))::INT) AS BIGINT) AS fn,
 count(*) FILTER (n_gt = 1 AND n_dt = 1) AS itp, count(*) FILTER (n_gt = 0 AND n_dt = 1) AS ifp, count(*) FILTER (n_gt = 0 AND n_dt = 0) AS itn, count(*) FILTER (n_gt = 1 AND n_dt = 0) AS ifn,
 CAST(sum(CASE WHEN n_gt = 1 THEN n_dt - (iou >= round(t, 2))::INT ELSE 0 END) AS BIGINT) AS pfp FROM per, th GROUP BY i)"""


@query("concept_f1_single", sql("""SELECT round(0.5::DOUBLE + 0.05::DOUBLE * i, 2) AS iou, tp, fp, fn, round(tp / (tp + fp + 1e-4::DOUBLE), 9) AS prec, round(tp / (tp + fn + 1e-4::DOUBLE), 9) AS rec,
round((CAST(itp AS DOUBLE) * itn - CAST(ifp AS DOUBLE) * ifn) / (sqrt(CAST(itp + ifp AS DOUBLE) * (itp + ifn) * (itn + ifp) * (itn + ifn)) + 1e-6::DOUBLE), 9) AS mcc,
round(2 * (tp / (tp + pfp + 1e-4::DOUBLE)) * (tp / (tp + fn + 1e-4::DOUBLE)) / ((tp / (tp + pfp + 1e-4::DOUBLE)) + (tp / (tp + fn + 1e-4::DOUBLE)) + 1e-4::DOUBLE), 9) AS pmf1 FROM acc""", "components", "gt", "dt", extra=_ONE))
def concept_f1_single(spark, sf):
    """The hull of each image's boxes against the hull of its confident detections: the same metric where matching is forced."""
    gt, dt = _sets(spark, sf)
    hull = [F.min("label").alias("label"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    gt = gt.groupBy("image_id").agg(F.lit(0).alias("gt_id"), *hull).withColumn("iscrowd", F.lit(False))
    dt = dt.where("score >= 5000").groupBy("image_id").agg(F.lit(0).alias("dt_id"), F.max("score").alias("score"), *hull)
    images = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    a = CF.accumulate(CF.per_image(images, gt, dt, 5000))
    return a.select(F.round("iou", 2).alias("iou"), "tp", "fp", "fn", F.round("precision", 9).alias("prec"), F.round("recall", 9).alias("rec"), F.round("il_mcc", 9).alias("mcc"), F.round("positive_micro_f1", 9).alias("pmf1"))


@query("concept_f1_best_of")
def concept_f1_best_of(spark, sf):
    """Two ground truths (all boxes; those of the first iteration), the better one per image."""
    gt, dt = _sets(spark, sf)
    images = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    best = CF.best_of_subsets(images, gt, dt, [F.lit(True), F.expr("gt_id % 2 = 0")], 5000)
    return CF.summarise(CF.accumulate(best), ["cgf1", "f1", "positive_micro_f1", "positive_macro_f1"])


@query("demo_f1", sql("""SELECT round(avg(perfect::INT), 9) AS image_perfect, round(avg(CASE WHEN n_dt > 0 THEN f ELSE 0 END) FILTER (n_gt > 0), 9) AS macro_f1_all, round(avg(f) FILTER (n_gt > 0 AND n_dt > 0), 9) AS macro_f1_with_detections FROM (
 SELECT image_id, n_gt, n_dt, bool_or(i = 0 AND tp = n_gt AND tp = n_dt) AS perfect, CASE WHEN n_gt = 0 AND n_dt = 0 THEN 1 ELSE avg(2 * pr * re / (pr + re + 1e-4::DOUBLE)) END AS f FROM loc GROUP BY 1, 2, 3) q""", "components", "gt", "dt", extra=_BEST, recursive=True))
def demo_f1(spark, sf):
    d = CF.demo_summary(_scored(spark, sf))
    return d.select(*[F.round(c, 9).alias(c) for c in d.columns])


@query("exhaustive_predictions", sql("SELECT image_id, dt_id FROM dt WHERE image_id % 3 <> 0 AND image_id % 5 <> 0", "components", "dt"))
def exhaustive_predictions(spark, sf):
    gt, dt = _sets(spark, sf)
    flags = [gt.select("image_id", (F.col("image_id") % k != 0).alias("is_instance_exhaustive")) for k in (3, 5)]
    return CF.exhaustive_only(dt, flags).select("image_id", "dt_id")


@query("positive_split", sql("SELECT image_id, dt_id FROM dt WHERE EXISTS (SELECT 1 FROM gt WHERE gt.image_id = dt.image_id AND gt.label = dt.label AND gt.gt_id % 2 = 0)", "components", "gt", "dt"))
def positive_split(spark, sf):
    gt, dt = _sets(spark, sf)
    return CF.positive_split(dt.withColumnRenamed("label", "category_id"), gt.where("gt_id % 2 = 0").withColumnRenamed("label", "category_id")).select("image_id", "dt_id")


@query("not_evaluated", sql("SELECT o_orderkey AS image_id FROM orders EXCEPT SELECT image_id FROM gt", "components", "gt"))
def not_evaluated(spark, sf):
    gt, _ = _sets(spark, sf)
    return CF.check_evaluated(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id")), gt)


_HULL = "((greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)))::DOUBLE"
_BOTH = f"CASE WHEN {HIT} THEN {INTER} ELSE 0 END"
_UNION = f"({A_AREA} + {B_AREA} - {_BOTH})"


@query("box_quality", sql(f"""SELECT count(*) AS n, round(avg(coalesce(iou, 0)), 9) AS mean_iou, round(avg((coalesce(iou, 0) >= 0.5::DOUBLE)::INT), 9) AS share_50, round(avg((coalesce(iou, 0) >= 0.75::DOUBLE)::INT), 9) AS share_75,
 round(avg(l1), 9) AS mean_l1, round(avg(giou), 9) AS mean_giou FROM gt LEFT JOIN (
 SELECT a.image_id, a.gt_id, CAST({_BOTH} AS DOUBLE) / {_UNION} AS iou, CAST({_BOTH} AS DOUBLE) / {_UNION} - ({_HULL} - {_UNION}) / {_HULL} AS giou,
  abs((a.x0 + a.x1) / 2.0::DOUBLE - (b.x0 + b.x1) / 2.0::DOUBLE) + abs((a.y0 + a.y1) / 2.0::DOUBLE - (b.y0 + b.y1) / 2.0::DOUBLE) + abs(a.x1 - a.x0 - b.x1 + b.x0) + abs(a.y1 - a.y0 - b.y1 + b.y0) AS l1
 FROM gt a JOIN dt b ON a.image_id = b.image_id QUALIFY row_number() OVER (PARTITION BY a.image_id, a.gt_id ORDER BY CAST({_BOTH} AS DOUBLE) / {_UNION} DESC, b.dt_id) = 1) m ON m.image_id = gt.image_id AND m.gt_id = gt.gt_id""", "components", "gt", "dt"))
def box_quality(spark, sf):
    gt, dt = _sets(spark, sf)
    return CF.box_quality(gt, dt).select("n", *[F.round(c, 9).alias(c) for c in ("mean_iou", "share_50", "share_75", "mean_l1", "mean_giou")])


def _coco(spark, sf):
    c = V.components(spark, sf)
    gt = V.ground_truth(c).withColumn("area", B.area(B.box())).withColumnRenamed("label", "category_id")
    return gt, V.detections(c).withColumn("area", B.area(B.box())).withColumnRenamed("label", "category_id")


def _ap_sql(max_dets: int) -> str:
    """Average precision per label, area range and threshold, stated from the metric's definition: detections of an image and label are walked
    by score; each takes the free ground truth of highest IoU, counted ones before ignored ones, the later one on ties; crowds stay free."""
    return f"""cells AS (SELECT a.name AS area_range, a.lo, a.hi, i, CAST(0.5 AS DOUBLE) + 0.05::DOUBLE * i AS t FROM (VALUES ('all', 0, 1e10), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 1e10)) a(name, lo, hi), range(10) r(i)),
ds AS (SELECT * FROM (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, dt_id) AS z FROM dt) q WHERE z <= {max_dets}),
prs AS (SELECT a.image_id, a.label, b.dt_id, b.score, a.gt_id, {A_AREA} AS g_area, a.iscrowd, CASE WHEN a.iscrowd THEN CAST({INTER} AS DOUBLE) / ({B_AREA}) ELSE {IOU} END AS sim
 FROM gt a JOIN ds b ON a.image_id = b.image_id AND a.label = b.label WHERE {HIT}),
opt AS (SELECT image_id, label, dt_id, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, dt_id) AS k, o FROM (
 SELECT image_id, label, dt_id, score, list({{'sim': sim, 'gt': gt_id, 'area': g_area, 'crowd': iscrowd}}) AS o FROM prs WHERE sim >= 0.5::DOUBLE GROUP BY ALL) q),
walk AS (SELECT DISTINCT image_id, label, area_range, lo, hi, i, round(t, 2) AS t, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS dt_id, CAST([] AS BIGINT[]) AS taken, 0 AS state FROM opt, cells UNION ALL
 SELECT image_id, label, area_range, lo, hi, i, t, k, dt_id, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best.gt) END, CASE WHEN best IS NULL THEN 0 WHEN best.reg THEN 1 ELSE 2 END FROM (
  SELECT w.image_id, w.label, w.area_range, w.lo, w.hi, w.i, w.t, d.k, d.dt_id, w.taken, list_sort(list_transform(list_filter(d.o, lambda x: x.sim >= w.t AND (x.crowd OR NOT list_contains(w.taken, x.gt))),
    lambda x: {{'reg': NOT (x.crowd OR x.area < w.lo OR x.area > w.hi), 'sim': x.sim, 'gt': x.gt}}))[-1] AS best FROM walk w JOIN opt d ON d.image_id = w.image_id AND d.label = w.label AND d.k = w.k + 1) q),
flag AS (SELECT d.label, c.area_range, c.i, d.score, d.image_id, d.dt_id, coalesce(w.state, 0) = 1 AS tp, coalesce(w.state, 0) = 0 AND d.area >= c.lo AND d.area <= c.hi AS fp
 FROM ds d CROSS JOIN cells c LEFT JOIN walk w ON w.image_id = d.image_id AND w.label = d.label AND w.dt_id = d.dt_id AND w.area_range = c.area_range AND w.i = c.i),
ran AS (SELECT label, area_range, i, tp, sum(tp::INT) OVER s AS ctp, sum(fp::INT) OVER s AS cfp FROM flag WINDOW s AS (PARTITION BY label, area_range, i ORDER BY score DESC, image_id, dt_id ROWS UNBOUNDED PRECEDING)),
num AS (SELECT label, area_range, i, count(*) AS n FROM (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM gt WHERE NOT iscrowd) g JOIN cells c ON g.area >= c.lo AND g.area <= c.hi GROUP BY ALL),
pts AS (SELECT r.label, r.area_range, r.i, CAST(floor(ctp / CAST(n AS DOUBLE) * 100 + 1e-9::DOUBLE) AS INT) AS pt, max(ctp / CAST(ctp + cfp AS DOUBLE)) AS p, max(ctp / CAST(n AS DOUBLE)) AS rec FROM ran r JOIN num USING (label, area_range, i) WHERE tp GROUP BY ALL),
env AS (SELECT label, area_range, i, g.k, coalesce(max(p) FILTER (pt >= g.k), 0) AS p, max(rec) AS rec FROM num LEFT JOIN pts USING (label, area_range, i), range(101) g(k) GROUP BY ALL),
ap AS (SELECT label AS category_id, area_range, 0.5::DOUBLE + 0.05::DOUBLE * i AS iou, sum(p) / 101 AS ap, coalesce(max(rec), 0) AS ar FROM env GROUP BY ALL)"""


_AP_COLS = ("ap", "ar")


@query("ap_per_class", sql("SELECT category_id, area_range, round(iou, 2) AS iou, round(ap, 9) AS ap, round(ar, 9) AS ar FROM ap", "components", "gt", "dt", extra=_ap_sql(100), recursive=True))
def ap_per_class(spark, sf):
    gt, dt = _coco(spark, sf)
    return AP.evaluate(gt, dt).select("category_id", "area_range", F.round("iou", 2).alias("iou"), *[F.round(c, 9).alias(c) for c in _AP_COLS])


@query("ap_summary", sql("""SELECT area_range, round(avg(ap), 9) AS ap, round(avg(ap) FILTER (round(iou, 2) = 0.5::DOUBLE), 9) AS ap50, round(avg(ap) FILTER (round(iou, 2) = 0.75::DOUBLE), 9) AS ap75, round(avg(ar), 9) AS ar FROM ap GROUP BY 1""",
                            "components", "gt", "dt", extra=_ap_sql(10), recursive=True))
def ap_summary(spark, sf):
    gt, dt = _coco(spark, sf)
    return AP.summary(AP.evaluate(gt, dt, max_dets=10)).select("area_range", *[F.round(c, 9).alias(c) for c in ("ap", "ap50", "ap75", "ar")])


@query("ap_by_rarity", sql("""SELECT bucket, round(v, 9) AS ap FROM (SELECT bucket, avg(ap) AS v FROM b GROUP BY 1 UNION ALL SELECT NULL, avg(v) FROM (SELECT avg(ap) AS v FROM b GROUP BY bucket) q) z""", "components", "gt", "dt", recursive=True,
                              extra=_ap_sql(100) + """,
b AS (SELECT CASE WHEN n % 2 = 0 THEN 'frequent' ELSE 'rare' END AS bucket, ap FROM ap JOIN (SELECT label AS category_id, count(*) AS n FROM gt GROUP BY 1) c USING (category_id) WHERE area_range = 'all')"""))
def ap_by_rarity(spark, sf):
    gt, dt = _coco(spark, sf)
    counts = gt.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    per = AP.bucket_summary(AP.evaluate(gt, dt), counts.select("category_id", F.when(F.col("n") % 2 == 0, "frequent").otherwise("rare").alias("bucket")))
    return per.select("bucket", F.round("ap", 9).alias("ap"))


@query("ap_curve", sql("""SELECT label, round(sum(p) / 101, 9) AS ap, round(max(rec), 9) AS ar FROM (SELECT c.label, r.i, coalesce(max(c.prec) FILTER (c.rec + 1e-9::DOUBLE >= r.i / 100.0::DOUBLE), 0) AS p, max(c.rec) AS rec FROM (
 SELECT d.label, ctp / CAST(ctp + cfp AS DOUBLE) AS prec, ctp / CAST(n AS DOUBLE) AS rec FROM (SELECT label, sum(tp) OVER w AS ctp, sum(1 - tp) OVER w AS cfp FROM flagged WINDOW w AS (PARTITION BY label ORDER BY score DESC, image_id, dt_id)) d
 JOIN (SELECT label, count(*) AS n FROM gt GROUP BY 1) g ON g.label = d.label) c, range(101) r(i) GROUP BY 1, 2) t GROUP BY 1""", "components", "gt", "dt",
                          extra="flagged AS (SELECT label, score, image_id, dt_id, (dt_id % 3 <> 0)::INT AS tp FROM dt)"))
def ap_curve(spark, sf):
    """Curve and interpolation on given match flags (no matching step)."""
    c = V.components(spark, sf)
    m = V.detections(c).select("label", "score", "image_id", "dt_id", (F.col("dt_id") % 3 != 0).alias("tp"), F.lit(False).alias("ignore"))
    n = V.ground_truth(c).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return AP.average_precision(m, n, ["label"], ["-score", "image_id", "dt_id"]).select("label", F.round("ap", 9).alias("ap"), F.round("ar", 9).alias("ar"))


@query("first_shard_predictions", sql("SELECT image_id, dt_id FROM (SELECT *, min((dt_id * 7 + image_id) % 3) OVER (PARTITION BY image_id) AS m FROM dt) t WHERE (dt_id * 7 + image_id) % 3 = m", "components", "dt"))
def first_shard_predictions(spark, sf):
    d = V.detections(V.components(spark, sf)).withColumn("shard", (F.col("dt_id") * 7 + F.col("image_id")) % 3)
    return AP.first_shard(d, ["image_id"]).select("image_id", "dt_id")


@query("detection_counts", sql("SELECT image_id, count(*) FILTER (1 / (1 + exp(-(score - 5000) / 1000.0::DOUBLE)) * 0.9::DOUBLE > 0.5::DOUBLE) AS n FROM dt GROUP BY 1", "components", "dt"))
def detection_counts(spark, sf):
    d = V.detections(V.components(spark, sf))
    s = 1 / (1 + F.exp(-(F.col("score") - 5000) / 1000.0)) * 0.9
    return d.groupBy("image_id").agg(F.count_if(s > 0.5).alias("n"))


@query("category_ids_shifted", sql("""SELECT slide_id + CASE WHEN (SELECT count(*) FROM components WHERE slide_id = 0) > 0 THEN 1 ELSE 0 END AS image_id, pos + 1 AS ann_id FROM components""", "components"))
def category_ids_shifted(spark, sf):
    from slidemesh.sources.coco import shift_to_one_based
    c = V.components(spark, sf)
    images = c.select(F.col("slide_id").alias("id")).distinct()
    _, _, ann = shift_to_one_based(images, spark.range(1, 2), c.select(F.col("pos").alias("id"), F.col("slide_id").alias("image_id"), F.lit(1).alias("category_id")))
    return ann.select("image_id", F.col("id").alias("ann_id"))
