"""Queries over frames of videos: bookkeeping, association, tracking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.operators import suppress as S
from slidemesh.operators import tracks as T
from slidemesh.plans import average_precision as AP
from slidemesh.plans import tracking_metrics as TM
from slidemesh.plans import views as V
from slidemesh.plans.registry import query, sql
from slidemesh.runtime import cut


def _track(spark, sf):
    return V.track_frames(spark, sf).select(F.col("video_id"), "track", F.col("frame_idx"), "matched", "x0", "y0", "x1", "y1")


@query("confirm_streak", sql("""SELECT video_id, track, frame_idx, hits - coalesce(max(CASE WHEN NOT matched THEN hits END) OVER w, 0) AS streak, bool_or(hits - coalesce(base, 0) >= 3) OVER w AS confirmed FROM (
 SELECT *, max(CASE WHEN NOT matched THEN hits END) OVER w AS base FROM (SELECT *, CAST(sum(matched::INT) OVER w AS BIGINT) AS hits FROM track_frames WINDOW w AS (PARTITION BY video_id, track ORDER BY frame_idx)) a WINDOW w AS (PARTITION BY video_id, track ORDER BY frame_idx)) b WINDOW w AS (PARTITION BY video_id, track ORDER BY frame_idx)""", "track_frames"))
def confirm_streak(spark, sf):
    return T.confirm_streaks(_track(spark, sf), ["video_id", "track"], 3).select("video_id", "track", "frame_idx", "streak", "confirmed")


@query("unmatched_runs", sql("""SELECT video_id, track, frame_idx, CAST(sum((NOT matched)::INT) OVER w AS BIGINT) AS unmatched, min(frame_idx) OVER (PARTITION BY video_id, track) AS first_frame FROM track_frames WINDOW w AS (PARTITION BY video_id, track ORDER BY frame_idx)""", "track_frames"))
def unmatched_runs(spark, sf):
    return T.unmatched_runs(_track(spark, sf), ["video_id", "track"]).select("video_id", "track", "frame_idx", "unmatched", "first_frame")


@query("keep_alive", sql("""SELECT video_id, track, frame_idx, CAST(v AS INTEGER) AS keep_alive FROM walk""", "track_frames", extra="""f AS (SELECT video_id, track, frame_idx, matched, row_number() OVER (PARTITION BY video_id, track ORDER BY frame_idx) AS rk FROM track_frames),
walk AS (SELECT video_id, track, frame_idx, rk, least(8, greatest(-4, CASE WHEN matched THEN 1 ELSE -1 END)) AS v FROM f WHERE rk = 1
 UNION ALL SELECT f.video_id, f.track, f.frame_idx, f.rk, least(8, greatest(-4, w.v + CASE WHEN f.matched THEN 1 ELSE -1 END)) FROM walk w JOIN f ON f.video_id = w.video_id AND f.track = w.track AND f.rk = w.rk + 1)""", recursive=True))
def keep_alive(spark, sf):
    return T.keep_alive(_track(spark, sf), ["video_id", "track"]).select("video_id", "track", "frame_idx", "keep_alive")


@query("frame_steps", sql("SELECT video_id, frame_idx * 2 AS frame_idx, frame_idx AS timestep FROM track_frames", "track_frames"))
def frame_steps(spark, sf):
    return T.frame_steps(_track(spark, sf).select("video_id", (F.col("frame_idx") * 2).alias("frame_idx"))).select("video_id", "frame_idx", "timestep")


def _dense(spark, sf):
    """Many tracks per frame: users are videos, blocks of ten events one frame, event types tracks (hull of their events)."""
    t = _track(spark, sf).withColumns({"frame": F.floor(F.col("frame_idx") / 10), "tid": F.length("track").cast("long")})
    return t.groupBy("video_id", "frame", "tid").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.bool_or("matched").alias("matched"))


_DENSE = """d AS (SELECT video_id, frame_idx // 10 AS frame, length(track) AS tid, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, bool_or(matched) AS matched FROM track_frames GROUP BY ALL),
g AS (SELECT video_id, frame, tid, x0, y0, x1, y1 FROM d), t AS (SELECT video_id, frame, (tid * 3) % 7 AS tid, x0 + frame % 4 * 5 AS x0, y0 + 3 AS y0, x1 + frame % 4 * 5 AS x1, y1 + 3 AS y1 FROM d WHERE matched)"""
_PAIR = """p AS (SELECT a.video_id, a.frame, a.tid AS gt_id, b.tid AS tk_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter,
 (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba FROM g a JOIN t b ON a.video_id = b.video_id AND a.frame = b.frame WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"""


def _gt_trk(spark, sf):
    d = cut(_dense(spark, sf))
    g = d.select("video_id", "frame", F.col("tid").alias("gt_id"), "x0", "y0", "x1", "y1")
    s = F.col("frame") % 4 * 5
    t = d.where("matched").select("video_id", "frame", ((F.col("tid") * 3) % 7).alias("tk_id"), (F.col("x0") + s).alias("x0"), (F.col("y0") + 3).alias("y0"), (F.col("x1") + s).alias("x1"), (F.col("y1") + 3).alias("y1"))
    return g, cut(t.dropDuplicates(["video_id", "frame", "tk_id"]))


@query("frame_similarity", sql("SELECT video_id, frame, gt_id, tk_id, round(inter / CAST(aa + ba - inter AS DOUBLE), 9) AS sim FROM p", "track_frames", extra=_DENSE + ",\n" + _PAIR))
def frame_similarity(spark, sf):
    g, t = _gt_trk(spark, sf)
    return TM.similarity(g, t, ["video_id"]).withColumn("sim", F.round("sim", 9))


@query("track_iou", sql("""SELECT i.video_id, i.gt_id, i.tk_id, round(i.inter / CAST(ga.s + ta.s - i.inter AS DOUBLE), 9) AS iou FROM (SELECT video_id, gt_id, tk_id, sum(inter) AS inter FROM p GROUP BY 1, 2, 3) i
 JOIN (SELECT video_id, tid, sum((x1 - x0) * (y1 - y0)) AS s FROM g GROUP BY 1, 2) ga ON ga.video_id = i.video_id AND ga.tid = i.gt_id JOIN (SELECT video_id, tid, sum((x1 - x0) * (y1 - y0)) AS s FROM t GROUP BY 1, 2) ta ON ta.video_id = i.video_id AND ta.tid = i.tk_id""", "track_frames", extra=_DENSE + ",\n" + _PAIR))
def track_iou(spark, sf):
    g, t = _gt_trk(spark, sf)
    one = F.lit(1)
    p = AP.video_pairs(g.withColumns({"category_id": one, "frame_idx": F.col("frame")}), t.withColumns({"category_id": one, "frame_idx": F.col("frame"), "dt_id": F.col("tk_id")}))
    return p.select("video_id", F.col("r").alias("gt_id"), F.col("c").alias("tk_id"), F.round("sim", 9).alias("iou"))


@query("new_and_unmatched", sql("""SELECT video_id, count(*) FILTER (kind = 'match') AS matches, count(*) FILTER (kind = 'lost') AS unmatched FROM (
 SELECT video_id, 'match' AS kind FROM p WHERE inter / CAST(aa + ba - inter AS DOUBLE) >= 0.5::DOUBLE UNION ALL
 SELECT t.video_id, 'lost' FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.video_id = t.video_id AND p.frame = t.frame AND p.tk_id = t.tid AND p.inter / CAST(p.aa + p.ba - p.inter AS DOUBLE) >= 0.5::DOUBLE)) q GROUP BY 1""", "track_frames", extra=_DENSE + ",\n" + _PAIR))
def new_and_unmatched(spark, sf):
    g, t = _gt_trk(spark, sf)
    m, _, u = T.associate(g.withColumnRenamed("gt_id", "det_id").withColumn("score", F.lit(0.9)), t.withColumnRenamed("tk_id", "trk_id"), ["video_id", "frame"])
    return (m.groupBy("video_id").agg(F.count(F.lit(1)).alias("matches")).join(u.groupBy("video_id").agg(F.count(F.lit(1)).alias("unmatched")), "video_id", "full").fillna(0))


@query("new_detections", sql("""SELECT g.video_id, g.frame, g.tid AS det_id FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.video_id = g.video_id AND p.frame = g.frame AND p.gt_id = g.tid AND p.inter / CAST(p.aa + p.ba - p.inter AS DOUBLE) >= 0.5::DOUBLE)
 AND (g.frame % 2 = 0 OR NOT EXISTS (SELECT 1 FROM t WHERE t.video_id = g.video_id AND t.frame = g.frame))""", "track_frames", extra=_DENSE + ",\n" + _PAIR))
def new_detections(spark, sf):
    g, t = _gt_trk(spark, sf)
    d = g.withColumnRenamed("gt_id", "det_id").withColumn("score", F.when(F.col("frame") % 2 == 0, 0.9).otherwise(0.2))
    return T.associate(d, t.withColumnRenamed("tk_id", "trk_id"), ["video_id", "frame"])[1].select("video_id", "frame", "det_id")


@query("refresh_candidates", sql("""SELECT video_id, frame, gt_id AS det_id, tk_id AS trk_id FROM (SELECT *, count(*) OVER (PARTITION BY video_id, frame, gt_id) AS nd, count(*) OVER (PARTITION BY video_id, frame, tk_id) AS nt FROM p WHERE inter / CAST(aa + ba - inter AS DOUBLE) >= 0.5::DOUBLE) q
 WHERE nd = 1 AND nt = 1 AND frame % 2 = 0""", "track_frames", extra=_DENSE + ",\n" + _PAIR))
def refresh_candidates(spark, sf):
    g, t = _gt_trk(spark, sf)
    d = g.withColumnRenamed("gt_id", "det_id").withColumn("score", F.when(F.col("frame") % 2 == 0, 0.9).otherwise(0.2))
    m, new, _ = T.associate(d, t.withColumnRenamed("tk_id", "trk_id"), ["video_id", "frame"])
    return T.refresh_candidates(m, d, new, ["video_id", "frame"], 0.8, 0.5).select("video_id", "frame", "det_id", "trk_id")


@query("boundary_filter", sql("SELECT video_id, frame, tid FROM g WHERE (x0 + x1) / 2.0 / 350 > 0.2 AND (x0 + x1) / 2.0 / 350 < 0.8 AND (y0 + y1) / 2.0 / 150 > 0.2 AND (y0 + y1) / 2.0 / 150 < 0.8", "track_frames", extra=_DENSE))
def boundary_filter(spark, sf):
    return _dense(spark, sf).where(~B.near_boundary(B.normalise(B.box(), F.lit(350.0), F.lit(150.0)), 0.2)).select("video_id", "frame", "tid")


@query("limited_new_objects", sql("SELECT video_id, frame, tid AS det_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY x0 DESC, tid DESC) AS z FROM g) q WHERE z <= 3 - 1", "track_frames", extra=_DENSE))
def limited_new_objects(spark, sf):
    d = _dense(spark, sf).select("video_id", "frame", F.col("tid").alias("det_id"), F.col("x0").alias("score"))
    have = d.select("video_id", "frame").distinct().withColumn("n", F.lit(1))
    return T.limit_new_objects(d, have, ["video_id", "frame"], 3).select("video_id", "frame", "det_id")


@query("sequence_counts", sql("SELECT video_id, count(*) AS dets, count(DISTINCT tid) AS ids FROM g GROUP BY 1", "track_frames", extra=_DENSE))
def sequence_counts(spark, sf):
    return TM.sequence_counts(_dense(spark, sf), ["video_id"], "tid")


@query("duplicate_track_ids", sql("SELECT video_id, frame_idx // 10 AS frame, length(track) AS tid, count(*) AS n FROM track_frames GROUP BY 1, 2, 3 HAVING count(*) > 1", "track_frames"))
def duplicate_track_ids(spark, sf):
    t = _track(spark, sf).select("video_id", F.floor(F.col("frame_idx") / 10).alias("frame"), F.length("track").cast("long").alias("tid"))
    return TM.duplicate_ids(t, ["video_id"], "tid")


@query("dense_track_ids", sql("SELECT DISTINCT video_id, tid, dense_rank() OVER (PARTITION BY video_id ORDER BY tid) - 1 AS track_id FROM g", "track_frames", extra=_DENSE))
def dense_track_ids(spark, sf):
    from slidemesh.operators.scan import dense_ids
    return dense_ids(_dense(spark, sf).select("video_id", "tid"), ["video_id"], "tid", "track_id").distinct()


@query("video_pair_ids", sql("SELECT video_id, tid AS category_id, row_number() OVER (ORDER BY video_id, tid) AS new_video_id FROM (SELECT DISTINCT video_id, tid FROM g) q", "track_frames", extra=_DENSE))
def video_pair_ids(spark, sf):
    g = _dense(spark, sf).select("video_id", F.col("tid").alias("category_id"))
    return AP.remap_pairs(g, g)


@query("track_nms")
def track_nms(spark, sf):
    """Whole-track suppression on summed overlap; suppressed tracks keep rows without boxes."""
    d = _dense(spark, sf).withColumnRenamed("tid", "track_id")
    out = S.track_nms(d.select("video_id", "track_id", F.col("frame").alias("frame_idx"), "x0", "y0", "x1", "y1"),
                      d.select("video_id", "track_id").distinct().withColumn("score", F.col("track_id") % 5), 0.2)
    return out.select("video_id", "track_id", "frame_idx", "x0", "y0", "x1", "y1")


@query("tracklets", sql("""SELECT v.video_id, v.tid AS track_id, f.frame AS frame_idx, CASE WHEN d.tid IS NULL THEN -1e8::DOUBLE ELSE CAST(d.x0 AS DOUBLE) END AS score, round(v.s, 9) AS track_score FROM (SELECT video_id, tid, avg(x0) AS s FROM g GROUP BY 1, 2) v
 JOIN (SELECT DISTINCT video_id, frame FROM g) f ON f.video_id = v.video_id LEFT JOIN g d ON d.video_id = v.video_id AND d.tid = v.tid AND d.frame = f.frame""", "track_frames", extra=_DENSE))
def tracklets(spark, sf):
    d = _dense(spark, sf)
    p = d.select("video_id", F.col("tid").alias("track_id"), F.col("frame").alias("frame_idx"), F.col("x0").cast("double").alias("score"), (F.col("x0") % 3).alias("label"), "x0", "y0", "x1", "y1")
    t = T.tracklets(p, d.select("video_id", F.col("frame").alias("frame_idx")).distinct())
    return t.select("video_id", "track_id", "frame_idx", "score", F.round("track_score", 9).alias("track_score"))


_HOTA = _DENSE + ",\n" + _PAIR + """,
sm AS (SELECT video_id, frame, gt_id, tk_id, inter / CAST(aa + ba - inter AS DOUBLE) AS sim FROM p),
gn AS (SELECT video_id, tid AS gt_id, count(*) AS gn FROM g GROUP BY 1, 2), tn AS (SELECT video_id, tid AS tk_id, count(*) AS tn FROM t GROUP BY 1, 2),
pot AS (SELECT video_id, gt_id, tk_id, sum(sim / (r + c - sim)) AS pp FROM (SELECT *, sum(sim) OVER (PARTITION BY video_id, frame, gt_id) AS r, sum(sim) OVER (PARTITION BY video_id, frame, tk_id) AS c FROM sm) q GROUP BY 1, 2, 3),
ga AS (SELECT *, pp / (gn + tn - pp) AS ga FROM pot JOIN gn USING (video_id, gt_id) JOIN tn USING (video_id, tk_id)),
ord AS (SELECT video_id, frame, o, row_number() OVER (PARTITION BY video_id, frame ORDER BY gt_id) AS k FROM (
 SELECT video_id, frame, gt_id, list({'g': gt_id, 'c': tk_id, 's': sim, 'v': ga * sim}) AS o FROM sm JOIN ga USING (video_id, gt_id, tk_id) GROUP BY 1, 2, 3) q),
walk AS (SELECT DISTINCT video_id, frame, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS DOUBLE) AS total, CAST([] AS STRUCT(g BIGINT, c BIGINT, s DOUBLE, v DOUBLE)[]) AS got FROM ord UNION ALL
 SELECT video_id, frame, k, used, total, got FROM (SELECT w.video_id, w.frame, n.k, w.used + CASE WHEN n.x IS NULL THEN 0 ELSE CAST(1 AS BIGINT) << n.x.c END AS used, w.total + coalesce(n.x.v, 0) AS total, CASE WHEN n.x IS NULL THEN w.got ELSE list_append(w.got, n.x) END AS got
  FROM walk w JOIN (SELECT video_id, frame, k, unnest(list_append(o, NULL)) AS x FROM ord) n ON n.video_id = w.video_id AND n.frame = w.frame AND n.k = w.k + 1 AND (n.x IS NULL OR (w.used >> n.x.c) % 2 = 0)) q
 QUALIFY row_number() OVER (PARTITION BY video_id, frame, used ORDER BY total DESC) = 1),
mt AS (SELECT video_id, frame, unnest(arg_max(got, k * 100 + total), recursive := true) FROM walk GROUP BY 1, 2),
al AS (SELECT round(0.05::DOUBLE * (i + 1), 2) AS alpha FROM range(19) r(i)),
pr AS (SELECT video_id, g AS gt_id, c AS tk_id, alpha, count(*) FILTER (s >= alpha - 2.220446049250313e-16::DOUBLE) AS m, coalesce(sum(s) FILTER (s >= alpha - 2.220446049250313e-16::DOUBLE), 0) AS l FROM mt, al GROUP BY 1, 2, 3, 4),
sums AS (SELECT video_id, alpha, sum(m) AS tp, sum(l) AS loc, sum(m * m / CAST(greatest(1, gn + tn - m) AS DOUBLE)) AS ass, sum(m * m / CAST(gn AS DOUBLE)) AS re, sum(m * m / CAST(tn AS DOUBLE)) AS prc FROM pr JOIN gn USING (video_id, gt_id) JOIN tn USING (video_id, tk_id) GROUP BY 1, 2),
parts AS (SELECT video_id, alpha, coalesce(tp, 0) AS tp, coalesce(ng, 0) - coalesce(tp, 0) AS fn, coalesce(nt, 0) - coalesce(tp, 0) AS fp, coalesce(loc, 0) AS loc, coalesce(ass, 0) AS ass, coalesce(re, 0) AS re, coalesce(prc, 0) AS prc
 FROM (SELECT video_id, count(*) AS ng FROM g GROUP BY 1) a FULL JOIN (SELECT video_id, count(*) AS nt FROM t GROUP BY 1) b USING (video_id) CROSS JOIN al LEFT JOIN sums USING (video_id, alpha))"""
_HOTA_COLS = """CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, round(det, 9) AS det_a, round(dre, 9) AS det_re, round(dpr, 9) AS det_pr, round(asa, 9) AS ass_a, round(re / greatest(1, tp), 9) AS ass_re, round(prc / greatest(1, tp), 9) AS ass_pr,
 round(greatest(1e-10::DOUBLE, loc) / greatest(1e-10::DOUBLE, CAST(tp AS DOUBLE)), 9) AS loc_a, round(sqrt(det * asa), 9) AS hota, round(sqrt(dre * asa), 9) AS owta"""
_HOTA_RATIOS = "CAST(tp AS DOUBLE) / greatest(1, tp + fn + fp) AS det, CAST(tp AS DOUBLE) / greatest(1, tp + fn) AS dre, CAST(tp AS DOUBLE) / greatest(1, tp + fp) AS dpr, ass / greatest(1, tp) AS asa"


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("hota_per_video", sql(f"SELECT video_id, alpha, {_HOTA_COLS} FROM (SELECT *, {_HOTA_RATIOS} FROM parts) q", "track_frames", extra=_HOTA, recursive=True))
def hota_per_video(spark, sf):
    g, t = _gt_trk(spark, sf)
    return _rounded(TM.hota_scores(TM.hota_sums(g, t, ["video_id"])))


@query("hota_combined", sql(f"""SELECT alpha, {_HOTA_COLS} FROM (SELECT *, {_HOTA_RATIOS} FROM (
 SELECT alpha, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(loc) AS loc, sum(ass) AS ass, sum(re) AS re, sum(prc) AS prc FROM parts GROUP BY 1) p) q""", "track_frames", extra=_HOTA, recursive=True))
def hota_combined(spark, sf):
    g, t = _gt_trk(spark, sf)
    return _rounded(TM.hota_scores(TM.combine(TM.hota_sums(g, t, ["video_id"]))))


@query("teta")
def teta(spark, sf):
    g, t = _gt_trk(spark, sf)
    return TM.teta_scores(TM.teta_sums(g.withColumn("cls", F.col("gt_id") % 3), t.withColumn("cls", F.col("tk_id") % 3), ["video_id"]), ["cls"])


@query("pruned_tracker_boxes")
def pruned_tracker_boxes(spark, sf):
    g, t = _gt_trk(spark, sf)
    fr = t.select("video_id", "frame").distinct().withColumns({"not_exhaustive": F.col("frame") % 2 == 0, "negative": F.lit(False)})
    return TM.prune_unmatched(g.where("gt_id % 2 = 0"), t, fr, ["video_id"]).select("video_id", "frame", "tk_id")


@query("video_ap")
def video_ap(spark, sf):
    g, t = _gt_trk(spark, sf)
    gf = g.select("video_id", F.col("frame").alias("frame_idx"), F.lit(1).alias("category_id"), "gt_id", "x0", "y0", "x1", "y1")
    df = t.select("video_id", F.col("frame").alias("frame_idx"), F.lit(1).alias("category_id"), F.col("tk_id").alias("dt_id"), "x0", "y0", "x1", "y1")
    gt = AP.tracks_of(gf, "gt_id", []).withColumn("iscrowd", F.lit(False))
    dt = AP.tracks_of(df, "dt_id", []).withColumn("score", F.col("dt_id"))
    return AP.evaluate(gt, dt, "video_id", "category_id", AP.VIDEO_AREAS, pairs=AP.video_pairs(gf, df))


def _phrases(spark, sf):
    g, t = _gt_trk(spark, sf)
    area = B.area(B.box())
    return (g.withColumn("category_id", F.col("gt_id") % 2),
            t.withColumns({"category_id": F.col("tk_id") % 2, "area": area, "score": F.when(F.col("tk_id") % 5 == 4, 0.3).otherwise(0.9)}))


@query("phrase_hota")
def phrase_hota(spark, sf):
    from slidemesh.plans import video_eval as VE
    g, t = _phrases(spark, sf)
    return TM.mean_over_alpha(TM.hota_scores(TM.combine(VE.phrase_hota(g, t))))


@query("class_agnostic_hota")
def class_agnostic_hota(spark, sf):
    from slidemesh.plans import video_eval as VE
    g, t = _phrases(spark, sf)
    return TM.hota_scores(TM.combine(VE.class_agnostic_hota(g, t)))


@query("video_concept_f1")
def video_concept_f1(spark, sf):
    from slidemesh.plans import concept_f1 as CF
    from slidemesh.plans import video_eval as VE
    g, t = _phrases(spark, sf)
    gf, df = g.withColumn("frame_idx", F.col("frame")), t.withColumns({"frame_idx": F.col("frame"), "dt_id": F.col("tk_id")})
    s = df.select("video_id", "category_id", "dt_id", "score").distinct()
    return CF.accumulate(VE.video_concept_f1(gf, df, s))
