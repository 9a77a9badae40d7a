"""Video evaluators composed of the tracking metrics: phrase, class and class-agnostic HOTA, TETA front end, video concept F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.operators.assign import best_assignment
from slidemesh.operators.scan import dense_ids
from slidemesh.operators.suppress import frame_nms, track_nms
from slidemesh.plans import average_precision as AP
from slidemesh.plans import concept_f1 as CF
from slidemesh.plans import tracking_metrics as TM
from slidemesh.runtime import cut

PAIR = ["video_id", "category_id"]


def phrase_hota(gt: DataFrame, dt: DataFrame, min_score: float = 0.5) -> DataFrame:
    """HOTA with every (video, phrase) as a sequence of its own; frames as rows (frame, area, score, box)."""
    return TM.hota_sums(gt, TM.drop_empty_frames(dt, min_score), PAIR)


def class_hota(gt: DataFrame, dt: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Scores per class over all videos; `class_average` of TM gives the mean."""
    return TM.hota_scores(TM.combine(phrase_hota(gt, dt, min_score), ["category_id"]))


def class_agnostic_hota(gt: DataFrame, dt: DataFrame, min_score: float = 0.5, nms: float = 0.5) -> DataFrame:
    """All classes as one: track suppression at IoU 0.5, then track ids made unique per video."""
    d = TM.drop_empty_frames(dt.withColumn("_s", F.col("score")), min_score)
    gid = dense_ids(gt.withColumn("_id", F.struct("category_id", "gt_id")), ["video_id"], "_id", "_k").drop("gt_id").withColumnRenamed("_k", "gt_id")
    did = dense_ids(d.withColumn("_id", F.struct("category_id", "tk_id")), ["video_id"], "_id", "_k").drop("tk_id").withColumnRenamed("_k", "tk_id")
    t = did.select("video_id", F.col("tk_id").alias("track_id"), F.col("frame").alias("frame_idx"), "_s", "x0", "y0", "x1", "y1")
    t = cut(t)
    kept = track_nms(t, t.groupBy("video_id", "track_id").agg(F.max("_s").alias("score")), nms).where("x0 IS NOT NULL")
    return TM.hota_sums(cut(gid.select("video_id", "gt_id", "frame", "x0", "y0", "x1", "y1")), cut(kept).select("video_id", F.col("track_id").alias("tk_id"), F.col("frame_idx").alias("frame"), "x0", "y0", "x1", "y1"), ["video_id"])


def teta_input(dt: DataFrame, min_score: float, strategy: str = "track", threshold: float = 0.5) -> DataFrame:
    """Score filter (inclusive), then suppression per 'track', per 'frame' or 'none'. dt: video_id, track_id, frame_idx, score, box."""
    d = dt.where(F.col("score") >= min_score)
    if strategy == "track":
        s = d.groupBy("video_id", "track_id").agg(F.max("score").alias("score"))
        return track_nms(d, s, threshold).where("x0 IS NOT NULL")
    return frame_nms(d, ["video_id", "frame_idx"], threshold, "track_id") if strategy == "frame" else d


def video_concept_f1(gt: DataFrame, dt: DataFrame, scores: DataFrame, negatives: DataFrame | None = None, min_score: float = 0.5) -> DataFrame:
    """Per (video, phrase) counts on whole tracks, negatives included; feed to `concept_f1.accumulate` or `image_scores`.

    gt/dt: frame rows with gt_id / dt_id; scores: video_id, category_id, dt_id, score."""
    ids = AP.remap_pairs(gt, dt, negatives)
    good = scores.where(F.col("score") >= min_score).select(*PAIR, "dt_id")
    d = dt.join(good, [*PAIR, "dt_id"], "left_semi")
    m = best_assignment(AP.video_pairs(gt, d).withColumn("value", F.col("sim")), PAIR)
    tp = m.groupBy(*PAIR).agg(F.array(*[F.count_if(F.col("sim") >= t) for t in CF.THRESHOLDS]).alias("tp"))
    ng = gt.groupBy(*PAIR).agg(F.countDistinct("gt_id").alias("n_gt"))
    nd = good.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_dt"))
    zero = F.array(*[F.lit(0).cast("long") for _ in CF.THRESHOLDS])
    j = ids.join(ng, PAIR, "left").join(nd, PAIR, "left").join(tp, PAIR, "left").fillna(0, ["n_gt", "n_dt"])
    return j.select(*PAIR, F.col("new_video_id").alias("image_id"), "n_gt", "n_dt", F.coalesce("tp", zero).alias("tp"))
