"""Track bookkeeping over frames in batch form: association, streaks, keep-alive, refresh candidates, tracklets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.operators.pairs import box_pairs
from slidemesh.operators.scan import positions, running, top_n
from slidemesh.runtime import cut


def associate(dets: DataFrame, tracks: DataFrame, keys: list[str], new_score: float = 0.5, match_iou: float = 0.5, track_iou: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, new detections, unmatched tracks) per frame.

    dets: keys, det_id, score, box; tracks: keys, trk_id, box. A detection is new when no track reaches `match_iou` and its
    score is high enough; where a frame has no track at all every detection is new, whatever its score. A track with an
    empty box is neither matched nor unmatched."""
    p = box_pairs(dets.select(*keys, "det_id", "x0", "y0", "x1", "y1"), keys, lambda a, b: F.lit(True), right=tracks.select(*keys, "trk_id", "x0", "y0", "x1", "y1"))
    sim = p.select(*keys, F.col("a.det_id").alias("det_id"), F.col("b.trk_id").alias("trk_id"), B.iou(B.box("a."), B.box("b.")).alias("iou"))
    matches = sim.where(F.col("iou") >= match_iou)
    free = dets.join(matches.select(*keys, "det_id").distinct(), [*keys, "det_id"], "left_anti")
    some = tracks.select(*keys).distinct().withColumn("_t", F.lit(True))
    new = free.join(some, keys, "left").where(F.col("_t").isNull() | (F.col("score") >= new_score)).drop("_t")
    held = sim.where(F.col("iou") >= track_iou).select(*keys, "trk_id").distinct()
    unmatched = tracks.where(B.nonempty(B.box())).join(held, [*keys, "trk_id"], "left_anti").select(*keys, "trk_id")
    return matches, new, unmatched


def refresh_candidates(sim: DataFrame, dets: DataFrame, new: DataFrame, keys: list[str], high: float, threshold: float) -> DataFrame:
    """Confident, not new detections tied to exactly one track, which is tied to exactly one detection."""
    s = sim.where(F.col("iou") >= threshold)
    nd = s.groupBy(*keys, "det_id").agg(F.count(F.lit(1)).alias("_nd")).where("_nd = 1").drop("_nd")
    nt = s.groupBy(*keys, "trk_id").agg(F.count(F.lit(1)).alias("_nt")).where("_nt = 1").drop("_nt")
    sure = dets.where(F.col("score") >= high).join(new.select(*keys, "det_id"), [*keys, "det_id"], "left_anti").select(*keys, "det_id")
    return s.join(nd, [*keys, "det_id"], "left_semi").join(nt, [*keys, "trk_id"], "left_semi").join(sure, [*keys, "det_id"], "left_semi")


def confirm_streaks(frames: DataFrame, keys: list[str], needed: int) -> DataFrame:
    """Adds streak (consecutive matched frames) and confirmed (a streak of `needed` was reached; it never goes back).

    Both are running sums: the streak is the match count minus its value at the last miss."""
    r = running(frames, keys, ["frame_idx"], sums={"_hits": F.col("matched").cast("long")})
    r = running(r, keys, ["frame_idx"], lasts={"_base": F.when(~F.col("matched"), F.col("_hits"))})
    r = r.withColumn("streak", F.col("_hits") - F.coalesce("_base", F.lit(0)))
    r = running(r, keys, ["frame_idx"], sums={"_ok": (F.col("streak") >= needed).cast("long")})
    return r.withColumn("confirmed", F.col("_ok") > 0).drop("_hits", "_base", "_ok")


def unmatched_runs(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the unmatched count so far, and the first frame of the track (by aggregate)."""
    first = frames.groupBy(*keys).agg(F.min("frame_idx").alias("first_frame"))
    return running(frames, keys, ["frame_idx"], sums={"unmatched": (~F.col("matched")).cast("long")}).join(first, keys)


def keep_alive(frames: DataFrame, keys: list[str], start: int = 0, lo: int = -4, hi: int = 8, block: int = 4096) -> DataFrame:
    """Clamped walk +1/-1 over a track's frames; adds keep_alive.

    Frames are cut into blocks of bounded length. A block maps each of the few possible start values to an end value; the
    maps are composed in order (again in blocks) to give every block its start, then each block is walked on its own."""
    f = positions(frames, keys, ["frame_idx"], "_i").withColumn("_b", F.floor(F.col("_i") / block))
    blocks = f.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "matched"))).alias("_f"))
    if blocks.where("_b > 0").isEmpty():
        begun = blocks.withColumn("_s", F.lit(start))
    else:
        ends = F.aggregate("_f", F.sequence(F.lit(lo), F.lit(hi)), lambda m, x: F.transform(m, lambda v: _clamped(v, x["matched"], lo, hi)))
        starts = _block_starts(cut(blocks.select(*keys, "_b", ends.alias("_m"))), keys, start, lo, block)
        begun = blocks.join(starts, [*keys, "_b"])
    walk = F.aggregate("_f", F.struct(F.col("_s").alias("v"), F.array().cast("array<int>").alias("all")),
                       lambda acc, x: B.let(_clamped(acc["v"], x["matched"], lo, hi), lambda v: F.struct(v.alias("v"), F.concat(acc["all"], F.array(v)).alias("all"))))
    return (begun.withColumn("w", walk["all"]).select(*keys, F.inline(F.arrays_zip("_f", "w")))
            .select(*keys, "_f.frame_idx", "_f.matched", F.col("w").alias("keep_alive")))


def _clamped(v, matched, lo, hi):
    return F.least(F.lit(hi), F.greatest(F.lit(lo), v + F.when(matched, 1).otherwise(-1)))


def _block_starts(maps: DataFrame, keys: list[str], start: int, lo: int, block: int) -> DataFrame:
    """Start value of each block from the maps (keys, _b, _m); recursion over blocks of blocks keeps every row bounded."""
    up = maps.withColumn("_u", F.floor(F.col("_b") / block)).groupBy(*keys, "_u").agg(F.array_sort(F.collect_list(F.struct("_b", "_m"))).alias("_l"))
    if up.where("_u > 0").isEmpty():
        begun = up.withColumn("_s", F.lit(start))
    else:
        whole = F.aggregate("_l", F.sequence(F.lit(lo), F.lit(lo) + F.size(F.col("_l")[0]["_m"]) - 1), lambda m, x: F.transform(m, lambda v: F.get(x["_m"], v - lo)))
        higher = cut(up.select(*keys, F.col("_u").alias("_b"), whole.alias("_m")))
        begun = up.join(_block_starts(higher, keys, start, lo, block).withColumnRenamed("_b", "_u"), [*keys, "_u"])
    at = F.aggregate("_l", F.struct(F.col("_s").alias("v"), F.array().cast("array<int>").alias("all")),
                     lambda acc, x: F.struct(F.get(x["_m"], acc["v"] - lo).alias("v"), F.concat(acc["all"], F.array(acc["v"])).alias("all")))
    z = begun.withColumn("_w", at["all"]).select(*keys, F.inline(F.arrays_zip("_l", F.col("_w").alias("_s0"))))
    return z.select(*keys, F.col("_l._b").alias("_b"), F.col("_s0").alias("_s"))


def plan_frames(dets: DataFrame, tracks: DataFrame, videos: DataFrame, max_objects: int, margin: float | None = 0.025, new_score: float = 0.5, match_iou: float = 0.5) -> DataFrame:
    """New objects per frame: unmatched detections, off the border, best ones up to the room left, ids in running order.

    dets and tracks carry video_id, frame_idx; videos: video_id, max_obj_id (before the planned frames)."""
    keys = ["video_id", "frame_idx"]
    _, new, _ = associate(dets, tracks, keys, new_score, match_iou, match_iou)
    if margin is not None:
        new = new.where(~B.near_boundary(B.box(), margin))
    have = tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    kept = limit_new_objects(new, have, keys, max_objects)
    ids = positions(kept, ["video_id"], ["frame_idx", "det_id"], "_k").join(videos, "video_id", "left")
    return ids.withColumn("obj_id", F.coalesce("max_obj_id", F.lit(-1)) + 1 + F.col("_k")).drop("_k", "max_obj_id")


def frame_steps(images: DataFrame) -> DataFrame:
    """Timestep of each image within its video by frame index."""
    return positions(images, ["video_id"], ["frame_idx"], "timestep")


def limit_new_objects(new: DataFrame, existing: DataFrame, keys: list[str], max_objects: int) -> DataFrame:
    """Keep the best-scored new detections up to the room left per frame (existing: keys, n)."""
    capped = top_n(new, keys, ["-score", "-det_id"], max_objects)
    ranked = positions(capped, keys, ["-score", "-det_id"], "_rank").join(existing, keys, "left")
    return ranked.where(F.col("_rank") < max_objects - F.coalesce("n", F.lit(0))).drop("_rank", "n")


def video_sizes(videos: DataFrame, tracks: DataFrame, images: DataFrame) -> DataFrame:
    """Tracks and images per video and the mean of mean track areas; videos without any stay."""
    per = tracks.groupBy("video_id", "track_id").agg(F.avg("area").alias("_a")).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_tracks"), F.avg("_a").alias("mean_track_area"))
    im = images.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_images"))
    return videos.select("video_id").join(per, "video_id", "left").join(im, "video_id", "left").fillna(0, ["n_tracks", "n_images"])


def tracklets(preds: DataFrame, frames: DataFrame, absent_score: float = -1e8) -> DataFrame:
    """Tracks from per-frame predictions on the dense frame grid of each video.

    preds: video_id, track_id, frame_idx, score, label, box; frames: video_id, frame_idx. Missing frames get a NULL box and
    the absent score. Result: frame rows, plus mean score over present frames and the majority label (ties: smaller)."""
    per_label = preds.groupBy("video_id", "track_id", "label").agg(F.count(F.lit(1)).alias("_n"), F.sum("score").alias("_s"))
    head = per_label.groupBy("video_id", "track_id").agg((F.sum("_s") / F.sum("_n")).alias("track_score"), F.max_by("label", F.struct("_n", -F.col("label"))).alias("track_label"))
    grid = head.join(frames.select("video_id", "frame_idx"), "video_id")
    j = grid.join(preds.select("video_id", "track_id", "frame_idx", "score", "x0", "y0", "x1", "y1"), ["video_id", "track_id", "frame_idx"], "left")
    return j.withColumn("score", F.coalesce("score", F.lit(absent_score)))


def open_world_split(gt: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """Ground truth of the known, unknown or distractor classes (category_id, kind)."""
    return gt.join(classes.where(F.col("kind") == kind).select("category_id"), "category_id", "left_semi")
