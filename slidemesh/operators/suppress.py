"""Greedy suppression as one primitive: walk conflict pairs in a given order, drop the loser when both sides are still in.

Non-maximum suppression, same-label filtering, cross-iteration dedup, near-duplicate scans and part-of drops are all this
walk with different pairs and orders. Keys with few pairs are folded inside the JVM; the others are decided in parallel
rounds: a pair fires once its winner can no longer be dropped earlier, so each round settles every such pair at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.operators.pairs import box_pairs
from slidemesh.operators.scan import positions, top_n
from slidemesh.runtime import cut, split_hot

FOLD_PAIRS = 500


def drop_in_order(pairs: DataFrame, keys: list[str], order: list[str], limit: int = FOLD_PAIRS) -> DataFrame:
    """Dropped items (keys, id) of pairs (keys, order..., w, l) where w and l are item ids and l is the side to drop."""
    packed = cut(pairs.select(*keys, F.struct(*order).alias("o"), F.col("w").cast("long").alias("w"), F.col("l").cast("long").alias("l")))
    cold, hot = split_hot(packed, keys, limit)
    lists = cold.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("o", "w", "l"))).alias("e"))
    out = lists.select(*keys, F.explode(F.aggregate(
        "e", F.array().cast("array<bigint>"),
        lambda gone, p: F.when(F.array_contains(gone, p["w"]) | F.array_contains(gone, p["l"]), gone)
        .otherwise(F.concat(gone, F.array(p["l"]))))).alias("id"))
    return out if hot is None else out.unionByName(_drop_rounds(hot, keys))


def _drop_rounds(pairs: DataFrame, keys: list[str]) -> DataFrame:
    pending, dropped = cut(pairs), None
    while not pending.isEmpty():
        risk = pending.groupBy(*keys, "l").agg(F.min("o").alias("_risk")).withColumnRenamed("l", "w")
        fired = pending.join(risk, [*keys, "w"], "left").where(F.col("_risk").isNull() | (F.col("o") < F.col("_risk")))
        gone = fired.select(*keys, F.col("l").alias("id"), "o")
        gone = gone if dropped is None else gone.unionByName(dropped)
        dropped = cut(gone.groupBy(*keys, "id").agg(F.min("o").alias("o")))
        as_w = dropped.select(*keys, F.col("id").alias("w"), F.col("o").alias("_dw"))
        as_l = dropped.select(*keys, F.col("id").alias("l"), F.col("o").alias("_dl"))
        pending = cut(pending.join(as_w, [*keys, "w"], "left").join(as_l, [*keys, "l"], "left")
                      .where((F.col("_dw").isNull() | (F.col("_dw") > F.col("o"))) & (F.col("_dl").isNull() | (F.col("_dl") > F.col("o"))))
                      .select(*keys, "o", "w", "l"))
    return dropped.select(*keys, "id")


def without(items: DataFrame, dropped: DataFrame, keys: list[str], ident: str) -> DataFrame:
    return items.join(dropped.withColumnRenamed("id", ident), [*keys, ident], "left_anti")


def nms(items: DataFrame, keys: list[str], conflict: Callable[[B.Box, B.Box], Column], priority: list[str], ident: str = "pos",
        extra: Callable | None = None) -> DataFrame:
    """Greedy suppression by priority ('-score' = high first; `ident` breaks ties): keep an item unless a kept one conflicts.

    `conflict(a, b)` tests two boxes; it is asked with the preferred box first."""
    order = [*priority, ident]
    rank = [F.expr(f"-{o[1:]}") if o.startswith("-") else F.col(o) for o in order]
    slim = items.select(*keys, ident, F.struct(*[r.alias(f"k{i}") for i, r in enumerate(rank)]).alias("_rank"), "x0", "y0", "x1", "y1",
                        *[c for c in (extra.columns if extra else [])])
    found = box_pairs(slim, keys, lambda a, b: (a("_rank") < b("_rank")) & conflict(B.box("a."), B.box("b.")))
    pairs = found.select(*keys, F.col("a._rank").alias("ra"), F.col("b._rank").alias("rb"), F.col(f"a.{ident}").alias("w"), F.col(f"b.{ident}").alias("l"))
    return without(items, drop_in_order(pairs, keys, ["ra", "rb"]), keys, ident)


def same_label_filter(cands: DataFrame, keys: list[str], label: str = "label", min_overlap: float = 1.0, max_per_label: int = 5,
                      ident: str = "pos") -> DataFrame:
    """Per label: larger box first (then score), no overlap with a kept one, at most `max_per_label` kept."""
    kept = nms(cands, [*keys, label], lambda a, b: B.overlaps(a, b, min_overlap), ["-area", "-score"], ident)
    return top_n(kept, [*keys, label], ["-area", "-score", ident], max_per_label)


def near_duplicate_filter(cands: DataFrame, keys: list[str], ratio: float = 0.9, min_overlap: float = 1.0, label: str = "label",
                          policy: str = "score_then_area", ident: str = "pos") -> DataFrame:
    """Cross-label near-duplicates: walk conflicting pairs by position, drop the less preferred side."""
    if ratio <= 0:
        return cands
    first, second = ("score", "area") if policy == "score_then_area" else ("area", "score")

    def prefers(a, b):
        return (F.when(a(first) != b(first), a(first) > b(first)).when(a(second) != b(second), a(second) > b(second))
                .otherwise(a(label) < b(label)))

    found = box_pairs(cands.select(*keys, ident, label, "score", "area", "x0", "y0", "x1", "y1"), keys,
                      lambda a, b: (a(ident) < b(ident)) & (a(label) != b(label)) & B.overlaps(B.box("a."), B.box("b."), min_overlap)
                      & (B.near_duplicate_ratio(B.box("a."), B.box("b.")) >= ratio))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    a_wins = prefers(a, b)
    pairs = found.select(*keys, a(ident).alias("i"), b(ident).alias("j"), F.when(a_wins, a(ident)).otherwise(b(ident)).alias("w"),
                         F.when(a_wins, b(ident)).otherwise(a(ident)).alias("l"))
    return without(cands, drop_in_order(pairs, keys, ["i", "j"]), keys, ident)


def part_of_filter(cands: DataFrame, decisions: DataFrame, keys: list[str], ratio: float = 0.3, min_overlap: float = 1.0,
                   label: str = "label", ident: str = "pos") -> DataFrame:
    """Drop a smaller box covered >= `ratio` by a larger one of another label when `decisions` (keys, small, large,
    is_part_of) says it belongs to it."""
    cand = part_of_candidates(cands, keys, ratio, min_overlap, label, ident)
    yes = cand.join(decisions.where("is_part_of").select(*keys, "small", "large").distinct(), [*keys, "small", "large"])
    pairs = yes.select(*keys, F.least("small", "large").alias("i"), F.greatest("small", "large").alias("j"),
                       F.col("large").alias("w"), F.col("small").alias("l"))
    return without(cands, drop_in_order(pairs, keys, ["i", "j"]), keys, ident)


def part_of_candidates(cands: DataFrame, keys: list[str], ratio: float = 0.3, min_overlap: float = 1.0, label: str = "label",
                       ident: str = "pos") -> DataFrame:
    """Pairs to ask about: (keys, small, large, overlap_ratio)."""
    inter = B.inter_area(B.box("a."), B.box("b.")).cast("double")
    share = inter / F.greatest(F.lit(1.0), F.col("a.area").cast("double"))
    found = box_pairs(cands.select(*keys, ident, label, "area", "x0", "y0", "x1", "y1"), keys,
                      lambda a, b: (a("area") < b("area")) & (a(label) != b(label)) & (inter >= min_overlap) & (share >= ratio))
    return found.select(*keys, F.col(f"a.{ident}").alias("small"), F.col(f"b.{ident}").alias("large"), share.alias("overlap_ratio"))


def cross_iteration_dedup(comps: DataFrame, keys: list[str], ratio: float = 0.5, label: str = "label", ident: str = "seq") -> DataFrame:
    """Drop a component covered >= `ratio` by an earlier kept one of the same class (label compared trimmed, lower-case).

    Needs iter_idx and pos; a key with a single iteration is left alone. Boxes of the same iteration count as earlier."""
    cls = F.lower(F.trim(F.col(label)))
    seq = positions(comps, keys, ["iter_idx", "pos"], ident)
    multi = comps.groupBy(*keys).agg(F.countDistinct("iter_idx").alias("_k")).where("_k > 1").select(*keys)
    elig = (seq.join(multi, keys, "left_semi").withColumn("_cls", cls).where("_cls <> ''")
            .select(*keys, "_cls", ident, F.greatest(F.lit(1e-6), F.coalesce(F.when(F.col("area") != 0, F.col("area").cast("double")), B.area(B.box()).cast("double"))).alias("_later"),
                    "x0", "y0", "x1", "y1"))
    inter = B.inter_area(B.box("a."), B.box("b.")).cast("double")
    found = box_pairs(elig, [*keys, "_cls"], lambda a, b: (a(ident) < b(ident)) & (inter / b("_later") >= ratio))
    pairs = found.select(*keys, F.col(f"a.{ident}").alias("i"), F.col(f"b.{ident}").alias("j"), F.col(f"a.{ident}").alias("w"), F.col(f"b.{ident}").alias("l"))
    return without(seq, drop_in_order(pairs, keys, ["i", "j"]), keys, ident)


def frame_nms(dets: DataFrame, keys: list[str], threshold: float, ident: str = "pos") -> DataFrame:
    """Per-frame suppression, IoU >= threshold loses to the higher score."""
    return nms(dets, keys, lambda a, b: B.iou(a, b) >= threshold, ["-score"], ident)


def generic_nms(dets: DataFrame, keys: list[str], threshold: float, min_score: float | None = None, ident: str = "pos") -> DataFrame:
    """IoU above (not equal to) the threshold; optional score prefilter, also strict."""
    src = dets if min_score is None else dets.where(F.col("score") > min_score)
    return nms(src, keys, lambda a, b: B.iou(a, b) > threshold, ["-score"], ident)


def iom_removal(dets: DataFrame, keys: list[str], threshold: float = 0.3, ident: str = "pos") -> DataFrame:
    """Greedy removal by intersection over the smaller area, strictly above the threshold."""
    return nms(dets, keys, lambda a, b: B.iom(a, b) > threshold, ["-score"], ident)


def track_pair_iou(tracks: DataFrame, video: str = "video_id", track: str = "track_id", frame: str = "frame_idx") -> DataFrame:
    """IoU of track pairs summed over the frames where both exist: (video, t1, t2, inter, union)."""
    own = tracks.withColumn("_area", B.area(B.box())).where("_area > 0")
    found = box_pairs(own.select(video, frame, track, "x0", "y0", "x1", "y1"), [video, frame], lambda a, b: a(track) < b(track))
    inter = found.groupBy(video, F.col(f"a.{track}").alias("t1"), F.col(f"b.{track}").alias("t2")).agg(
        F.sum(B.inter_area(B.box("a."), B.box("b."))).alias("inter"))
    # shared frames exist without overlap too: sum both areas over the frames the two tracks share
    slim = own.select(video, frame, track, "_area")
    l = slim.select(video, frame, F.col(track).alias("t1"), F.col("_area").alias("a1"))
    r = slim.select(video, frame, F.col(track).alias("t2"), F.col("_area").alias("a2"))
    wanted = inter.select(video, "t1", "t2")
    areas = (wanted.join(l, [video, "t1"]).join(r, [video, "t2", frame]).groupBy(video, "t1", "t2")
             .agg(F.sum(F.col("a1") + F.col("a2")).alias("_areas")))
    return inter.join(areas, [video, "t1", "t2"]).select(video, "t1", "t2", "inter", (F.col("_areas") - F.col("inter")).alias("union"))


def track_nms(frames: DataFrame, scores: DataFrame, threshold: float, video: str = "video_id", track: str = "track_id",
              frame: str = "frame_idx") -> DataFrame:
    """Suppress whole tracks; a suppressed track keeps its rows with NULL boxes. `scores`: (video, track, score)."""
    pi = track_pair_iou(frames.where(F.greatest("x0", "y0", "x1", "y1") > 0), video, track, frame).where(
        (F.col("union") > 0) & (F.col("inter").cast("double") / F.col("union") >= threshold))
    s1 = scores.select(video, F.col(track).alias("t1"), F.col("score").alias("s1"))
    s2 = scores.select(video, F.col(track).alias("t2"), F.col("score").alias("s2"))
    p = pi.join(s1, [video, "t1"]).join(s2, [video, "t2"])
    first = (F.col("s1") > F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("t1") < F.col("t2")))
    def side(a, b):
        return F.when(first, F.col(a)).otherwise(F.col(b))
    pairs = p.select(video, (-side("s1", "s2")).alias("o1"), side("t1", "t2").alias("o2"), (-side("s2", "s1")).alias("o3"),
                     side("t2", "t1").alias("o4"), side("t1", "t2").alias("w"), side("t2", "t1").alias("l"))
    dropped = drop_in_order(pairs, [video], ["o1", "o2", "o3", "o4"]).withColumnRenamed("id", track).withColumn("_gone", F.lit(True))
    out = frames.join(dropped, [video, track], "left")
    return out.withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in ("x0", "y0", "x1", "y1")}).drop("_gone")


def recent_occlusion_losers(objs: DataFrame, keys: list[str], threshold: float, ident: str = "pos", reverse: bool = False) -> DataFrame:
    """Objects to suppress: of two overlapping objects the later-occluded loses, if the other was ever occluded."""
    found = box_pairs(objs.select(*keys, ident, "last_occluded", "x0", "y0", "x1", "y1"), keys,
                      lambda a, b: (a(ident) != b(ident)) & (B.iou(B.box("a."), B.box("b.")) >= threshold)
                      & ((a("last_occluded") < b("last_occluded")) if reverse else (a("last_occluded") > b("last_occluded"))) & (b("last_occluded") > -1))
    return found.select(*keys, F.col(f"a.{ident}").alias(ident)).distinct()
