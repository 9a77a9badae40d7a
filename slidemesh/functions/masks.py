"""Run-length masks. A mask is column-major runs (counts, h, w): background first, as in COCO; or rows (y, x0, x1) in a run table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from slidemesh.functions import boxes as B


def rle_area(counts: Column) -> Column:
    """Foreground pixels: every second run."""
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, c: s + c)


def rle_runs(counts: Column) -> Column:
    """Foreground runs as array of struct (start, len) in the column-major pixel order."""
    ends = F.aggregate(counts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("runs"), F.lit(0).alias("i")),
                       lambda a, c: F.struct((a["at"] + c).alias("at"), F.when((a["i"] % 2 == 1) & (c > 0), F.concat(a["runs"], F.array(F.struct(a["at"].alias("start"), c.cast("long").alias("len")))))
                                             .otherwise(a["runs"]).alias("runs"), (a["i"] + 1).alias("i")))
    return ends["runs"]


def rle_box(counts: Column, h: Column) -> Column:
    """Tight box (x0, y0, x1, y1; right and bottom exclusive) of a mask, NULL when it is empty."""
    r = rle_runs(counts)
    x0 = F.array_min(F.transform(r, lambda p: F.floor(p["start"] / h)))
    x1 = F.array_max(F.transform(r, lambda p: F.floor((p["start"] + p["len"] - 1) / h))) + 1
    wraps = lambda p: F.floor(p["start"] / h) < F.floor((p["start"] + p["len"] - 1) / h)
    y0 = F.array_min(F.transform(r, lambda p: F.when(wraps(p), F.lit(0).cast("long")).otherwise(p["start"] % h)))
    y1 = F.array_max(F.transform(r, lambda p: F.when(wraps(p), h.cast("long")).otherwise((p["start"] + p["len"] - 1) % h + 1)))
    return F.when(F.size(r) > 0, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def dilated_box(box: Column, px: int, clip: B.Box) -> Column:
    """Box of the mask grown by `px` (cross-shaped element: the box grows by the same amount), clipped."""
    out = B.Box(F.greatest(clip.x0, box["x0"] - px), F.greatest(clip.y0, box["y0"] - px), F.least(clip.x1, box["x1"] + px), F.least(clip.y1, box["y1"] + px))
    return F.when(box.isNotNull() & (out.x1 > out.x0) & (out.y1 > out.y0), out.struct())


def mask_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Intersections of the masks of two tables (keys, mask_id, and rows y, x0, x1 or non-overlapping rectangles x0, y0, x1, y1).

    Rows are joined on y, rectangles as boxes of their key, so that work follows the runs or the rectangles."""
    from slidemesh.operators.pairs import box_pairs

    if "y" in left.columns:
        l, r = left.alias("l"), right.alias("r")
        eq = B.all_of(*[F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "y"]], F.col("l.x0") < F.col("r.x1"), F.col("r.x0") < F.col("l.x1"))
        p = l.join(r, eq).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.mask_id").alias("a"), F.col("r.mask_id").alias("b"), (F.least("l.x1", "r.x1") - F.greatest("l.x0", "r.x0")).alias("_px"))
        px = F.col("x1") - F.col("x0")
    else:
        p = box_pairs(left, keys, lambda a, b: F.lit(True), right=right).select(*keys, F.col("a.mask_id").alias("_l"), F.col("b.mask_id").alias("_r"), B.inter_area(B.box("a."), B.box("b.")).alias("_px"))
        p = p.withColumnsRenamed({"_l": "a", "_r": "b"})
        px = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    inter = p.groupBy(*keys, "a", "b").agg(F.sum("_px").alias("inter"))
    size = lambda d, n: d.groupBy(*keys, F.col("mask_id").alias(n)).agg(F.sum(px).alias(f"area_{n}"))
    j = inter.join(size(left, "a"), [*keys, "a"]).join(size(right, "b"), [*keys, "b"])
    return j.withColumns({"iou": F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter")), "iom": F.col("inter") / F.least("area_a", "area_b")})


def run_boxes(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys, "mask_id").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"))


def shift_runs(runs: DataFrame, dx: Column, dy: Column, region: B.Box) -> DataFrame:
    """Runs moved to slide coordinates and clipped to a region."""
    moved = runs.withColumns({"x0": F.greatest(F.col("x0") + dx, region.x0), "x1": F.least(F.col("x1") + dx, region.x1), "y": F.col("y") + dy})
    return moved.where((F.col("x1") > F.col("x0")) & (F.col("y") >= region.y0) & (F.col("y") < region.y1))


FEW_RECTS = 12          # rectangles of a key up to which they are cut one by one, without a grid
HOT_MASKS = 200         # masks of a key beyond which decisions go in rounds


def residual_pixels(masks: DataFrame, order: DataFrame, keys: list[str], min_pixels: int = 32, min_ratio: float = 0.10) -> DataFrame:
    """Masks in order lose the pixels of earlier kept masks; those with too little left are dropped: (keys, mask_id, left_px, kept).

    masks: keys, mask_id and non-overlapping rectangles x0, y0, x1, y1 (or rows y, x0, x1). order: keys, mask_id, seq. Keys of few masks are walked in
    order, their taken pixels kept as rectangles cut at each other's edges. Keys of more are decided in rounds: a mask is ready when all
    earlier masks that share a pixel with it are decided, and what the kept ones among these cover of it is one area sum, whose pieces
    are spread over tasks by mask and tile."""
    from slidemesh.operators.assign import per_key
    from slidemesh.runtime import split_hot

    if "y" in masks.columns:
        masks = masks.select(*keys, "mask_id", "x0", F.col("y").alias("y0"), "x1", (F.col("y") + 1).alias("y1"))

    def few_rects(mask_ids: list, *sides: list) -> list[tuple]:
        """walk for a handful of rectangles: what is left of a mask are its rectangles cut along those of the kept ones."""
        masks: dict = {}
        for m, *box in zip(mask_ids, *sides):
            masks.setdefault(m, []).append(box)
        taken, rows = [], []
        for m, own in masks.items():
            rest = solid = [b for b in own if b[0] < b[2] and b[1] < b[3]]
            for tx0, ty0, tx1, ty1 in taken:
                pieces = []
                for x0, y0, x1, y1 in rest:
                    if x0 >= tx1 or tx0 >= x1 or y0 >= ty1 or ty0 >= y1:
                        pieces.append((x0, y0, x1, y1))
                        continue
                    if y0 < ty0:
                        pieces.append((x0, y0, x1, ty0))
                        y0 = ty0
                    if ty1 < y1:
                        pieces.append((x0, ty1, x1, y1))
                        y1 = ty1
                    if x0 < tx0:
                        pieces.append((x0, y0, tx0, y1))
                    if tx1 < x1:
                        pieces.append((tx1, y0, x1, y1))
                rest = pieces
            left, total = (int(sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in r)) for r in (rest, own))
            keep = left > 0 and left >= min_pixels and left / max(1.0, total) >= min_ratio
            if keep:
                taken += solid
            rows.append((m, left, keep))
        return rows

    def walk(mask_ids: list, x0: list, y0: list, x1: list, y1: list) -> list[tuple]:
        if len(mask_ids) <= FEW_RECTS:
            return few_rects(mask_ids, x0, y0, x1, y1)
        xs, ys = sorted({*x0, *x1}), sorted({*y0, *y1})
        at_x, at_y = {v: k for k, v in enumerate(xs)}, {v: k for k, v in enumerate(ys)}
        cell = np.outer(np.diff(ys), np.diff(xs))
        free, rows, at, n = np.ones(cell.shape, bool), [], 0, len(mask_ids)
        while at < n:
            end = at
            while end < n and mask_ids[end] == mask_ids[at]:
                end += 1
            spans = [(slice(at_y[y0[k]], at_y[y1[k]]), slice(at_x[x0[k]], at_x[x1[k]])) for k in range(at, end)]
            total = sum((x1[k] - x0[k]) * (y1[k] - y0[k]) for k in range(at, end))
            left = sum(int((cell[s] * free[s]).sum()) for s in spans)
            keep = left > 0 and left >= min_pixels and left / max(1.0, total) >= min_ratio
            if keep:
                for s in spans:
                    free[s] = False
            rows.append((mask_ids[at], left, keep))
            at = end
        return rows

    few, many = split_hot(order, keys, HOT_MASKS)
    full = masks.join(few, [*keys, "mask_id"])
    out = per_key(full, keys, ["seq", "y0", "x0"], ["mask_id", "x0", "y0", "x1", "y1"], walk, "mask_id long, left_px long, kept boolean")
    return out if many is None else out.unionByName(_residual_rounds(masks, many, keys, min_pixels, min_ratio))


def _residual_rounds(masks: DataFrame, order: DataFrame, keys: list[str], min_pixels: int, min_ratio: float) -> DataFrame:
    """residual_pixels for keys of any number of masks."""
    from slidemesh.functions.pixels import union_area
    from slidemesh.operators.pairs import box_pairs
    from slidemesh.runtime import cut

    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    own = [*keys, "mask_id"]
    m = masks.join(order, own)
    todo = cut(m.groupBy(*own, "seq").agg(F.sum(area).cast("long").alias("total")))
    # pieces of a mask that an earlier one covers
    both = box_pairs(m, keys, lambda a, b: a("seq") < b("seq"))
    shared = cut(both.select(*keys, F.col("a.mask_id").alias("first"), F.col("b.mask_id").alias("mask_id"), *[f(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c, f in (("x0", F.greatest), ("y0", F.greatest), ("x1", F.least), ("y1", F.least))]))
    waits = cut(shared.select(*own, "first").distinct())
    done = None
    while not todo.isEmpty():
        open_ = todo.select(*keys, F.col("mask_id").alias("first"))
        held = waits.join(open_, [*keys, "first"], "left_semi").select(*own).distinct()
        ready = cut(todo.join(held, own, "left_anti"))
        if done is None:
            taken = ready.select(*own, F.lit(0).cast("long").alias("covered"))
        else:
            kept = done.where("kept").select(*keys, F.col("mask_id").alias("first"))
            taken = union_area(shared.join(ready.select(*own), own, "left_semi").join(kept, [*keys, "first"], "left_semi"), own).select(*own, "covered")
        left = F.col("total") - F.coalesce(F.col("covered"), F.lit(0))
        got = ready.join(taken, own, "left").withColumn("left_px", left.cast("long"))
        got = got.withColumn("kept", (F.col("left_px") > 0) & (F.col("left_px") >= min_pixels) & (F.col("left_px") / F.greatest(F.lit(1), "total") >= min_ratio)).select(*own, "left_px", "kept")
        done = cut(got if done is None else done.unionByName(got))
        todo = cut(todo.join(ready.select(*own), own, "left_anti"))
    return done if done is not None else todo.select(*own, F.lit(0).cast("long").alias("left_px"), F.lit(False).alias("kept"))


def boundary(mask: np.ndarray) -> np.ndarray:
    """One-pixel boundary of a binary mask."""
    p = np.pad(mask.astype(bool), 1)
    inner = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return mask.astype(bool) & ~inner


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation by a disk."""
    out = np.zeros_like(mask, dtype=bool)
    p = np.pad(mask.astype(bool), radius)
    h, w = mask.shape
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dx * dx + dy * dy <= radius * radius:
                out |= p[radius + dy:radius + dy + h, radius + dx:radius + dx + w]
    return out


def _decode(counts, h, w) -> np.ndarray:
    flat = np.zeros(h * w, dtype=bool)
    at = 0
    for i, c in enumerate(counts):
        if i % 2:
            flat[at:at + c] = True
        at += c
    return flat.reshape(w, h).T


@F.pandas_udf(DoubleType())
def boundary_f(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Boundary F-measure of two masks given as runs, tolerance 0.8 % of the diagonal."""
    out = []
    for ca, cb, hh, ww in zip(a, b, h, w):
        ba, bb = boundary(_decode(ca, hh, ww)), boundary(_decode(cb, hh, ww))
        r = int(np.ceil(0.008 * np.hypot(hh, ww)))
        na, nb = ba.sum(), bb.sum()
        if na == 0 or nb == 0:
            out.append(1.0 if na == nb else 0.0)
            continue
        p, q = (ba & dilate(bb, r)).sum() / na, (bb & dilate(ba, r)).sum() / nb
        out.append(0.0 if p + q == 0 else 2 * p * q / (p + q))
    return pd.Series(out, dtype="float64")
