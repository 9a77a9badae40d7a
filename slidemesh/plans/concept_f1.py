"""Concept F1: one-to-one matching per image, counts at ten IoU levels, micro, macro and image-level metrics.

gt: image_id, gt_id, box (`ignore` rows removed by the caller); dt: image_id, dt_id, score, box; images: image_id drives."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.operators.assign import _by_key, _whole_batches, best_assignment, solve
from slidemesh.operators.pairs import box_pairs
from slidemesh.runtime import cut, key_sizes, split_hot

THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]  # fixed values 0.50 .. 0.95
EPS, EPS_IL = 1e-4, 1e-6                                     # fixed values
WALK_BOXES = 280                                             # boxes of an image scored in one walk; fewer pairs than assign.HOT_PAIRS


def exhaustive_only(dt: DataFrame, flags: list[DataFrame]) -> DataFrame:
    """Detections on images that every ground truth marks as exhaustively annotated (image_id, is_instance_exhaustive)."""
    for f in flags:
        dt = dt.join(f.where("is_instance_exhaustive").select("image_id").distinct(), "image_id", "left_semi")
    return dt


def positive_split(dt: DataFrame, gt: DataFrame) -> DataFrame:
    """Detections whose class occurs in that image's ground truth."""
    return dt.join(gt.select("image_id", "category_id").distinct(), ["image_id", "category_id"], "left_semi")


def check_evaluated(images: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Images that should have been evaluated but were not (must be empty)."""
    return images.select("image_id").exceptAll(evaluated.select("image_id").distinct())


def gt_dt_pairs(gt: DataFrame, dt: DataFrame, keys: list[str] | None = None, gt_cols: tuple = (), dt_cols: tuple = ()) -> DataFrame:
    """(keys, r = gt_id, c = dt_id, sim, and gt_cols, dt_cols of both): overlapping pairs; against a crowd box the union is the detection's area."""
    keys = keys or ["image_id"]
    a, b = B.box("a."), B.box("b.")
    g = gt if "iscrowd" in gt.columns else gt.withColumn("iscrowd", F.lit(False))
    sim = F.when(F.col("a.iscrowd"), B.ratio(B.inter_area(a, b), B.area(b))).otherwise(B.iou(a, b))
    box = ["x0", "y0", "x1", "y1"]
    p = box_pairs(g.select(*keys, *dict.fromkeys(["gt_id", "iscrowd", *box, *gt_cols])), keys, lambda x, y: F.lit(True), right=dt.select(*keys, *dict.fromkeys(["dt_id", *box, *dt_cols])))
    return p.select(*keys, F.col("a.gt_id").cast("long").alias("r"), F.col("b.dt_id").cast("long").alias("c"), sim.alias("sim"), *[F.col(f"a.{c}").alias(c) for c in gt_cols], *[F.col(f"b.{c}").alias(c) for c in dt_cols])


def f1(tp: Column, fp: Column, fn: Column, eps: float = EPS) -> Column:
    p, r = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return 2 * p * r / (p + r + eps)


def per_image(images: DataFrame, gt: DataFrame, dt: DataFrame, min_score: float = 0.5, pairs: DataFrame | None = None) -> DataFrame:
    """One row per image: n_gt, n_dt and tp[10]; images without boxes stay. The score threshold is inclusive."""
    dt = dt.where(F.col("score") >= min_score)
    p = gt_dt_pairs(gt, dt) if pairs is None else pairs.join(dt.select("image_id", F.col("dt_id").alias("c")), ["image_id", "c"], "left_semi")
    m = best_assignment(p.withColumn("value", F.col("sim")), ["image_id"])
    tp = m.groupBy("image_id").agg(F.array(*[F.count_if(F.col("sim") >= t) for t in THRESHOLDS]).alias("tp"))
    ng = gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_gt"))
    nd = dt.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_dt"))
    zero = F.array(*[F.lit(0).cast("long") for _ in THRESHOLDS])
    return (images.select("image_id").join(ng, "image_id", "left").join(nd, "image_id", "left").join(tp, "image_id", "left")
            .select("image_id", F.coalesce("n_gt", F.lit(0).cast("long")).alias("n_gt"), F.coalesce("n_dt", F.lit(0).cast("long")).alias("n_dt"), F.coalesce("tp", zero).alias("tp")))


def best_of(scorings: list[DataFrame]) -> DataFrame:
    """Oracle over several ground truths: per image the scoring with the best mean local F1; nothing-and-nothing wins, the
    last such one; otherwise the first best."""
    parts = [s.withColumn("gt_pos", F.lit(i)) for i, s in enumerate(scorings)]
    u = parts[0]
    for q in parts[1:]:
        u = u.unionByName(q)
    rank = F.struct(*_rank(F.col("n_gt"), F.col("n_dt"), F.col("tp"), F.col("gt_pos")))
    return u.groupBy("image_id").agg(F.max_by(F.struct("n_gt", "n_dt", "tp"), rank).alias("s")).select("image_id", "s.*")


def _rank(n_gt: Column, n_dt: Column, tp: Column, gt_pos: Column) -> list[Column]:
    local = F.transform(tp, lambda t: f1(t, n_dt - t, n_gt - t))
    mean = F.when(n_dt == 0, 0.0).otherwise(F.aggregate(local, F.lit(0.0), lambda s, v: s + v) / len(THRESHOLDS))
    tn = (n_gt == 0) & (n_dt == 0)
    return [tn.alias("tn"), mean.alias("mean"), F.when(tn, gt_pos).otherwise(-gt_pos).alias("first")]


def best_of_subsets(images: DataFrame, gt: DataFrame, dt: DataFrame, subsets: list[Column], min_score: float = 0.5) -> DataFrame:
    """`best_of` over the scorings that `per_image` gives for subsets of one ground truth (conditions on its rows), one row per image.

    The rows of an image are dealt once for all scorings; pairs, assignments and counts stay in the task, and only counts leave it.
    Images with more than WALK_BOXES boxes are scored by joins."""
    box, marks = ["x0", "y0", "x1", "y1"], reduce(lambda x, y: x + y, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(subsets)])
    g = gt if "iscrowd" in gt.columns else gt.withColumn("iscrowd", F.lit(False))
    dt = dt.where(F.col("score") >= min_score)
    seen = images.select("image_id").distinct()
    rows = (g.select("image_id", F.lit(0).alias("kind"), F.col("gt_id").cast("long").alias("id"), F.coalesce("iscrowd", F.lit(False)).alias("crowd"), marks.alias("marks"), *box)
            .unionByName(dt.select("image_id", F.lit(1).alias("kind"), F.col("dt_id").cast("long").alias("id"), F.lit(False).alias("crowd"), F.lit(0).alias("marks"), *box))
            .where("image_id is not null"))
    total, most = key_sizes(rows, ["image_id"], WALK_BOXES)
    big = None
    if most > WALK_BOXES:
        rows, hot = split_hot(rows, ["image_id"], WALK_BOXES)
        hot = cut(hot.select("image_id").distinct())
        some, seen = seen.join(hot, "image_id", "left_semi"), seen.join(hot, "image_id", "left_anti")
        some, own, other = cut(some), cut(g.join(hot, "image_id", "left_semi").withColumn("_marks", marks)), cut(dt.join(hot, "image_id", "left_semi"))
        big = best_of([per_image(some, own.where(F.col("_marks").bitwiseAND(1 << i) > 0), other, min_score) for i in range(len(subsets))])
    none = {"kind": F.lit(2), "id": F.lit(0).cast("long"), "crowd": F.lit(False), "marks": F.lit(0)} | {c: F.lit(None).cast(rows.schema[c].dataType) for c in box}
    rows = rows.unionByName(seen.withColumns(none))
    n = len(subsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in _whole_batches(batches, ["image_id"]):
            listed, counts = _counts(b, np.asarray(starts), n)
            yield pa.RecordBatch.from_arrays([b.column("image_id").take(pa.array(np.asarray(starts)[:-1][listed])), pa.FixedSizeListArray.from_arrays(pa.array(counts[listed].ravel()), counts.shape[1]).cast(pa.list_(pa.int64()))], ["image_id", "counts"])

    made = _by_key(rows, ["image_id"], ["kind", "id"]).mapInArrow(run, f"image_id {rows.schema['image_id'].dataType.simpleString()}, counts array<long>")
    at = lambda i: (F.col("counts")[1 + i], F.col("counts")[0], F.slice("counts", 1 + n + i * len(THRESHOLDS) + 1, len(THRESHOLDS)))
    parts = [F.struct(*_rank(*at(i), F.lit(i)), *[c.alias(k) for k, c in zip(("n_gt", "n_dt", "tp"), at(i))]) for i in range(n)]
    out = made.select("image_id", F.array_max(F.array(*parts)).alias("s")).select("image_id", "s.n_gt", "s.n_dt", "s.tp")
    return out if big is None else out.unionByName(big)


def _counts(b: pa.RecordBatch, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of whole images sorted by kind (ground truth, detections, listed image) and id: whether each is listed, and its counts: detections,
    ground truth of each of the n subsets, then true positives at all thresholds subset by subset."""
    kind, ids, crowd, marks, x0, y0, x1, y1 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "id", "crowd", "marks", "x0", "y0", "x1", "y1"))
    m = len(starts) - 1
    image = np.repeat(np.arange(m), np.diff(starts))
    code = np.cumsum(np.concatenate(([True], (image[1:] != image[:-1]) | (kind[1:] != kind[:-1]) | (ids[1:] != ids[:-1])))) if len(ids) else ids   # one per id of a side
    g, d = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    n_dt = np.bincount(image[d], minlength=m)
    per = n_dt[image[g]]
    i = np.repeat(g, per)
    j = d[np.arange(len(i)) + np.repeat((np.cumsum(n_dt) - n_dt)[image[g]] - np.cumsum(per) + per, per)]
    hit = (x0[i] < x1[j]) & (x0[j] < x1[i]) & (y0[i] < y1[j]) & (y0[j] < y1[i])
    i, j = i[hit], j[hit]
    inter = (np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j])) * (np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j]))
    area = (x1 - x0) * (y1 - y0)
    union = np.where(crowd[i], area[j], area[i] + area[j] - inter)
    sim = np.divide(inter, union, out=np.zeros(len(i)), where=union > 0)
    counts = np.zeros((m, 1 + n + n * len(THRESHOLDS)), np.int64)
    counts[:, 0] = n_dt
    for s in range(n):
        counts[:, 1 + s] = np.bincount(image[g][(marks[g] >> s & 1) > 0], minlength=m)
        use = np.flatnonzero((marks[i] >> s & 1 > 0) & (sim > 0))
        r, c = code[i[use]], code[j[use]]
        alone = (np.bincount(r, minlength=len(ids) + 1)[r] == 1) & (np.bincount(c, minlength=len(ids) + 1)[c] == 1)
        chosen, rest = [use[alone]], np.flatnonzero(~alone)
        of = image[i[use[rest]]]
        cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else of
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
            part = rest[lo:hi]
            chosen.append(use[part[solve(r[part], c[part], sim[use[part]])]])
        picked = np.concatenate(chosen)
        for k, t in enumerate(THRESHOLDS):
            counts[:, 1 + n + s * len(THRESHOLDS) + k] = np.bincount(image[i[picked]][sim[picked] >= t], minlength=m)
    return np.bincount(image[kind == 2], minlength=m) > 0, counts


def accumulate(scored: DataFrame) -> DataFrame:
    """One row per IoU threshold with counts and metrics.

    Images without both sides count only in the image-level part; an image with ground truth but no detection adds a zero to
    the macro sum and is not in its denominator. False positives of images with ground truth feed the positive-micro score."""
    g, d = F.col("n_gt") > 0, F.col("n_dt") > 0
    il = [F.count_if(g & d).alias("il_tp"), F.count_if(~g & d).alias("il_fp"), F.count_if(~g & ~d).alias("il_tn"), F.count_if(g & ~d).alias("il_fn")]
    tp = [F.col("tp")[i] for i in range(len(THRESHOLDS))]
    sums = []
    for i, t in enumerate(tp):
        fp, fn = F.col("n_dt") - t, F.col("n_gt") - t
        sums += [F.sum(t).alias(f"tp{i}"), F.sum(fp).alias(f"fp{i}"), F.sum(fn).alias(f"fn{i}"), F.sum(F.when(g, fp).otherwise(0)).alias(f"pfp{i}"),
                 F.sum(F.when(g & d, f1(t, fp, fn)).otherwise(0.0)).alias(f"lf{i}")]
    one = scored.agg(*il, *sums)
    per = F.explode(F.array(*[F.struct(F.lit(t).alias("iou"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "pfp", "lf")]) for i, t in enumerate(THRESHOLDS)]))
    r = one.select("il_tp", "il_fp", "il_tn", "il_fn", per.alias("m")).select("il_tp", "il_fp", "il_tn", "il_fn", "m.*")
    a, b, c, n = (F.col(x).cast("double") for x in ("il_tp", "il_fp", "il_fn", "il_tn"))
    rec, prec = a / (a + c + EPS_IL), a / (a + b + EPS_IL)
    mcc = (a * n - b * c) / (F.sqrt((a + b) * (a + c) * (n + b) * (n + c)) + EPS_IL)
    tp_, fp_, fn_, pfp_ = (F.col(x) for x in ("tp", "fp", "fn", "pfp"))
    pm = f1(tp_, pfp_, fn_)
    return r.select("iou", "tp", "fp", "fn", F.col("pfp").alias("positive_micro_fp"), (tp_ / (tp_ + fp_ + EPS)).alias("precision"), (tp_ / (tp_ + fn_ + EPS)).alias("recall"),
                    f1(tp_, fp_, fn_).alias("f1"), (tp_ / (tp_ + pfp_ + EPS)).alias("positive_micro_precision"), pm.alias("positive_micro_f1"), (F.col("lf") / F.nullif(F.col("il_tp"), F.lit(0))).alias("positive_macro_f1"),
                    rec.alias("il_recall"), prec.alias("il_precision"), (2 * prec * rec / (prec + rec + EPS_IL)).alias("il_f1"), (b / (b + n + EPS_IL)).alias("il_fpr"),
                    mcc.alias("il_mcc"), (pm * mcc).alias("cgf1"))


def summarise(acc: DataFrame, metrics: list[str]) -> DataFrame:
    """Each metric averaged over the thresholds, and at 0.50 and 0.75; values of -1 mean undefined and are skipped."""
    def mean(c, cond):
        return F.coalesce(F.avg(F.when(cond & (F.col(c) > -1), F.col(c))), F.lit(-1.0))
    return acc.agg(*[mean(m, F.lit(True)).alias(m) for m in metrics], *[mean(m, F.col("iou") == 0.5).alias(f"{m}_50") for m in metrics],
                   *[mean(m, F.col("iou") == 0.75).alias(f"{m}_75") for m in metrics])


def image_scores(scored: DataFrame) -> DataFrame:
    """Per image: mean local F1 (1 when both sides are empty) and whether it is perfect at 0.5."""
    local = F.transform("tp", lambda t: f1(t, F.col("n_dt") - t, F.col("n_gt") - t))
    mean = F.aggregate(local, F.lit(0.0), lambda s, v: s + v) / len(THRESHOLDS)
    empty = (F.col("n_gt") == 0) & (F.col("n_dt") == 0)
    return scored.select("image_id", "n_gt", "n_dt", F.when(empty, 1.0).otherwise(mean).alias("mean_f1"),
                         ((F.col("tp")[0] == F.col("n_gt")) & (F.col("tp")[0] == F.col("n_dt"))).alias("perfect"))


def demo_summary(scored: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Demo evaluation: image-perfect rate, macro F1 over all positive images and over those with detections, mean J, F and J&F.

    `quality`: matched mask pairs (image_id, j, f)."""
    s = image_scores(scored)
    pos, det = F.col("n_gt") > 0, F.col("n_dt") > 0
    out = s.agg(F.avg(F.col("perfect").cast("double")).alias("image_perfect"), F.avg(F.when(pos, F.when(det, F.col("mean_f1")).otherwise(0.0))).alias("macro_f1_all"),
                F.avg(F.when(pos & det, F.col("mean_f1"))).alias("macro_f1_with_detections"))
    if quality is not None:
        out = out.crossJoin(quality.agg(F.avg("j").alias("j"), F.avg("f").alias("f"), F.avg((F.col("j") + F.col("f")) / 2).alias("j_and_f")))
    return out


def box_quality(gt: DataFrame, dt: DataFrame) -> DataFrame:
    """Held-out quality: best detection per ground truth (many to one), mean IoU, shares, mean L1 and GIoU.

    L1 sums the differences of centre, width and height. Without overlap the image's first detection is taken, as the first of equal
    IoUs; ground truth of images without detections counts in IoU and shares only."""
    a, b = B.box("a."), B.box("b.")
    p = box_pairs(gt.select("image_id", "gt_id", "x0", "y0", "x1", "y1"), ["image_id"], lambda x, y: F.lit(True), right=dt.select("image_id", "dt_id", "x0", "y0", "x1", "y1"))

    def form(x):
        return [(x[0] + x[2]) / 2.0, (x[1] + x[3]) / 2.0, x[2] - x[0], x[3] - x[1]]

    l1 = sum(F.abs(x - y) for x, y in zip(form(a), form(b)))
    best = p.groupBy("image_id", F.col("a.gt_id").alias("gt_id")).agg(
        F.max_by(F.struct(B.iou(a, b).alias("iou"), l1.alias("l1"), B.giou(a, b).alias("giou")), F.struct(B.iou(a, b), -F.col("b.dt_id"))).alias("m"))
    first = dt.groupBy("image_id").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "dt_id").alias("b"))
    j = gt.select("image_id", "gt_id", F.struct("x0", "y0", "x1", "y1").alias("a")).join(best, ["image_id", "gt_id"], "left").join(first, "image_id", "left")
    lone = F.struct(F.lit(0.0).alias("iou"), l1.alias("l1"), B.giou(a, b).alias("giou"))
    j = j.withColumn("m", F.coalesce("m", F.when(F.col("b").isNotNull(), lone))).withColumn("iou", F.coalesce("m.iou", F.lit(0.0)))
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg("iou").alias("mean_iou"), F.avg((F.col("iou") >= 0.5).cast("double")).alias("share_50"),
                 F.avg((F.col("iou") >= 0.75).cast("double")).alias("share_75"), F.avg("m.l1").alias("mean_l1"), F.avg("m.giou").alias("mean_giou"))
