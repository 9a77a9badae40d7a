"""COCO-style AP and AR: greedy matching by score, precision/recall curves by distributed running sums, 101 recall points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.operators.assign import components_of, per_key
from slidemesh.operators.scan import running, top_n
from slidemesh.plans.concept_f1 import THRESHOLDS, gt_dt_pairs
from slidemesh.runtime import cut, split_hot

AREAS = {"all": (0, 1e10), "small": (0, 32**2), "medium": (32**2, 96**2), "large": (96**2, 1e10)}          # fixed values
VIDEO_AREAS = {"all": (0, 1e10), "small": (0, 128**2), "medium": (128**2, 256**2), "large": (256**2, 1e10)}  # fixed values
HOT_PAIRS = 50_000


def limit_detections(dt: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best-scored detections per image (and class); position breaks ties."""
    return top_n(dt, keys, ["-score", "dt_id"], n)


def match(gt: DataFrame, dt: DataFrame, keys: list[str], areas: dict = AREAS, pairs: DataFrame | None = None) -> DataFrame:
    """One row per matched detection: keys, dt_id and, for the k-th area range, bits tp{k} (true positive) and ig{k} (matched but ignored) with one bit
    per threshold.

    gt: keys, gt_id, area, iscrowd; dt: keys, dt_id, score. Only pairs with IoU at least the lowest threshold can match. A pair whose two
    sides have no other candidate is decided in the JVM; the others are walked by score per key, or per connected component of pairs
    where a key has very many."""
    if pairs is None:
        p = gt_dt_pairs(gt, dt, keys, ("area", "iscrowd"), ("score",))
        p = p.withColumns({"g_area": F.col("area").cast("double"), "score": F.col("score").cast("double")}).drop("area")
    else:
        g = gt.select(*keys, F.col("gt_id").cast("long").alias("r"), F.col("area").cast("double").alias("g_area"), F.col("iscrowd"))
        d = dt.select(*keys, F.col("dt_id").cast("long").alias("c"), F.col("score").cast("double").alias("score"))
        p = pairs.join(g, [*keys, "r"]).join(d, [*keys, "c"])
    # the threshold is tested after the cut: pushed into the join, IoU makes its loop too large a method for the JVM to compile
    base = cut(p).where(F.col("sim") >= THRESHOLDS[0])
    deg_r = base.groupBy(*keys, "r").agg(F.count(F.lit(1)).alias("_dr"))
    deg_c = base.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("_dc"))
    tagged = base.join(deg_r, [*keys, "r"]).join(deg_c, [*keys, "c"])
    ranges = [(float(lo), float(hi)) for lo, hi in areas.values()]
    names = [f"{x}{k}" for k in range(len(ranges)) for x in ("tp", "ig")]
    # thresholds reached, as low bits
    reached = (F.lit(2) ** sum((F.col("sim") >= t).cast("int") for t in THRESHOLDS) - 1).cast("int")
    out = tagged.where("_dr = 1 AND _dc = 1").withColumn("_b", reached)
    ignored = [F.col("iscrowd") | (F.col("g_area") < lo) | (F.col("g_area") > hi) for lo, hi in ranges]
    alone = out.select(*keys, F.col("c").alias("dt_id"), *[F.when(i == want, F.col("_b")).otherwise(0).alias(f"{x}{k}") for k, i in enumerate(ignored) for x, want in (("tp", False), ("ig", True))])
    cols, schema = ["c", "r", "sim", "g_area", "iscrowd"], "dt_id long, " + ", ".join(f"{n} int" for n in names)

    def walk(*lists: list) -> list[tuple]:
        cand: dict = {}
        for c, r, sim, area, crowd in zip(*lists):
            cand.setdefault(c, []).append((r, sim, bool(crowd), [bool(crowd) or area < lo or area > hi for lo, hi in ranges]))
        top = max(lists[2])
        bits = {c: [0] * len(names) for c in cand}
        for i, t in enumerate(THRESHOLDS):
            if t > top:
                break
            for k in range(len(ranges)):
                taken: set = set()
                for c, options in cand.items():
                    best = None
                    for r, sim, crowd, ignore in options:
                        if sim >= t and (crowd or r not in taken):
                            # regular ones before ignored ones, then IoU, the later one on ties
                            key = (not ignore[k], sim, r)
                            best = key if best is None or key > best else best
                    if best is not None:
                        taken.add(best[2])
                        bits[c][2 * k + (not best[0])] |= 1 << i
        return [(c, *b) for c, b in bits.items() if any(b)]

    walk_order = ["neg", "c", "r"]
    cold, hot = split_hot(tagged.where("_dr > 1 OR _dc > 1").drop("_dr", "_dc").withColumn("neg", -F.col("score")), keys, HOT_PAIRS)
    hit = alone.unionByName(per_key(cold, keys, walk_order, cols, walk, schema))
    if hot is not None:
        hit = hit.unionByName(per_key(components_of(cut(hot), keys), [*keys, "comp"], walk_order, cols, walk, schema).drop("comp"))
    return hit


def curve(matched: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds running tp and fp per (by) in score order; ignored detections are left out."""
    m = matched.where("NOT ignore")
    return running(m, by, order, sums={"ctp": F.col("tp").cast("long"), "cfp": (~F.col("tp")).cast("long")})


def average_precision(matched: DataFrame, n_gt: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """AP and final recall per (by): precision envelope read at 101 recall points.

    n_gt: (by subset, n) of non-ignored ground truth. The envelope at a recall point is the best precision of any row at or
    beyond it, so rows go to the last recall point they reach; a suffix maximum over 101 values per key finishes it. No
    sort of a class beyond the running sums is needed."""
    gkeys = [c for c in n_gt.columns if c != "n"]
    extra = [k for k in by if k not in gkeys]
    frame = n_gt if not extra else n_gt.join(matched.select(*by).distinct(), gkeys)
    return _interpolate(curve(matched, by, order).where("tp"), n_gt, by, frame)


def _interpolate(hits: DataFrame, n_gt: DataFrame, by: list[str], frame: DataFrame) -> DataFrame:
    """AP and recall from the true-positive rows (by, ctp, cfp); `frame` lists the combinations to report."""
    rec = F.col("ctp") / F.col("n")
    # the highest recall point i/100 that the row reaches
    pts = hits.join(n_gt, [c for c in n_gt.columns if c != "n"]).select(*by, (F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("p"), F.floor(rec * 100 + 1e-9).cast("int").alias("pt"), rec.alias("rec"))
    return _envelope(pts, by, frame)


def _envelope(pts: DataFrame, by: list[str], frame: DataFrame) -> DataFrame:
    """AP and recall from precisions and recalls (by, pt, p, rec) at recall points."""
    per_pt = pts.groupBy(*by, "pt").agg(F.max("p").alias("p"), F.max("rec").alias("rec"))
    w = Window.partitionBy(*by).orderBy(F.desc("pt")).rowsBetween(Window.unboundedPreceding, 0)
    env = per_pt.withColumns({"p": F.max("p").over(w), "prev": F.lag("pt").over(Window.partitionBy(*by).orderBy("pt"))})
    # point pt covers recall points prev+1 .. pt
    s = env.groupBy(*by).agg((F.sum(F.col("p") * (F.col("pt") - F.coalesce("prev", F.lit(-1)))) / 101).alias("ap"), F.max("rec").alias("ar"))
    return frame.where("n > 0").select(*by).join(s, by, "left").select(*by, F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"))


def gt_counts(gt: DataFrame, keys: list[str], areas: dict = AREAS) -> DataFrame:
    """Non-ignored ground truth per (keys, area_range)."""
    cells = F.array(*[F.struct(F.lit(n).alias("area_range"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, (lo, hi) in areas.items()])
    g = gt.where("NOT iscrowd").select(*keys, "area", F.explode(cells).alias("c"))
    return g.where("area >= c.lo AND area <= c.hi").groupBy(*keys, F.col("c.area_range").alias("area_range")).agg(F.count(F.lit(1)).alias("n"))


def _flags(pdf: pd.DataFrame, ranges: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """True and false positives, (area range, threshold) x rows."""
    shift, area = np.arange(len(THRESHOLDS), dtype="int32")[:, None], pdf["area"].to_numpy()
    tp, fp = [], []
    for k, (lo, hi) in enumerate(ranges):
        hit, ig = (pdf[f"{x}{k}"].to_numpy(dtype="int32") for x in ("tp", "ig"))
        tp.append((hit >> shift) & 1 == 1)
        fp.append(((hit | ig) >> shift & 1 == 0) & ~((area < lo) | (area > hi)))
    return np.vstack(tp), np.vstack(fp)


def _recall_points(wide: DataFrame, n_gt: DataFrame, by: list[str], order: list[str], areas: dict) -> DataFrame:
    """(by, area_range, iou, pt, p, rec): best precision and recall among the true positives whose recall reaches last the point pt of 100.

    Detections are cut into slices in order; the counts of each slice add up to what the next begins with; then each slice is scanned once for
    all area ranges and thresholds. Scans keep counts and a table of 101 points per cell, no rows."""
    ranges = [(float(lo), float(hi)) for lo, hi in areas.values()]
    cells, names = len(ranges) * len(THRESHOLDS), list(areas)
    n = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(k) for k in by] + [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]
    sliced = cut(wide.repartitionByRange(n, *sort).withColumn("_slice", F.spark_partition_id()))
    types = {f.name: f.dataType.simpleString() for f in sliced.schema.fields}
    own = [*by, "_slice"]
    head = ", ".join(f"`{k}` {types[k]}" for k in own)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = np.vstack(_flags(pdf, ranges))
            rows = [(*(k if isinstance(k, tuple) else (k,)), both[:, at].sum(1).tolist()) for k, at in pdf.groupby(own, dropna=False, sort=False).indices.items()]
            yield pd.DataFrame(rows, columns=[*own, "s"])

    part = sliced.select(*own, "area", *[c for c in sliced.columns if c[:2] in ("tp", "ig")]).mapInPandas(totals, f"{head}, s array<long>")
    part = part.groupBy(*own).agg(F.array(*[F.sum(F.col("s")[i]) for i in range(2 * cells)]).alias("s"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(*own, F.array(*[F.coalesce(F.sum(F.col("s")[i]).over(before), F.lit(0)) for i in range(2 * cells)]).alias("_carry"))
    keys = [c for c in n_gt.columns if c not in ("n", "area_range")]
    goal = n_gt.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("area_range", "n"))).alias("_m")).select(*keys, F.array(*[F.coalesce(F.try_element_at("_m", F.lit(a)), F.lit(0)) for a in names]).alias("_n"))
    carry = carry.join(F.broadcast(goal), keys) if keys else carry.crossJoin(F.broadcast(goal))
    rows = sliced.withColumn("_at", F.lit(1)).unionByName(carry.withColumn("_at", F.lit(0)), allowMissingColumns=True)
    # one row of counts leads each slice; slices of categories without ground truth have none
    rows = rows.repartition(n, *own).sortWithinPartitions(*own, "_at", *sort[len(by):])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None

        def found() -> pd.DataFrame:
            cell, pt = np.nonzero(best > 0)
            out = pd.DataFrame({"_c": cell, "pt": pt, "p": best[cell, pt], "rec": last[cell, pt]})
            for k, v in zip(by, key):
                out[k] = v
            return out[[*by, "_c", "pt", "p", "rec"]]

        for pdf in batches:
            for lead in [0, *np.flatnonzero(pdf["_at"].to_numpy() == 0)]:
                lead = int(lead)
                end = lead + 1
                if pdf["_at"].iat[lead] == 0:
                    if key is not None:
                        yield found()
                    key = tuple(pdf[k].iat[lead] for k in by)
                    start = np.asarray(pdf["_carry"].iat[lead], dtype="int64").reshape(2, cells)
                    goals = np.repeat(np.asarray(pdf["_n"].iat[lead], dtype="float64"), len(THRESHOLDS))
                    best, last = np.zeros((cells, 101)), np.zeros((cells, 101))
                elif lead or key is None:
                    continue
                else:
                    end = lead
                nxt = np.flatnonzero(pdf["_at"].to_numpy()[end:] == 0)
                body = pdf.iloc[end:end + int(nxt[0]) if len(nxt) else len(pdf)]
                body = body[(body[by] == list(key)).all(axis=1)] if len(body) else body
                if not len(body):
                    continue
                tp, fp = _flags(body, ranges)
                ctp, cfp = (x.cumsum(1, dtype="int64") + n0[:, None] for x, n0 in zip((tp, fp), start))
                start = np.stack([ctp[:, -1], cfp[:, -1]])
                for c in np.flatnonzero(tp.any(1)):
                    at = np.flatnonzero(tp[c])
                    t = ctp[c, at].astype("float64")
                    p, rec = t / (t + cfp[c, at]), t / goals[c]
                    pt = np.floor(rec * 100 + 1e-9).astype("int64")
                    first = np.flatnonzero(np.diff(pt, prepend=-1))
                    best[c, pt[first]] = np.maximum(best[c, pt[first]], np.maximum.reduceat(p, first))
                    last[c, pt[first]] = np.maximum.reduceat(rec, first)
        if key is not None:
            yield found()

    out = rows.mapInPandas(scan, ", ".join([*[f"`{k}` {types[k]}" for k in by], "_c int, pt int, p double, rec double"]))
    ranged = F.element_at(F.array(*[F.lit(a) for a in names]), (F.floor(F.col("_c") / len(THRESHOLDS)) + 1).cast("int"))
    return out.select(*by, ranged.alias("area_range"), F.element_at(F.array(*[F.lit(t) for t in THRESHOLDS]), (F.col("_c") % len(THRESHOLDS) + 1).cast("int")).alias("iou"), "pt", "p", "rec")


def evaluate(gt: DataFrame, dt: DataFrame, image: str = "image_id", category: str | None = "category_id", areas: dict = AREAS, max_dets: int = 100,
             pairs: DataFrame | None = None) -> DataFrame:
    """AP and AR per (category, area range, IoU).

    All area ranges and thresholds share one ordered pass over the detections, which are sorted once and not once per combination."""
    keys = [image] + ([category] if category else [])
    cat = [category] if category else []
    box = [] if pairs is not None else ["x0", "y0", "x1", "y1"]
    gt = cut(gt.select(*keys, "gt_id", "area", "iscrowd", *box))
    d = cut(limit_detections(dt.select(*keys, "dt_id", "score", "area", *box), keys, max_dets).withColumn("dt_id", F.col("dt_id").cast("long")))
    hit = match(gt, d, keys, areas, pairs)
    wide = d.select(*keys, "dt_id", "score", F.col("area").cast("double").alias("area")).join(hit, [*keys, "dt_id"], "left").fillna(0, [c for c in hit.columns if c[:2] in ("tp", "ig")])
    n_gt = gt_counts(gt, cat, areas)
    by = cat or ["_g"]
    pts = _recall_points(wide if cat else wide.withColumn("_g", F.lit(0)), n_gt, by, ["-score", image, "dt_id"], areas)
    return _envelope(pts, [*cat, "area_range", "iou"], n_gt.withColumn("iou", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS]))))


def summary(per_class: DataFrame) -> DataFrame:
    """The usual numbers: mean over classes and thresholds, at 0.50 and 0.75, per area range."""
    return per_class.groupBy("area_range").agg(F.avg("ap").alias("ap"), F.avg(F.when(F.col("iou") == 0.5, F.col("ap"))).alias("ap50"),
                                               F.avg(F.when(F.col("iou") == 0.75, F.col("ap"))).alias("ap75"), F.avg("ar").alias("ar"))


def bucket_summary(per_class: DataFrame, buckets: DataFrame, category: str = "category_id") -> DataFrame:
    """Metric per rarity bucket (category, bucket) and, in the NULL row, the mean of the buckets."""
    b = per_class.where("area_range = 'all'").join(buckets, category).groupBy("bucket").agg(F.avg("ap").alias("ap"))
    return b.rollup("bucket").agg(F.avg("ap").alias("ap"))


def first_shard(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions gathered from several shards: per key only those of the lowest shard that has it."""
    first = preds.groupBy(*keys).agg(F.min("shard").alias("shard"))
    return preds.join(first, [*keys, "shard"], "left_semi")


def video_pairs(gt: DataFrame, dt: DataFrame, empty_is_one: bool = False) -> DataFrame:
    """Track pairs (keys, r, c, sim): intersections summed over frames divided by unions summed over all frames of both.

    gt/dt: key columns video_id, category_id, frame_idx, gt_id/dt_id and a box (rows without a box do not count)."""
    k = ["video_id", "category_id"]
    a, b = B.box("a."), B.box("b.")
    own_g = gt.where(B.nonempty(B.box())).groupBy(*k, F.col("gt_id").cast("long").alias("r")).agg(F.sum(B.area(B.box())).alias("ga"))
    own_d = dt.where(B.nonempty(B.box())).groupBy(*k, F.col("dt_id").cast("long").alias("c")).agg(F.sum(B.area(B.box())).alias("da"))
    p = box_pairs_by_frame(gt, dt, k)
    inter = p.groupBy(*k, F.col("a.gt_id").cast("long").alias("r"), F.col("b.dt_id").cast("long").alias("c")).agg(F.sum(B.inter_area(a, b)).alias("inter"))
    j = inter.join(own_g, [*k, "r"]).join(own_d, [*k, "c"])
    return j.select(*k, "r", "c", B.ratio(F.col("inter"), F.col("ga") + F.col("da") - F.col("inter")).alias("sim"))


def box_pairs_by_frame(gt: DataFrame, dt: DataFrame, keys: list[str]) -> DataFrame:
    from slidemesh.operators.pairs import box_pairs
    return box_pairs(gt.select(*keys, "frame_idx", "gt_id", "x0", "y0", "x1", "y1"), [*keys, "frame_idx"], lambda a, b: F.lit(True),
                     right=dt.select(*keys, "frame_idx", "dt_id", "x0", "y0", "x1", "y1"))


def tracks_of(frames: DataFrame, ident: str, extra: list[str]) -> DataFrame:
    """One row per track with its mean area over present frames."""
    return frames.where(B.nonempty(B.box())).groupBy("video_id", "category_id", ident, *extra).agg(F.avg(B.area(B.box())).alias("area"))


def remap_pairs(gt: DataFrame, dt: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """(video_id, category_id) -> new_video_id, ids sorted by pair from 1; annotated negative pairs come after."""
    from slidemesh.operators.scan import positions
    pos = gt.select("video_id", "category_id").distinct().withColumn("neg", F.lit(0))
    if negatives is not None:
        pos = pos.unionByName(negatives.select("video_id", "category_id").distinct().join(pos.drop("neg"), ["video_id", "category_id"], "left_anti").withColumn("neg", F.lit(1)))
    return positions(pos.withColumn("_g", F.lit(0)), ["_g"], ["neg", "video_id", "category_id"], "new_video_id", start=1).drop("_g", "neg")


