"""HOTA and TETA as sums over sequences, so that any grouping of sequences and classes is a rollup of the same table.

Ground truth: seq keys, frame, gt_id, box; tracker: seq keys, frame, tk_id, box. Ids are unique per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.operators.assign import best_assignment
from slidemesh.operators.pairs import box_pairs
from slidemesh.runtime import cut

ALPHAS = [round(0.05 * (i + 1), 2) for i in range(19)]  # fixed values 0.05 .. 0.95
TETA_ALPHAS = [round(0.05 * i, 2) for i in range(20)]   # fixed values 0.00 .. 0.95
EPS = 2.220446049250313e-16                              # fixed value


def similarity(gt: DataFrame, trk: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping pairs per frame: keys, frame, gt_id, tk_id, sim."""
    p = box_pairs(gt.select(*keys, "frame", "gt_id", "x0", "y0", "x1", "y1"), [*keys, "frame"], lambda a, b: F.lit(True),
                  right=trk.select(*keys, "frame", "tk_id", "x0", "y0", "x1", "y1"))
    return p.select(*keys, "frame", F.col("a.gt_id").cast("long").alias("gt_id"), F.col("b.tk_id").cast("long").alias("tk_id"), B.iou(B.box("a."), B.box("b.")).alias("sim"))


def centre_similarity(dx: Column, dy: Column) -> Column:
    """max(0, 1 - distance / 2)."""
    return F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy) / 2)


def duplicate_ids(dets: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Ids that occur twice in a frame (must be empty)."""
    return dets.groupBy(*keys, "frame", ident).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sequence_counts(dets: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Detections and distinct ids per sequence; ids are collapsed first, so a hot sequence stays spread."""
    per = dets.groupBy(*keys, ident).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(F.sum("_n").alias("dets"), F.count(F.lit(1)).alias("ids"))


def alignment(sim: DataFrame, n_gt: DataFrame, n_tk: DataFrame, keys: list[str]) -> DataFrame:
    """Global alignment per (keys, gt_id, tk_id): summed normalised similarity over the Jaccard of both tracks' lengths."""
    row = sim.groupBy(*keys, "frame", "gt_id").agg(F.sum("sim").alias("_r"))
    col = sim.groupBy(*keys, "frame", "tk_id").agg(F.sum("sim").alias("_c"))
    norm = sim.join(row, [*keys, "frame", "gt_id"]).join(col, [*keys, "frame", "tk_id"])
    pot = norm.groupBy(*keys, "gt_id", "tk_id").agg(F.sum(F.col("sim") / (F.col("_r") + F.col("_c") - F.col("sim"))).alias("_p"))
    return (pot.join(n_gt, [*keys, "gt_id"]).join(n_tk, [*keys, "tk_id"])
            .select(*keys, "gt_id", "tk_id", (F.col("_p") / (F.col("gn") + F.col("tn") - F.col("_p"))).alias("ga"), "gn", "tn"))


def _lengths(dets: DataFrame, keys: list[str], ident: str, name: str) -> DataFrame:
    return dets.groupBy(*keys, F.col(ident).cast("long").alias(ident)).agg(F.count(F.lit(1)).alias(name))


def frame_matches(sim: DataFrame, gt: DataFrame, trk: DataFrame, keys: list[str]) -> DataFrame:
    """Per-frame assignment maximising alignment x similarity: keys, frame, gt_id, tk_id, sim, gn, tn."""
    ga = cut(alignment(sim, _lengths(gt, keys, "gt_id", "gn"), _lengths(trk, keys, "tk_id", "tn"), keys))
    scored = sim.join(ga, [*keys, "gt_id", "tk_id"]).select(*keys, "frame", F.col("gt_id").alias("r"), F.col("tk_id").alias("c"), (F.col("ga") * F.col("sim")).alias("value"), "sim")
    m = best_assignment(scored, [*keys, "frame"]).select(*keys, "frame", F.col("r").alias("gt_id"), F.col("c").alias("tk_id"), "sim")
    return m.join(ga.drop("ga"), [*keys, "gt_id", "tk_id"])


def _per_alpha(matches: DataFrame, keys: list[str], alphas: list[float]) -> DataFrame:
    """Long table keys, alpha, tp, loc, ass, ass_re, ass_pr (sums, not ratios)."""
    counts = matches.groupBy(*keys, "gt_id", "tk_id", "gn", "tn").agg(
        *[F.count_if(F.col("sim") >= a - EPS).alias(f"m{i}") for i, a in enumerate(alphas)], *[F.sum(F.when(F.col("sim") >= a - EPS, F.col("sim")).otherwise(0.0)).alias(f"l{i}") for i, a in enumerate(alphas)])
    one = lambda x: F.greatest(F.lit(1), x)
    aggs = []
    for i in range(len(alphas)):
        m = F.col(f"m{i}")
        aggs += [F.sum(m).alias(f"tp{i}"), F.sum(f"l{i}").alias(f"loc{i}"), F.sum(m * m / one(F.col("gn") + F.col("tn") - m)).alias(f"ass{i}"),
                 F.sum(m * m / one(F.col("gn"))).alias(f"re{i}"), F.sum(m * m / one(F.col("tn"))).alias(f"pr{i}")]
    wide = counts.groupBy(*keys).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"tp{i}").alias("tp"), F.col(f"loc{i}").alias("loc"), F.col(f"ass{i}").alias("ass"), F.col(f"re{i}").alias("ass_re"), F.col(f"pr{i}").alias("ass_pr"))
                      for i, a in enumerate(alphas)])
    return wide.select(*keys, F.inline(cells))


def hota_sums(gt: DataFrame, trk: DataFrame, keys: list[str]) -> DataFrame:
    """Additive parts per (keys, alpha): tp, fn, fp, loc, ass, ass_re, ass_pr. Sequences with one empty side stay."""
    sim = cut(similarity(gt, trk, keys))
    sums = _per_alpha(frame_matches(sim, gt, trk, keys), keys, ALPHAS)
    n = (gt.groupBy(*keys).agg(F.count(F.lit(1)).alias("ng")).join(trk.groupBy(*keys).agg(F.count(F.lit(1)).alias("nt")), keys, "full").fillna(0, ["ng", "nt"]))
    grid = n.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    j = grid.join(sums, [*keys, "alpha"], "left").fillna(0, ["tp"]).fillna(0.0, ["loc", "ass", "ass_re", "ass_pr"])
    return j.select(*keys, "alpha", "tp", (F.col("ng") - F.col("tp")).alias("fn"), (F.col("nt") - F.col("tp")).alias("fp"), "loc", "ass", "ass_re", "ass_pr")


def combine(sums: DataFrame, by: list[str] | None = None, how: str = "groupBy") -> DataFrame:
    """Add parts over `by` + alpha; how = 'rollup' or 'cube' gives the totals rows as well."""
    cols = [c for c, t in sums.dtypes if c in ("tp", "fn", "fp", "loc", "ass", "ass_re", "ass_pr")]
    aggs = [F.sum(c).alias(c) for c in cols]
    if not by:
        return sums.groupBy("alpha").agg(*aggs)
    if how == "groupBy":
        return sums.groupBy(*by, "alpha").agg(*aggs)
    packed = sums.groupBy(*by, "alpha").agg(*aggs).groupBy(*by)
    # alpha is never rolled up: it is carried inside an array of per-alpha parts while the keys are
    if how not in ("rollup", "cube"):
        raise ValueError(how)
    wide = packed.agg(*[F.sum(F.when(F.col("alpha") == a, F.col(c)).otherwise(0)).alias(f"{c}_{i}") for i, a in enumerate(ALPHAS) for c in cols])
    grouped = getattr(wide, how)(*by).agg(*[F.sum(f"{c}_{i}").alias(f"{c}_{i}") for i in range(len(ALPHAS)) for c in cols])
    return grouped.select(*by, F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), *[F.col(f"{c}_{i}").alias(c) for c in cols]) for i, a in enumerate(ALPHAS)])))


def hota_scores(sums: DataFrame) -> DataFrame:
    """DetA, AssA, LocA, HOTA, OWTA and their recall and precision forms from summed parts."""
    one = lambda x: F.greatest(F.lit(1), x)
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    det, det_re, det_pr = tp / one(tp + fn + fp), tp / one(tp + fn), tp / one(tp + fp)
    ass = F.col("ass") / one(tp)
    loc = F.greatest(F.lit(1e-10), F.col("loc")) / F.greatest(F.lit(1e-10), tp.cast("double"))
    keep = [c for c in sums.columns if c not in ("loc", "ass", "ass_re", "ass_pr")]
    return sums.select(*keep, det.alias("det_a"), det_re.alias("det_re"), det_pr.alias("det_pr"), ass.alias("ass_a"), (F.col("ass_re") / one(tp)).alias("ass_re"),
                       (F.col("ass_pr") / one(tp)).alias("ass_pr"), loc.alias("loc_a"), F.sqrt(det * ass).alias("hota"), F.sqrt(det_re * ass).alias("owta"))


def class_average(scores: DataFrame, cls: str, ignore_empty: bool = False) -> DataFrame:
    """Mean over classes per alpha; a class with no detection at all can be left out."""
    if ignore_empty:
        live = scores.groupBy(cls).agg(F.max(F.col("tp") + F.col("fn") + F.col("fp")).alias("_n")).where("_n > 0").select(cls)
        scores = scores.join(live, cls, "left_semi")
    ratios = [c for c in scores.columns if c not in (cls, "alpha", "tp", "fn", "fp")]
    return scores.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")], *[F.avg(c).alias(c) for c in ratios])


def super_category(sums: DataFrame, parents: DataFrame, cls: str) -> DataFrame:
    """Parts added up per parent class (cls, parent)."""
    return combine(sums.join(parents, cls), ["parent"])


def mean_over_alpha(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    cols = [c for c in scores.columns if c not in ("alpha", "tp", "fn", "fp", *(by or []))]
    aggs = [F.avg(c).alias(c) for c in cols]
    return scores.groupBy(*by).agg(*aggs) if by else scores.agg(*aggs)


def only_tagged(seqs: DataFrame, tag: str) -> DataFrame:
    """Sequences with a challenge tag; an unknown tag is an error."""
    out = seqs.where(F.array_contains("tags", tag))
    if out.isEmpty():
        raise ValueError(f"no sequence has tag {tag}")
    return out


def drop_empty_frames(frames: DataFrame, min_score: float | None = None) -> DataFrame:
    """Absent frames (no area, no box or all zeros) go away; the score threshold is strict, then scores become 1."""
    out = frames if min_score is None else frames.where(F.col("score") > min_score)
    present = (F.coalesce("area", F.lit(0)) > 0) & ~((F.col("x0") == 0) & (F.col("y0") == 0) & (F.col("x1") == 0) & (F.col("y1") == 0))
    return out.where(F.coalesce(present, F.lit(False))).withColumn("score", F.lit(1.0))


def prune_unmatched(gt: DataFrame, trk: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Drop unmatched tracker boxes where the class is not exhaustively labelled, or where a non-negative class has no ground
    truth in the frame. frames: keys, frame, not_exhaustive, negative."""
    sim = similarity(gt, trk, keys).where(F.col("sim") >= 0.5 - EPS)
    m = best_assignment(sim.select(*keys, "frame", F.col("gt_id").alias("r"), F.col("tk_id").alias("c"), F.col("sim").alias("value"), "sim"), [*keys, "frame"])
    hit = m.select(*keys, "frame", F.col("c").alias("tk_id"), F.lit(True).alias("_hit"))
    has = gt.select(*keys, "frame").distinct().withColumn("_gt", F.lit(True))
    j = trk.join(frames, [*keys, "frame"], "left").join(hit, [*keys, "frame", "tk_id"], "left").join(has, [*keys, "frame"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    gone = ~no("_hit") & (no("not_exhaustive") | (~no("_gt") & ~no("negative")))
    return j.where(~gone).select(*trk.columns)


# TETA ----------------------------------------------------------------------------------------------------------------
def teta_sums(gt: DataFrame, trk: DataFrame, keys: list[str], exhaustive: bool = True, two_pass: bool = True) -> DataFrame:
    """Additive parts per (keys, cls, alpha). gt has cls, trk has cls; classes come from the ground truth.

    Tracks enter a class when they overlap one of its boxes by at least half in some frame; with `two_pass`, not in frames
    where a class-free assignment gave them to another class. At alpha 0 zero-overlap pairs also count as located, as an
    assignment of the shorter side; they carry no association."""
    k = [*keys, "cls"]
    g, t = gt.withColumn("gt_id", F.col("gt_id").cast("long")), trk.withColumn("tk_id", F.col("tk_id").cast("long"))
    sim = cut(similarity(g, t, keys))
    sim_c = sim.join(g.select(*keys, "frame", "gt_id", "cls"), [*keys, "frame", "gt_id"])
    over = sim_c.where("sim >= 0.5").select(*k, "frame", "tk_id").distinct()
    if two_pass:
        near = sim.join(sim.where("sim >= 0.5").select(*keys, "tk_id").distinct(), [*keys, "tk_id"], "left_semi")
        live = t.join(sim.where("sim >= 0.5").select(*keys, "tk_id").distinct(), [*keys, "tk_id"], "left_semi")
        a = frame_matches(near, g, live, keys).where(F.col("sim") >= 0.5 - EPS).select(*keys, "frame", "gt_id", "tk_id")
        own = a.join(g.select(*keys, "frame", "gt_id", F.col("cls").alias("_own")), [*keys, "frame", "gt_id"]).select(*keys, "frame", "tk_id", "_own")
        over = over.join(own, [*keys, "frame", "tk_id"], "left").where(F.col("_own").isNull() | (F.col("_own") == F.col("cls"))).drop("_own")
    over = cut(over)
    tracks = over.select(*k, "tk_id").distinct()
    t_c = t.withColumnRenamed("cls", "tk_cls").join(tracks, [*keys, "tk_id"])
    sim_k = sim_c.join(tracks, [*k, "tk_id"], "left_semi")
    m = cut(frame_matches(sim_k, g, t_c, k))
    parts = _per_alpha(m, k, TETA_ALPHAS).drop("loc")
    # located at alpha 0: the smaller side of every frame
    fg = g.groupBy(*k, "frame").agg(F.count(F.lit(1)).alias("_g"))
    ft = t_c.groupBy(*k, "frame").agg(F.count(F.lit(1)).alias("_t"))
    low = fg.join(ft, [*k, "frame"], "left").groupBy(*k).agg(F.sum(F.least("_g", F.coalesce("_t", F.lit(0)))).alias("_tp0"))
    live = over.groupBy(*k).agg(F.count(F.lit(1)).alias("_over"))
    # false positives: overlapping tracks of a frame with ground truth that are not matched there at alpha
    lost = over.join(m.select(*k, "frame", "tk_id", "sim"), [*k, "frame", "tk_id"], "left")
    fp = lost.groupBy(*k).agg(*[F.count_if(F.coalesce(F.col("sim") < a - EPS, F.lit(True))).alias(f"fp{i}") for i, a in enumerate(TETA_ALPHAS)])
    fp = fp.select(*k, F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"fp{i}").alias("fp")) for i, a in enumerate(TETA_ALPHAS)])))
    # class part on the same matches
    mc = m.join(t.select(*keys, "frame", "tk_id", F.col("cls").alias("tk_cls")), [*keys, "frame", "tk_id"])
    cls_alphas = [a for a in TETA_ALPHAS if a >= 0.5]
    right = F.col("tk_cls") == F.col("cls")

    def counted(rows, by, cond, name):
        w = rows.groupBy(*by).agg(*[F.count_if(cond & (F.col("sim") >= a - EPS)).alias(f"n{i}") for i, a in enumerate(cls_alphas)])
        return w.select(*by, F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"n{i}").alias(name)) for i, a in enumerate(cls_alphas)])))

    ctp, cfn = counted(mc, k, right, "cls_tp"), counted(mc, k, ~right, "cls_fn")
    wrong = counted(mc.where(~right).drop("cls").withColumnRenamed("tk_cls", "cls"), k, F.lit(True), "cls_fp")
    n_gt = g.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    grid = n_gt.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in TETA_ALPHAS])))
    at = [*k, "alpha"]
    j = grid.join(parts, at, "left").join(low, k, "left").join(live, k, "left").join(fp, at, "left").join(ctp, at, "left").join(cfn, at, "left").join(wrong, at, "left")
    if exhaustive:
        extra = t.join(over, [*k, "frame", "tk_id"], "left_anti").groupBy(*k).agg(F.count(F.lit(1)).alias("_exh"))
        j = j.join(extra, k, "left")
    else:
        j = j.withColumn("_exh", F.lit(0).cast("long"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    tp = F.when(F.col("alpha") == 0.0, F.when(F.col("_over").isNotNull(), z("_tp0")).otherwise(0)).otherwise(z("tp"))
    f = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    high = F.col("alpha") >= 0.5
    return j.select(*k, "alpha", tp.alias("tp"), (F.col("_n") - tp).alias("fn"), z("fp").alias("fp"), f("ass"), f("ass_re"), f("ass_pr"), z("cls_tp").alias("cls_tp"), z("cls_fn").alias("cls_fn"),
                    F.when(high, z("cls_fp") + z("_exh")).otherwise(0).alias("cls_fp"))


def teta_scores(sums: DataFrame, by: list[str]) -> DataFrame:
    """LocA, AssocA (mean over alphas), ClsA (mean over alphas from 0.5) and TETA per `by`."""
    one = lambda x: F.greatest(F.lit(1), x)
    s = sums.groupBy(*by, "alpha").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in ("alpha", "cls", "seq", "video_id", *by)])
    tp, fn, fp, ct, cn, cf = (F.col(c) for c in ("tp", "fn", "fp", "cls_tp", "cls_fn", "cls_fp"))
    high = F.col("alpha") >= 0.5
    r = s.groupBy(*by).agg(F.avg(tp / one(tp + fn + fp)).alias("loc_a"), F.avg(tp / one(tp + fn)).alias("loc_re"), F.avg(tp / one(tp + fp)).alias("loc_pr"),
                           F.avg(F.col("ass") / one(tp)).alias("assoc_a"), F.avg(F.when(high, ct / one(ct + cn + cf))).alias("cls_a"),
                           F.avg(F.when(high, ct / one(ct + cn))).alias("cls_re"), F.avg(F.when(high, ct / one(ct + cf))).alias("cls_pr"))
    return r.withColumn("teta", (F.col("loc_a") + F.col("assoc_a") + F.col("cls_a")) / 3)
