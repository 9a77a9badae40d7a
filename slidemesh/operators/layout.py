"""Per-slide decisions over component tables: verdict joins, merge groups, overlap arbitration, layers and paint order."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.functions.text import safe_name
from slidemesh.operators.assign import per_key
from slidemesh.operators.pairs import box_pairs
from slidemesh.operators.scan import positions
from slidemesh.runtime import cut

FOLD_EDGES = 2_000

# fixed values: classes whose boxes tend to be loose text
TEXT_PRONE = [
    "bullet list", "bullet point", "bullet point text", "bullet marker", "numbered list", "list", "checklist", "icon list", "outline",
    "body text", "text", "text block", "text box", "text element", "text label", "text character", "text callout",
    "slide title", "title slide", "title text", "heading", "heading text", "section title", "header", "header text", "header/title",
    "header/title text", "header/body text block", "header/footer", "header/label", "caption/label", "label", "label text",
    "label/annotation", "label/header", "label/icon", "callout/label", "annotation", "diagram label", "shape label",
    "component label", "metric annotation", "footer", "page number", "author affiliation", "author affiliation text",
    "author affiliation text block", "author affiliations", "author and affiliation", "author and affiliation text",
    "author and affiliation text block", "author attribution", "author biography", "author block", "author contact",
    "author information", "author names", "author profiles", "author text", "author/affiliation", "author/affiliation text",
    "author/affiliation text block", "author/presenter name", "affiliation list", "affiliation text", "presenter bio",
    "contact information", "citation/reference", "equation", "mathematical notation", "mathematical symbol", "code block",
    "code example", "theorem statement", "definition box", "dialogue", "dialogue/conversation", "speech bubble", "question text",
    "question and answer", "question-answer block", "numeric metric", "numeric text", "numeric value", "metric",
    "metric/statistic", "metric indicator", "performance indicator",
]


# filters -----------------------------------------------------------------------------------------------------------
def score_filter(dets: DataFrame, first: float = 0.3, retry: float = 0.15, scale: float = 1.0) -> DataFrame:
    """Inclusive score threshold; later iterations use the lower one. `scale` maps stored scores to 0..1."""
    return dets.where(F.col("score") >= F.when(F.col("iter_idx") == 0, F.lit(first * scale)).otherwise(F.lit(retry * scale)))


def positive_area(dets: DataFrame) -> DataFrame:
    return dets.where(B.area(B.box()) > 0)


def drop_sparse(dets: DataFrame, slides: DataFrame, min_density: float, min_frac: float = 0.15) -> DataFrame:
    """Drop large boxes whose mask covers too little of them. `dets` has mask_px; `slides` has slide_id, width, height."""
    box_area = B.area(B.box()).cast("double")
    sparse = (box_area >= min_frac * F.col("width") * F.col("height")) & (F.col("mask_px") / box_area < min_density)
    return dets.join(slides.select("slide_id", "width", "height"), "slide_id", "left").where(~F.coalesce(sparse, F.lit(False))).drop("width", "height")


def prune_invalid(comps: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    return comps.join(verdicts.where(~F.col("valid")).select(*keys), keys, "left_anti")


def merge_verdicts(comps: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Components still valid with verdict columns; a missing verdict means valid, not text-only, no transcription."""
    v = verdicts.select(*keys, "valid", F.col("is_text_only").alias("_text"), "ocr_latex", "reason")
    out = comps.drop("is_text_only").join(v, keys, "left").where(F.coalesce("valid", F.lit(True)))
    return out.select(*[c for c in comps.columns if c != "is_text_only"], F.coalesce("_text", F.lit(False)).alias("is_text_only"),
                      F.coalesce("ocr_latex", F.lit("")).alias("ocr_latex"), F.coalesce("reason", F.lit("")).alias("valid_reason"))


def normalise_text_flags(v: DataFrame) -> DataFrame:
    """Transcription and tight/small flags count only for valid text-only components; tight defaults to true."""
    on = F.coalesce(F.col("valid") & F.col("is_text_only"), F.lit(False))
    return v.withColumns({
        "is_text_only": on, "ocr_latex": F.when(on, F.coalesce("ocr_latex", F.lit(""))).otherwise(""),
        "bbox_is_tight": F.when(on, F.coalesce("bbox_is_tight", F.lit(True))).otherwise(True),
        "bbox_is_too_small": F.when(on, F.coalesce("bbox_is_too_small", F.lit(False))).otherwise(False)})


def is_text_prone(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(TEXT_PRONE), F.lit(False))


def drop_absorbed(comps: DataFrame) -> DataFrame:
    """Final view: fine components that went into a merge group disappear."""
    return comps.where(~((F.col("granularity") == "fine") & F.col("merged_into").isNotNull()))


def keep_reviewed_regions(regions: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """A missed region stays unless its review says invalid; no review keeps it, a degenerate box goes."""
    v = verdicts.select(*keys, "valid")
    return regions.where(B.nonempty(B.box())).join(v, keys, "left").where(F.coalesce("valid", F.lit(True))).drop("valid")


def valid_proposals(p: DataFrame) -> DataFrame:
    """Merge proposals with a class, two or more named members and a box of four numbers."""
    names = F.filter("member_filenames", lambda m: F.coalesce(F.trim(m) != "", F.lit(False)))
    nums = F.transform("merged_bbox", lambda v: v.try_cast("double"))
    return (p.withColumns({"member_filenames": names, "merged_bbox": nums})
            .where((F.size("member_filenames") >= 2) & (F.trim("merged_class") != "") & (F.size("merged_bbox") == 4)
                   & F.forall("merged_bbox", lambda v: v.isNotNull())))


def valid_regions(r: DataFrame) -> DataFrame:
    """Missed-region or point proposals: a class and a box (or point) of parsable numbers."""
    nums = F.transform("bbox", lambda v: v.try_cast("double"))
    return r.withColumn("bbox", nums).where((F.trim("class") != "") & F.size("bbox").isin(2, 4) & F.forall("bbox", lambda v: v.isNotNull()))


def chart_exempt(cls: Column) -> Column:
    c = F.lower(F.coalesce(cls, F.lit("")))
    return c.rlike("chart|plot|graph|table") & ~c.rlike("flow|architecture|diagram")


def merge_caps(groups: DataFrame, max_area_frac: float = 1.0, area_min_members: int = 1, max_members: int = 0, after_refine: bool = False) -> DataFrame:
    """Adds `kept` and `rejected_reason`. Needs merged_class, x0..y1, n_members, slide_w, slide_h.

    After refinement only the area cap counts."""
    frac = B.area(B.box()).cast("double") / (F.col("slide_w") * F.col("slide_h")).cast("double")
    too_big = F.lit(max_area_frac < 1.0) & (frac > max_area_frac) & (F.col("n_members") >= area_min_members)
    too_many = F.lit(max_members > 0 and not after_refine) & (F.col("n_members") > max_members)
    bad = ~chart_exempt(F.col("merged_class")) & (too_big | too_many)
    head = "post-refine area_frac=" if after_refine else "area_frac="
    why = F.concat(F.lit(head), F.format_string("%.3f", frac), F.lit(" members="), F.col("n_members").cast("string"))
    return groups.withColumns({"area_frac": frac, "kept": ~bad, "rejected_reason": F.when(bad, why)})


def drop_group_erases(erases: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    return erases.join(judged.where(~F.col("kept")).select(*keys), keys, "left_anti")


# joins -------------------------------------------------------------------------------------------------------------
def resolve_members(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """(slide_id, group_idx, m_idx, filename): a member names a final file, else the first fine detector row (by
    iteration) with that original name; groups with fewer than two resolved members vanish."""
    m = groups.select("slide_id", "group_idx", F.posexplode("member_filenames").alias("m_idx", "member"))
    direct = comps.select("slide_id", F.col("filename").alias("member"), F.col("filename").alias("_direct"))
    first = (comps.where("granularity = 'fine' AND source <> 'layout_review'").groupBy("slide_id", F.col("iter_original_filename").alias("member"))
             .agg(F.min_by("filename", F.struct("iter_idx", "filename")).alias("_first")))
    hit = (m.join(direct, ["slide_id", "member"], "left").join(first, ["slide_id", "member"], "left")
           .withColumn("filename", F.coalesce("_direct", "_first")).where("filename IS NOT NULL")
           .select("slide_id", "group_idx", "m_idx", "filename"))
    enough = hit.groupBy("slide_id", "group_idx").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    return hit.join(enough, ["slide_id", "group_idx"], "left_semi")


def point_to_groups(comps: DataFrame, members: DataFrame) -> DataFrame:
    """Adds merged_into_idx: the last group a component belongs to."""
    last = members.groupBy("slide_id", "filename").agg(F.max("group_idx").alias("merged_into_idx"))
    return comps.join(last, ["slide_id", "filename"], "left")


def all_text_groups(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Groups to transcribe again: every member exists and is text-only."""
    m = members.join(comps.select("slide_id", "filename", "is_text_only"), ["slide_id", "filename"], "left")
    return m.groupBy("slide_id", "group_idx").agg(F.every(F.coalesce("is_text_only", F.lit(False))).alias("ok")).where("ok").drop("ok")


def group_hulls(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Union box per group."""
    m = members.join(comps.select("slide_id", "filename", "x0", "y0", "x1", "y1"), ["slide_id", "filename"])
    return m.groupBy("slide_id", "group_idx").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def needs_mask(comps: DataFrame, keys: list[str], min_overlap: float = 1.0) -> DataFrame:
    """Adds needs_mask: the box is the smaller one of some cross-label overlap."""
    hit = box_pairs(comps.select(*keys, "pos", "label", "area", "x0", "y0", "x1", "y1"), keys,
                    lambda a, b: (a("label") != b("label")) & (a("area") < b("area")) & B.overlaps(B.box("a."), B.box("b."), min_overlap))
    flags = hit.select(*keys, F.col("a.pos").alias("pos")).distinct().withColumn("needs_mask", F.lit(True))
    return comps.join(flags, [*keys, "pos"], "left").fillna(False, ["needs_mask"])


def conflict_layers(probe: DataFrame, wanted: DataFrame, key: str = "slide_id") -> DataFrame:
    """Layer per wanted class (key, label): conflicting classes go to layer 2 unless one layer would be empty.

    Two classes conflict when any of their probe boxes overlap by more than one square pixel."""
    pairs = box_pairs(probe.select(key, "label", "x0", "y0", "x1", "y1"), [key],
                      lambda a, b: (a("label") != b("label")) & (B.inter_area(B.box("a."), B.box("b.")) > 1.0))
    hot = pairs.select(key, F.col("a.label").alias("label")).distinct().withColumn("conflict", F.lit(True))
    w = wanted.join(hot, [key, "label"], "left").fillna(False, ["conflict"])
    both = w.groupBy(key).agg((F.max("conflict") & ~F.min("conflict")).alias("_split"))
    return w.join(both, key).select(key, "label", "conflict", F.when(F.col("_split") & F.col("conflict"), 2).otherwise(1).alias("layer"))


def priority_order(comps: DataFrame, keys: list[str], name: str = "seg_order") -> DataFrame:
    """Segmentation order for cross-label overlaps, smaller box first.

    Every precedence edge agrees with (area, -score, position), so that the heap order of the topological walk is this sort."""
    return positions(comps, keys, ["area", "-score", "pos"], name, start=1)


def overlap_to_arbitrate(comps: DataFrame, min_px: float = 100.0) -> DataFrame:
    """Unordered pairs to ask about, first = smaller filename: (slide_id, first, second, overlap_px)."""
    inter = B.inter_area(B.box("a."), B.box("b."))
    p = box_pairs(comps.select("slide_id", "filename", "x0", "y0", "x1", "y1"), ["slide_id"],
                  lambda a, b: (a("filename") < b("filename")) & (inter >= min_px))
    return p.select("slide_id", F.col("a.filename").alias("first"), F.col("b.filename").alias("second"), inter.alias("overlap_px"))


def _carve_walk(rows: DataFrame, min_px: float) -> DataFrame:
    """Slides of bounded size: the boxes of a slide and the decisions on them, sorted together and walked once."""
    def walk(loses: list, names: list, others: list, pos: list, *geo: list) -> list[tuple]:
        at, box, asked = {}, {}, {}
        for l, n, o, p, *v in zip(loses, names, others, pos, *geo):
            if l:
                asked.setdefault((n, o), l)
            else:
                at.setdefault(n, []).append(p)
                box[p] = tuple(v)
        edges = {(i, j) for (n, o), l in asked.items() for i in at.get(n if l == 1 else o, ()) for j in at.get(o if l == 1 else n, ())}
        moved: dict[int, tuple] = {}
        for i, j in sorted(edges):
            if i not in moved:
                a, b = box[i], moved.get(j, box[j])[:4]
                left = _carve_one(a[:4], b, min_px, a[4], a[5])
                if left is not None:
                    moved[i] = (*left, j, *b)
        return [(i, *m) for i, m in moved.items()]

    sides = [f"{s}{c}" for s in ("", "w") for c in ("x0", "y0", "x1", "y1")]
    return per_key(rows, ["slide_id"], ["loses"], ["loses", "name", "other", "pos", *sides[:4], "w", "h"], walk,
                   ", ".join(["pos long", *[f"{c} double" for c in sides[:4]], "carved_by long", *[f"{c} double" for c in sides[4:]]]))


def _carve_one(a: tuple, b: tuple, min_px: float, w: float = math.inf, h: float = math.inf) -> tuple | None:
    """Bounds of A without B inside a slide of w x h, or None when nothing is cut (small overlap, hole, nothing left, a side under 1 px)."""
    ox0, oy0, ox1, oy1 = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    if ox1 <= ox0 or oy1 <= oy0 or (ox1 - ox0) * (oy1 - oy0) < min_px:
        return None
    open_sides = [ox0 > a[0], oy0 > a[1], ox1 < a[2], oy1 < a[3]]
    if not any(open_sides) or all(open_sides):
        return None
    x0, y0, x1, y1 = a
    if not open_sides[1] and not open_sides[3]:
        if open_sides[0] and (not open_sides[2] or ox0 - x0 >= x1 - ox1):
            x1 = ox0
        else:
            x0 = ox1
    elif not open_sides[0] and not open_sides[2]:
        if open_sides[1] and (not open_sides[3] or oy0 - y0 >= y1 - oy1):
            y1 = oy0
        else:
            y0 = oy1
    if x1 - x0 < 1 or y1 - y0 < 1:
        return None
    if w < math.inf or h < math.inf:
        x0, y0, x1, y1 = (max(0.0, min(m, v)) if m < math.inf else v for m, v in zip((w, h, w, h), (x0, y0, x1, y1)))
    return (x0, y0, x1, y1) if x1 > x0 and y1 > y0 else None


def _carve_rounds(edges: DataFrame, geo: DataFrame, min_px: float) -> DataFrame | None:
    """Slides of any size; None when there is no edge."""
    done, pending = None, cut(edges.select("slide_id", "i").distinct())
    while not pending.isEmpty():
        waiting = edges.where("j < i").join(pending.withColumnRenamed("i", "j"), ["slide_id", "j"], "left_semi").select("slide_id", "i")
        ready = pending.join(waiting, ["slide_id", "i"], "left_anti")
        now = geo
        if done is not None:
            moved = done.where("carved_by IS NOT NULL").select("slide_id", "pos", *[F.col(c).alias(f"n{c}") for c in ("x0", "y0", "x1", "y1")])
            now = geo.join(moved, ["slide_id", "pos"], "left").select("slide_id", "pos", *[F.coalesce(f"n{c}", c).alias(c) for c in ("x0", "y0", "x1", "y1")])
        a = geo.select("slide_id", F.col("pos").alias("i"), F.struct("x0", "y0", "x1", "y1").alias("a"), "w", "h")
        inside = lambda c, m: F.when(F.col(m) < math.inf, F.greatest(F.lit(0.0), F.least(F.col(m), F.col(f"cut.{c}")))).otherwise(F.col(f"cut.{c}"))
        was = geo.select("slide_id", F.col("pos").alias("j"), F.struct("x0", "y0", "x1", "y1").alias("was"))
        b = now.select("slide_id", F.col("pos").alias("j"), F.struct("x0", "y0", "x1", "y1").alias("now"))
        tried = (edges.join(ready, ["slide_id", "i"], "left_semi").join(a, ["slide_id", "i"]).join(was, ["slide_id", "j"]).join(b, ["slide_id", "j"])
                 .withColumn("b", F.when(F.col("j") < F.col("i"), F.col("now")).otherwise(F.col("was")))
                 .where(B.inter_area(B.box("a."), B.box("b.")) >= min_px).withColumn("cut", B.subtract_box(B.box("a."), B.box("b.")))
                 .where(F.col("cut.kind").isin("rect", "split", "poly") & (F.col("cut.x1") - F.col("cut.x0") >= 1) & (F.col("cut.y1") - F.col("cut.y0") >= 1))
                 .withColumn("cut", F.struct(*[inside(c, m).alias(c) for c, m in (("x0", "w"), ("y0", "h"), ("x1", "w"), ("y1", "h"))], *[F.col(f"b.{c}").alias(f"w{c}") for c in ("x0", "y0", "x1", "y1")]))
                 .where("cut.x1 > cut.x0 and cut.y1 > cut.y0"))
        best = tried.groupBy("slide_id", "i").agg(F.min_by("cut", "j").alias("cut"), F.min("j").alias("carved_by"))
        step = ready.join(best, ["slide_id", "i"], "left").select(
            "slide_id", F.col("i").alias("pos"), "carved_by", "cut.x0", "cut.y0", "cut.x1", "cut.y1", "cut.wx0", "cut.wy0", "cut.wx1", "cut.wy1")
        done = cut(step if done is None else step.unionByName(done))
        pending = cut(pending.join(done.select("slide_id", F.col("pos").alias("i")), ["slide_id", "i"], "left_anti"))
    return done


def carve_overlaps(comps: DataFrame, decisions: DataFrame, min_px: float = 100.0, slide_size: tuple[str, str] | None = None) -> DataFrame:
    """Cut the side that does not own an overlap and whose peer does, at most one cut per component.

    `comps`: slide_id, pos, filename, x0..y1. `decisions`: slide_id, first, second, first_owns, second_owns (one row per
    unordered pair). A component's cut sees the cut boxes of the components before it and the original boxes of those after
    it. Slides with few such pairs are walked in sorted batches; larger ones are settled in rounds, a component when all its
    earlier partners are. With `slide_size`, the columns of the slide's width and height, cut boxes are clamped to the slide, and a cut that leaves
    nothing on it is not made. Adds carved_by, vertices and original_bbox: the box before its first cut, kept where `comps` has one already; null for
    uncut components without one. A column tight_bbox is clamped to the cut box, and replaced by it when nothing would be left."""
    corners, size = ("x0", "y0", "x1", "y1"), [F.coalesce(F.col(c).cast("double"), F.lit(math.inf)) for c in slide_size] if slide_size else [F.lit(math.inf)] * 2
    first_loses, second_loses = F.expr("NOT first_owns AND second_owns"), F.expr("NOT second_owns AND first_owns")
    asked = decisions.where((first_loses | second_loses) & F.col("first").isNotNull() & F.col("second").isNotNull()).select(
        "slide_id", F.when(first_loses, 1).otherwise(2).alias("loses"), F.col("first").alias("name"), F.col("second").alias("other"), F.lit(0).cast("long").alias("pos"),
        *[F.lit(0.0).alias(c) for c in (*corners, "w", "h")])
    boxes = comps.select("slide_id", F.lit(0).alias("loses"), F.col("filename").alias("name"), F.lit("").alias("other"), F.col("pos").cast("long").alias("pos"),
                         *[F.col(c).cast("double").alias(c) for c in corners], *[c.alias(n) for c, n in zip(size, "wh")])
    rows = cut(boxes.unionByName(asked))
    per = rows.groupBy("slide_id").agg(F.count_if(F.col("loses") > 0).alias("_e"), F.count(F.lit(1)).alias("_n"))
    large = per.where((F.col("_e") > FOLD_EDGES) | (F.col("_n") > 100 * FOLD_EDGES)).select("slide_id")
    if large.isEmpty():
        done = _carve_walk(rows, min_px)
    else:
        large = cut(large)
        done, hot = _carve_walk(rows.join(large, "slide_id", "left_anti"), min_px), cut(rows.join(large, "slide_id", "left_semi"))
        geo = hot.where("loses = 0").select("slide_id", "name", "pos", *corners, "w", "h")
        d = hot.where("loses > 0").dropDuplicates(["slide_id", "name", "other"])
        swap = F.col("loses") == 2
        lose = d.select("slide_id", F.when(swap, F.col("other")).otherwise(F.col("name")).alias("fa"), F.when(swap, F.col("name")).otherwise(F.col("other")).alias("fb"))
        who = geo.select("slide_id", "name", "pos")
        edges = cut(lose.join(who.withColumnsRenamed({"name": "fa", "pos": "i"}), ["slide_id", "fa"])
                    .join(who.withColumnsRenamed({"name": "fb", "pos": "j"}), ["slide_id", "fb"]).select("slide_id", "i", "j"))
        rounds = _carve_rounds(edges, geo.drop("name"), min_px)
        done = done if rounds is None else done.unionByName(rounds)
    c = done.where("carved_by IS NOT NULL").select("slide_id", "pos", "carved_by", *[F.col(k).alias(f"n{k}") for k in corners], *[f"w{k}" for k in corners])
    is_cut = F.col("carved_by").isNotNull()
    own, new = F.array(*[F.col(k).cast("double") for k in corners]), F.array(*[F.col(f"n{k}") for k in corners])
    before = F.when(is_cut, own).otherwise(F.lit(None))
    original = F.coalesce(F.col("original_bbox"), before) if "original_bbox" in comps.columns else before
    rest = [F.col(k) for k in comps.columns if k not in (*corners, "original_bbox", "tight_bbox")]
    if "tight_bbox" in comps.columns:
        t = F.array(*[f(F.col("tight_bbox")[i].cast("double"), F.col(f"n{k}")) for i, (k, f) in enumerate(zip(corners, (F.greatest, F.greatest, F.least, F.least)))])
        whole = F.size("tight_bbox") == 4
        rest.append(F.when(is_cut & whole, F.when((t[2] > t[0]) & (t[3] > t[1]), t).otherwise(new)).otherwise(F.col("tight_bbox").cast("array<double>")).alias("tight_bbox"))
    # outlines come from the box the winner had at that moment: its own cut when it is earlier, else the original
    outline = F.when(is_cut, B.subtract_box(B.Box(*[F.col(k).cast("double") for k in corners]), B.box("w"))["vertices"])
    return comps.join(c, ["slide_id", "pos"], "left").select(
        *rest, *[F.coalesce(f"n{k}", F.col(k).cast("double")).alias(k) for k in corners], "carved_by", outline.alias("vertices"), original.alias("original_bbox"))


# roll-ups ----------------------------------------------------------------------------------------------------------
def manifest_counters(comps: DataFrame, key: str = "slide_id") -> DataFrame:
    """Counts per slide over the consolidated table (granularity, source, bbox_was_tightened, merged_into)."""
    fine, absorbed = F.col("granularity") == "fine", F.col("merged_into").isNotNull()
    return comps.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_components"), F.count_if(fine).alias("num_fine"),
        F.count_if(F.col("granularity") == "merged").alias("num_merged"), F.count_if(F.col("source") == "layout_review").alias("num_layout_review_missed"),
        F.count_if(F.coalesce("bbox_was_tightened", F.lit(False))).alias("num_bbox_tightened"), F.count_if(~(fine & absorbed)).alias("num_final_components"))


def invalid_components(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Files a review rejects, one row each."""
    return verdicts.where(~F.col("valid")).select(*keys, "pos", "filename")


def transcriptions(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Transcribed text of valid text-only components, one row each."""
    return verdicts.where("valid AND is_text_only AND coalesce(ocr_latex, '') <> ''").select(*keys, "pos", "filename", F.col("ocr_latex").alias("latex"))


def verdict_rollup(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per review: valid, rejected and transcribed components."""
    text = F.col("valid") & F.col("is_text_only") & (F.coalesce("ocr_latex", F.lit("")) != "")
    return verdicts.groupBy(*keys).agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"), F.count_if(text).alias("n_ocr"))


def consolidate(fine: DataFrame, missed: DataFrame, merged: DataFrame, detector: str = "detector") -> DataFrame:
    """One table of fine, missed and merged components; columns one part lacks are NULL. `detector` tags the fine rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        fine.withColumns({"granularity": F.lit("fine"), "source": F.lit(detector)}),
        missed.withColumns({"granularity": F.lit("fine"), "source": F.lit("layout_review")}),
        merged.withColumns({"granularity": F.lit("merged"), "source": F.lit("merge_group")})])


def unite_layers(layers: DataFrame, counters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layer outputs with new running file numbers per slide, and counters summed over layers."""
    numbered = positions(layers, ["slide_id"], ["seg_layer", "pos"], "n", start=1)
    out = numbered.withColumn("component_file", F.concat(F.lit("components/component_"), F.lpad(F.col("n").cast("string"), 4, "0"), F.lit("_"),
                                                         safe_name(F.col("label"), "unknown"), F.lit(".png")))
    sums = [c for c, t in counters.dtypes if c not in ("slide_id", "seg_layer")]
    return out, counters.groupBy("slide_id").agg(*[F.sum(c).alias(c) for c in sums])


def placements(comps: DataFrame, routes: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Paint plan: routes joined to boxes and available artefacts, ordered by layer; skipped rows keep their reason.

    `routes`: page, component_file, cls, pos. `artefacts`: component_file, source ('step4', 'step3', 'image')."""
    from slidemesh.functions.routing import layer_of
    have = artefacts.groupBy("page", "component_file").agg(F.collect_set("source").alias("_src"))
    j = routes.join(comps.select("page", "component_file", "x0", "y0", "x1", "y1"), ["page", "component_file"], "left").join(have, ["page", "component_file"], "left")
    def has(s):
        return F.coalesce(F.array_contains("_src", s), F.lit(False))
    cls = F.col("cls")
    source = (F.when(cls.isin(1, 3, 4), F.when(has("step4"), "step4").when(has("step3"), "step3"))
              .when(cls == 2, F.when(has("step3"), "step3")).when(cls == 5, F.when(has("image"), "image")))
    skip = (F.when(F.col("x0").isNull(), "not in metadata").when(cls == 0, "decorative")
            .when(~F.coalesce(cls.between(0, 5), F.lit(False)), "unsupported").when(source.isNull(), "no artefact"))
    plan = j.withColumns({"layer": layer_of(cls), "source": F.when(skip.isNull(), source), "skip_reason": skip}).drop("_src")
    return positions(plan, ["page"], ["layer", "pos"], "paint_order")
