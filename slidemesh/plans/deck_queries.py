"""Queries over component tables: geometry, edges, suppression, ordering, layout decisions, class sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.operators import classes as C
from slidemesh.operators import graph as G
from slidemesh.operators import layout as L
from slidemesh.operators import suppress as S
from slidemesh.operators.pairs import box_pairs
from slidemesh.operators.scan import positions, top_n
from slidemesh.plans import views as V
from slidemesh.plans.registry import A_AREA, B_AREA, HIT, INTER, IOU, query, sql
from slidemesh.runtime import cut

SLIDE_W, SLIDE_H = 1000, 600
K = ["slide_id"]


# graph --------------------------------------------------------------------------------------------------------------
_CONTAINS = f"""SELECT a.slide_id, a.node_id AS src, b.node_id AS dst FROM components a JOIN components b ON a.slide_id = b.slide_id
WHERE a.area > b.area AND {HIT} AND {INTER} / CAST(b.area AS DOUBLE) >= CAST(0.9 AS DOUBLE)"""
_ABOVE = f"""SELECT a.slide_id, a.node_id AS src, b.node_id AS dst FROM components a JOIN components b ON a.slide_id = b.slide_id
WHERE a.z_index > b.z_index AND {HIT}"""
_READS = """SELECT slide_id, src, dst FROM (SELECT slide_id, node_id AS src, lead(node_id) OVER (PARTITION BY slide_id ORDER BY y0, x0, pos) AS dst
FROM components) t WHERE dst IS NOT NULL"""


@query("edges_contains", sql(_CONTAINS, "components"))
def edges_contains(spark, sf):
    return G.overlap_edges(V.components(spark, sf)).where("kind = 'contains'").select("slide_id", "src", "dst")


@query("edges_above", sql(_ABOVE, "components"))
def edges_above(spark, sf):
    return G.overlap_edges(V.components(spark, sf)).where("kind = 'above'").select("slide_id", "src", "dst")


@query("reading_order", sql(_READS, "components"))
def reading_order(spark, sf):
    return G.reading_order(V.components(spark, sf)).select("slide_id", "src", "dst")


@query("graph_summary", sql(f"""SELECT slide_id, CAST(sum(components) AS BIGINT) AS components, CAST(sum(contains) AS BIGINT) AS contains,
CAST(sum(reads_before) AS BIGINT) AS reads_before, CAST(sum(above) AS BIGINT) AS above, CAST(0 AS BIGINT) AS merged_with, CAST(0 AS BIGINT) AS binds FROM (
  SELECT c.slide_id, c.n AS components, coalesce(x.n, 0) AS contains, coalesce(r.n, 0) AS reads_before, coalesce(v.n, 0) AS above
  FROM (SELECT slide_id, count(*) AS n FROM components GROUP BY 1) c
  LEFT JOIN (SELECT slide_id, count(*) AS n FROM ({_CONTAINS}) GROUP BY 1) x ON x.slide_id = c.slide_id
  LEFT JOIN (SELECT slide_id, count(*) AS n FROM ({_READS}) GROUP BY 1) r ON r.slide_id = c.slide_id
  LEFT JOIN (SELECT slide_id, count(*) AS n FROM ({_ABOVE}) GROUP BY 1) v ON v.slide_id = c.slide_id) t GROUP BY ROLLUP (slide_id)""", "components"))
def graph_summary(spark, sf):
    c = V.components(spark, sf)
    return G.summary(c, G.derive_edges(c))


@query("bind_iou", sql(f"""SELECT a.slide_id, a.node_id AS src, concat(cast(b.slide_id AS VARCHAR), '/o', cast(b.pos AS VARCHAR)) AS dst, round_even({IOU}, 3) AS weight
FROM components a JOIN native_objects b ON a.slide_id = b.slide_id WHERE {HIT} AND {IOU} >= CAST(0.5 AS DOUBLE)""", "components", "native_objects"))
def bind_iou(spark, sf):
    c = V.components(spark, sf)
    o = V.native_objects(c).withColumn("object_id", F.concat(F.col("slide_id").cast("string"), F.lit("/o"), F.col("pos").cast("string")))
    return G.bind_objects(c, o).select("slide_id", "src", "dst", "weight")


@query("merged_with_edges", sql("""SELECT m.slide_id, m.node_id AS src, c.node_id AS dst FROM components m JOIN components c ON m.slide_id = c.slide_id
WHERE m.pos = 0 AND c.pos IN (1, 2)""", "components"))
def merged_with_edges(spark, sf):
    c = V.components(spark, sf).withColumn("filename", F.concat(F.lit("f"), F.col("pos")))
    c = c.withColumn("merged_from", F.when(F.col("pos") == 0, F.array(F.lit("f1"), F.lit("f2"))))
    return G.merged_edges(c).select("slide_id", "src", "dst")


# geometry -----------------------------------------------------------------------------------------------------------
@query("box_measures", sql("""SELECT slide_id, pos, (x1 - x0) * (y1 - y0) AS box_area, CAST(x0 + x1 AS DOUBLE) / 2 AS cx, CAST(y0 + y1 AS DOUBLE) / 2 AS cy, x1 - x0 AS w, y1 - y0 AS h,
CAST(least(greatest(x0, 0), 499) AS DOUBLE) AS clamp_x0, CAST(greatest(least(greatest(x0, 0), 499) + 1, least(x1, 500)) AS DOUBLE) AS clamp_x1,
least(greatest(x1, 0), 500) AS clip_x1, x0 >= 0 AND y0 >= 0 AND x1 < 500 AND y1 < 300 AS inside, x1 - x0 > 100 AND y1 - y0 > 100 AS nonempty100,
CAST(x0 AS DOUBLE) / 1000 AS norm_x0, CAST(y1 AS DOUBLE) / 600 AS norm_y1, x0 * 9525 AS emu_x0, 200 - x0 AS dist_left, y1 - 100 AS dist_bottom
FROM components""", "components"))
def box_measures(spark, sf):
    b = B.box()
    w, h = F.lit(500).cast("long"), F.lit(300).cast("long")
    cl, cp, nm = B.clamp_to_image(b, w, h), B.clip(b, w, h), B.normalise(b, F.lit(SLIDE_W), F.lit(SLIDE_H))
    cx, cy = B.centre(b)
    dist = B.point_distance(F.lit(200).cast("long"), F.lit(100).cast("long"), b)
    return V.components(spark, sf).select(
        "slide_id", "pos", B.area(b).alias("box_area"), cx.alias("cx"), cy.alias("cy"), B.width(b).alias("w"), B.height(b).alias("h"),
        cl.x0.alias("clamp_x0"), cl.x1.alias("clamp_x1"), cp.x1.alias("clip_x1"), B.inside(b, w, h).alias("inside"), B.nonempty(b, 100).alias("nonempty100"),
        nm.x0.alias("norm_x0"), nm.y1.alias("norm_y1"), B.px_to_emu(b.x0).alias("emu_x0"), dist[0].alias("dist_left"), dist[3].alias("dist_bottom"))


_NEXT = """nxt AS (SELECT a.*, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM components a JOIN components b ON a.slide_id = b.slide_id AND b.pos = a.pos + 1),
m AS (SELECT slide_id, pos, (x1 - x0) * (y1 - y0) AS aa, (bx1 - bx0) * (by1 - by0) AS ba,
  greatest(0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0, least(y1, by1) - greatest(y0, by0)) AS inter,
  (greatest(x1, bx1) - least(x0, bx0)) * (greatest(y1, by1) - least(y0, by0)) AS hull FROM nxt)"""


@query("pair_measures", sql("""SELECT slide_id, pos, inter, aa + ba - inter AS uni, round(inter / CAST(aa + ba - inter AS DOUBLE), 9) AS iou,
round(inter / CAST(ba AS DOUBLE), 9) AS ioa_second, round(inter / CAST(aa AS DOUBLE), 9) AS ioa_first, round(inter / CAST(least(aa, ba) AS DOUBLE), 9) AS iom,
round(inter / CAST(aa + ba - inter AS DOUBLE) - (hull - (aa + ba - inter)) / CAST(hull AS DOUBLE), 9) AS giou, hull AS hull_area FROM m""", "components", extra=_NEXT))
def pair_measures(spark, sf):
    c = V.components(spark, sf)
    nxt = c.select("slide_id", (F.col("pos") - 1).alias("pos"), *[F.col(k).alias(f"b{k}") for k in ("x0", "y0", "x1", "y1")])
    a, b = B.box(), B.box("b")
    return c.join(nxt, ["slide_id", "pos"]).select(
        "slide_id", "pos", B.inter_area(a, b).alias("inter"), B.union_area(a, b).alias("uni"), F.round(B.iou(a, b), 9).alias("iou"),
        F.round(B.ioa_second(a, b), 9).alias("ioa_second"), F.round(B.ioa_first(a, b), 9).alias("ioa_first"), F.round(B.iom(a, b), 9).alias("iom"),
        F.round(B.giou(a, b), 9).alias("giou"), B.area(B.hull(a, b)).alias("hull_area"))


@query("rotated_hull", sql("""SELECT slide_id, pos, round((x0 + x1) / 2.0 - (abs(cos(radians(score % 360))) * (x1 - x0) + abs(sin(radians(score % 360))) * (y1 - y0)) / 2, 6) AS rx0,
round((y0 + y1) / 2.0 + (abs(sin(radians(score % 360))) * (x1 - x0) + abs(cos(radians(score % 360))) * (y1 - y0)) / 2, 6) AS ry1 FROM components""", "components"))
def rotated_hull(spark, sf):
    b = B.box()
    cx, cy, w, h = B.xyxy_to_cxcywh(b)
    r = B.rotated_hull(cx, cy, w, h, F.col("score") % 360)
    return V.components(spark, sf).select("slide_id", "pos", F.round(r.x0, 6).alias("rx0"), F.round(r.y1, 6).alias("ry1"))


@query("extend_boxes", sql("""SELECT slide_id, pos, CASE WHEN sl + sr <= 0 THEN x0 ELSE x0 - al - ml END AS ex0, CASE WHEN sl + sr <= 0 THEN x1 ELSE x1 + ar + least(rem - ml, sr - ar) END AS ex1
FROM (SELECT *, least(rem, sl - al) AS ml FROM (SELECT *, 120 - al - ar AS rem FROM (SELECT slide_id, pos, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1,
  CAST(greatest(0, x0) AS DOUBLE) AS sl, CAST(greatest(0, 600 - x1) AS DOUBLE) AS sr, CAST(least(60, greatest(0, x0)) AS DOUBLE) AS al, CAST(least(60, greatest(0, 600 - x1)) AS DOUBLE) AS ar FROM components) a) b) c""", "components"))
def extend_boxes(spark, sf):
    e = B.extend_horizontally(B.box(), F.lit(120.0), F.lit(600))
    return V.components(spark, sf).select("slide_id", "pos", e.x0.alias("ex0"), e.x1.alias("ex1"))


@query("box_difference", sql("""SELECT slide_id, pos, kind, CASE WHEN kind IN ('none', 'empty', 'hole') THEN NULL ELSE aa - ii END AS left_area FROM (
SELECT *, CASE WHEN ii = 0 THEN 'none' WHEN n = 4 THEN 'empty' WHEN n = 0 THEN 'hole' WHEN n = 3 THEN 'rect' WHEN n = 2 AND ((l = 1 AND r = 1) OR (t = 1 AND m = 1)) THEN 'split' ELSE 'poly' END AS kind FROM (
SELECT *, l + r + t + m AS n FROM (SELECT slide_id, pos, (x1 - x0) * (y1 - y0) AS aa, greatest(0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0, least(y1, by1) - greatest(y0, by0)) AS ii,
 (bx0 <= x0)::INT AS l, (bx1 >= x1)::INT AS r, (by0 <= y0)::INT AS t, (by1 >= y1)::INT AS m FROM nxt) q) p) o WHERE kind <> 'split'""", "components", extra=_NEXT))
def box_difference(spark, sf):
    """Area left after cutting the next box out; for cut corners and notches the outline's shoelace area is used."""
    c = V.components(spark, sf)
    nxt = c.select("slide_id", (F.col("pos") - 1).alias("pos"), *[F.col(k).alias(f"b{k}") for k in ("x0", "y0", "x1", "y1")])
    d = c.join(nxt, ["slide_id", "pos"]).withColumn("d", B.subtract_box(B.box(), B.box("b")))
    left = F.when(F.col("d.kind") == "poly", B.polygon_area(F.col("d.vertices"))).when(F.col("d.kind") == "rect", B.area(B.box("d.")))
    return d.where("d.kind <> 'split'").select("slide_id", "pos", F.col("d.kind").alias("kind"), left.cast("long").alias("left_area"))


_CROP = """tx AS (SELECT * FROM components WHERE is_text_only),
seq AS (SELECT c.slide_id, c.pos, t.x0 AS tx0, t.y0 AS ty0, t.x1 AS tx1, t.y1 AS ty1, row_number() OVER (PARTITION BY c.slide_id, c.pos ORDER BY t.pos) AS k FROM components c JOIN tx t ON t.slide_id = c.slide_id AND t.pos <> c.pos),
walk AS (SELECT slide_id, pos, CAST(0 AS BIGINT) AS k, x1 - x0 AS ow, y1 - y0 AS oh, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM components WHERE slide_id IN (SELECT slide_id FROM tx) UNION ALL
 SELECT slide_id, pos, k, ow, oh, CASE WHEN side = 'l' THEN ix1 ELSE x0 END, CASE WHEN side = 't' THEN iy1 ELSE y0 END, CASE WHEN side = 'r' THEN ix0 ELSE x1 END, CASE WHEN side = 'b' THEN iy0 ELSE y1 END FROM (
  SELECT *, CASE WHEN ix1 <= ix0 OR iy1 <= iy0 THEN '' WHEN iy0 <= y0 + 1 AND iy1 - y0 <= 0.3::DOUBLE * oh THEN 't' WHEN iy1 >= y1 - 1 AND y1 - iy0 <= 0.3::DOUBLE * oh THEN 'b'
   WHEN ix0 <= x0 + 1 AND ix1 - x0 <= 0.3::DOUBLE * ow THEN 'l' WHEN ix1 >= x1 - 1 AND x1 - ix0 <= 0.3::DOUBLE * ow THEN 'r' ELSE '' END AS side FROM (
   SELECT w.slide_id, w.pos, e.k, ow, oh, x0, y0, x1, y1, greatest(x0, tx0) AS ix0, greatest(y0, ty0) AS iy0, least(x1, tx1) AS ix1, least(y1, ty1) AS iy1 FROM walk w JOIN seq e ON e.slide_id = w.slide_id AND e.pos = w.pos AND e.k = w.k + 1) q) p),
fin AS (SELECT slide_id, pos, ow, oh, arg_max({'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}, k) AS o FROM walk GROUP BY ALL)"""


@query("crop_strips", sql("""SELECT c.slide_id, c.pos, CASE WHEN bad THEN c.x0 ELSE o.x0 END AS x0, CASE WHEN bad THEN c.y0 ELSE o.y0 END AS y0, CASE WHEN bad THEN c.x1 ELSE o.x1 END AS x1, CASE WHEN bad THEN c.y1 ELSE o.y1 END AS y1 FROM (
 SELECT *, ow <= 1 OR oh <= 1 OR o.x1 - o.x0 < 0.4::DOUBLE * ow OR o.y1 - o.y0 < 0.4::DOUBLE * oh AS bad FROM fin) f JOIN components c ON c.slide_id = f.slide_id AND c.pos = f.pos""", "components", extra=_CROP, recursive=True))
def crop_strips(spark, sf):
    """The other text boxes of a slide push in the edges of each of its boxes."""
    c = V.components(spark, sf)
    text = c.where("is_text_only").groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x0", "y0", "x1", "y1"))).alias("t"))
    d = c.join(text, "slide_id").withColumn("t", F.filter("t", lambda t: t["pos"] != F.col("pos"))).withColumn("o", B.crop_edge_strips(B.box(), F.col("t")))
    return d.select("slide_id", "pos", "o.x0", "o.y0", "o.x1", "o.y1")


@query("fit_boxes", sql("""SELECT slide_id, pos, round(least((x1 - x0) / 400.0, (y1 - y0) / 300.0), 9) AS fit, round(greatest((x1 - x0) / 400.0, (y1 - y0) / 300.0), 9) AS fill,
greatest(CAST(x1 - x0 AS DOUBLE) / (y1 - y0) / (400.0 / 300), (400.0 / 300) / (CAST(x1 - x0 AS DOUBLE) / (y1 - y0))) > 1.5 AS letterbox FROM components""", "components"))
def fit_boxes(spark, sf):
    d = V.components(spark, sf).withColumn("f", B.fit_geometry(B.box(), F.lit(400), F.lit(300)))
    return d.select("slide_id", "pos", F.round("f.fit", 9).alias("fit"), F.round("f.fill", 9).alias("fill"), F.col("f.letterbox").alias("letterbox"))


# suppression --------------------------------------------------------------------------------------------------------
@query("same_label_conflicts", sql(f"""SELECT a.slide_id, a.pos AS pos_a, b.pos AS pos_b, {INTER} AS inter FROM components a JOIN components b
ON a.slide_id = b.slide_id AND a.label = b.label AND a.pos < b.pos WHERE {HIT}""", "components"))
def same_label_conflicts(spark, sf):
    p = box_pairs(V.components(spark, sf).select("slide_id", "label", "pos", "x0", "y0", "x1", "y1"), ["slide_id", "label"], lambda a, b: a("pos") < b("pos"))
    return p.select("slide_id", F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), B.inter_area(B.box("a."), B.box("b.")).alias("inter"))


@query("cross_label_pairs", sql(f"""SELECT a.slide_id, a.pos AS pos_a, b.pos AS pos_b, {INTER} AS inter FROM components a JOIN components b
ON a.slide_id = b.slide_id AND a.label <> b.label AND a.pos < b.pos WHERE {HIT} AND {INTER} >= 100""", "components"))
def cross_label_pairs(spark, sf):
    inter = B.inter_area(B.box("a."), B.box("b."))
    p = box_pairs(V.components(spark, sf).select("slide_id", "label", "pos", "x0", "y0", "x1", "y1"), K, lambda a, b: (a("pos") < b("pos")) & (a("label") != b("label")) & (inter >= 100))
    return p.select("slide_id", F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), inter.alias("inter"))


def _greedy_sql(rank: str, conflict: str, key: str = "slide_id", src: str = "components", tail: str = "SELECT slide_id, pos FROM kept", by: str = "slide_id") -> str:
    """Sequential keep-loop as a recursive walk: one step per rank, kept boxes in a list."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {rank}) AS rk FROM {src}),
walk AS (SELECT {by}, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept_pos FROM ranked WHERE rk = 1
 UNION ALL
 SELECT w.{by.split(',')[0].strip()}{''.join(', w.' + c.strip() for c in by.split(',')[1:])}, b.rk,
   CASE WHEN EXISTS (SELECT 1 FROM ranked a WHERE {' AND '.join(f'a.{c.strip()} = b.{c.strip()}' for c in by.split(','))} AND a.rk < b.rk AND list_contains(w.kept_pos, a.pos) AND {conflict})
        THEN w.kept_pos ELSE list_append(w.kept_pos, b.pos) END
 FROM walk w JOIN ranked b ON {' AND '.join(f'b.{c.strip()} = w.{c.strip()}' for c in by.split(','))} AND b.rk = w.rk + 1),
kept AS (SELECT {by}, unnest(kept_pos) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY rk DESC) AS z FROM walk) q WHERE z = 1)"""


@query("same_label_kept", sql("SELECT k.slide_id, k.pos FROM kept k JOIN ranked r ON r.slide_id = k.slide_id AND r.pos = k.pos QUALIFY row_number() OVER (PARTITION BY k.slide_id, k.label ORDER BY r.rk) <= 5",
                              "components", extra=_greedy_sql("area DESC, score DESC, pos", HIT, by="slide_id, label"), recursive=True))
def same_label_kept(spark, sf):
    return S.same_label_filter(V.components(spark, sf), K).select("slide_id", "pos")


def _drop_sql(pairs: str) -> str:
    """Conflicts (slide_id, i, j, w, l) taken in order of (i, j): where both sides are still there, l goes."""
    return f"""conf AS ({pairs}),
pr AS (SELECT slide_id, w, l, row_number() OVER (PARTITION BY slide_id ORDER BY i, j) AS k FROM conf),
walk AS (SELECT DISTINCT slide_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone FROM pr UNION ALL
 SELECT p.slide_id, p.k, CASE WHEN list_contains(gone, p.w) OR list_contains(gone, p.l) THEN gone ELSE list_append(gone, p.l) END FROM walk v JOIN pr p ON p.slide_id = v.slide_id AND p.k = v.k + 1),
fin AS (SELECT slide_id, arg_max(gone, k) AS gone FROM walk GROUP BY 1)"""


_LEFT = "SELECT c.slide_id, c.pos FROM components c LEFT JOIN fin f ON f.slide_id = c.slide_id WHERE NOT coalesce(list_contains(f.gone, c.pos), FALSE)"
_A_FIRST = "CASE WHEN a.score <> b.score THEN a.score > b.score WHEN a.area <> b.area THEN a.area > b.area ELSE a.label < b.label END"


@query("near_duplicates_kept", sql(_LEFT, "components", recursive=True, extra=_drop_sql(f"""SELECT a.slide_id, a.pos AS i, b.pos AS j, CASE WHEN {_A_FIRST} THEN a.pos ELSE b.pos END AS w, CASE WHEN {_A_FIRST} THEN b.pos ELSE a.pos END AS l
 FROM components a JOIN components b ON a.slide_id = b.slide_id AND a.pos < b.pos AND a.label <> b.label WHERE {HIT} AND {INTER} >= 1 AND {INTER} / CAST(least(a.area, b.area) AS DOUBLE) >= CAST(0.6 AS DOUBLE)""")))
def near_duplicates_kept(spark, sf):
    return S.near_duplicate_filter(V.components(spark, sf), K, ratio=0.6).select("slide_id", "pos")


@query("part_of_kept", sql(_LEFT, "components", recursive=True, extra=_drop_sql(f"""SELECT a.slide_id, least(a.pos, b.pos) AS i, greatest(a.pos, b.pos) AS j, b.pos AS w, a.pos AS l
 FROM components a JOIN components b ON a.slide_id = b.slide_id AND a.area < b.area AND a.label <> b.label WHERE {HIT} AND {INTER} >= 1 AND {INTER} / CAST(a.area AS DOUBLE) >= CAST(0.3 AS DOUBLE) AND (a.pos + b.pos) % 3 = 0""")))
def part_of_kept(spark, sf):
    c = V.components(spark, sf)
    cand = S.part_of_candidates(c, K).withColumn("is_part_of", (F.col("small") + F.col("large")) % 3 == 0)
    return S.part_of_filter(c, cand, K).select("slide_id", "pos")


@query("part_of_candidates", sql(f"""SELECT a.slide_id, a.pos AS small, b.pos AS large, round({INTER} / CAST(a.area AS DOUBLE), 9) AS overlap_ratio
FROM components a JOIN components b ON a.slide_id = b.slide_id AND a.label <> b.label AND a.area < b.area WHERE {HIT} AND {INTER} / CAST(a.area AS DOUBLE) >= CAST(0.3 AS DOUBLE)""", "components"))
def part_of_candidates(spark, sf):
    return S.part_of_candidates(V.components(spark, sf), K).withColumn("overlap_ratio", F.round("overlap_ratio", 9))


@query("iteration_dedup", sql("SELECT slide_id, pos FROM kept", "components",
                              extra=_greedy_sql("iter_idx, pos", f"a.label = b.label AND {HIT} AND {INTER} / CAST(b.area AS DOUBLE) >= CAST(0.5 AS DOUBLE) AND b.slide_id IN (SELECT slide_id FROM components GROUP BY 1 HAVING count(DISTINCT iter_idx) > 1)"), recursive=True))
def iteration_dedup(spark, sf):
    return S.cross_iteration_dedup(V.components(spark, sf), K).select("slide_id", "pos")


@query("frame_nms", sql("SELECT slide_id, pos FROM kept", "components", extra=_greedy_sql("score DESC, pos", f"{HIT} AND {IOU} >= CAST(0.5 AS DOUBLE)"), recursive=True))
def frame_nms(spark, sf):
    return S.frame_nms(V.components(spark, sf), K, 0.5).select("slide_id", "pos")


@query("generic_nms", sql("SELECT slide_id, pos FROM kept", "components", extra="cand AS (SELECT * FROM components WHERE score > 2000),\n" +
                          _greedy_sql("score DESC, pos", f"{HIT} AND {IOU} > CAST(0.4 AS DOUBLE)", src="cand"), recursive=True))
def generic_nms(spark, sf):
    return S.generic_nms(V.components(spark, sf), K, 0.4, min_score=2000).select("slide_id", "pos")


@query("overlap_removal", sql("SELECT slide_id, pos FROM kept", "components",
                              extra=_greedy_sql("score DESC, pos", f"{HIT} AND {INTER} / CAST(least(a.area, b.area) AS DOUBLE) > CAST(0.3 AS DOUBLE)"), recursive=True))
def overlap_removal(spark, sf):
    return S.iom_removal(V.components(spark, sf), K, 0.3).select("slide_id", "pos")


@query("recent_occlusion", sql(f"""SELECT DISTINCT a.slide_id, a.pos FROM components a JOIN components b ON a.slide_id = b.slide_id AND a.pos <> b.pos
WHERE {HIT} AND {IOU} >= CAST(0.4 AS DOUBLE) AND a.z_index - 1 > b.z_index - 1 AND b.z_index - 1 > -1""", "components"))
def recent_occlusion(spark, sf):
    c = V.components(spark, sf).withColumn("last_occluded", F.col("z_index") - 1)
    return S.recent_occlusion_losers(c, K, 0.4)


# ordering -----------------------------------------------------------------------------------------------------------
@query("segmentation_order", sql("SELECT slide_id, pos, row_number() OVER (PARTITION BY slide_id ORDER BY area, score DESC, pos) AS seg_order FROM components", "components"))
def segmentation_order(spark, sf):
    return L.priority_order(V.components(spark, sf), K).select("slide_id", "pos", "seg_order")


@query("topk_per_image", sql("SELECT image_id, dt_id, score FROM dt QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, dt_id) <= 3", "components", "dt"))
def topk_per_image(spark, sf):
    return top_n(V.detections(V.components(spark, sf)), ["image_id"], ["-score", "dt_id"], 3).select("image_id", "dt_id", "score")


@query("page_roles", sql("SELECT slide_id, pos, CASE WHEN pos = 0 THEN 'opening' WHEN pos = count(*) OVER (PARTITION BY slide_id) - 1 THEN 'closing' ELSE 'content' END AS role FROM components", "components"))
def page_roles(spark, sf):
    from slidemesh.functions.routing import page_role
    c = V.components(spark, sf).select("slide_id", "pos")
    n = c.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, "slide_id").select("slide_id", "pos", page_role(F.col("pos"), F.col("n")).alias("role"))


# layout -------------------------------------------------------------------------------------------------------------
@query("score_threshold", sql("SELECT slide_id, pos FROM components WHERE area > 0 AND score >= CASE WHEN iter_idx = 0 THEN 3000 ELSE 1500 END", "components"))
def score_threshold(spark, sf):
    return L.positive_area(L.score_filter(V.components(spark, sf), scale=10000)).select("slide_id", "pos")


@query("sparse_dropped", sql("""SELECT slide_id, pos FROM components WHERE NOT (area >= 0.15 * 1000 * 600 AND (area * (score % 100) // 100) / CAST(area AS DOUBLE) < CAST(0.25 AS DOUBLE))""", "components"))
def sparse_dropped(spark, sf):
    c = V.components(spark, sf).withColumn("mask_px", F.expr("area * (score % 100) div 100"))
    slides = c.select("slide_id").distinct().withColumns({"width": F.lit(SLIDE_W), "height": F.lit(SLIDE_H)})
    return L.drop_sparse(c, slides, 0.25).select("slide_id", "pos")


_GROUPS = """grp AS (SELECT slide_id, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, bool_and(is_text_only) AS all_text,
 (['line chart', 'flow chart', 'photo', 'table', 'diagram'])[slide_id % 5 + 1] AS cls FROM components GROUP BY slide_id HAVING count(*) >= 2)"""


def _verdicts(c):
    """A verdict for two of three components; every eleventh of those is invalid."""
    return c.where("pos % 3 <> 2").selectExpr("slide_id", "pos", "(slide_id + pos) % 11 <> 0 AS valid", "pos % 2 = 0 AS is_text_only",
                                              "concat('t', cast(pos AS string)) AS ocr_latex", "cast(null AS string) AS reason")


@query("verdict_merge", sql("""SELECT slide_id, pos, CASE WHEN pos % 3 = 2 THEN false ELSE pos % 2 = 0 END AS is_text_only, CASE WHEN pos % 3 = 2 THEN '' ELSE concat('t', cast(pos AS VARCHAR)) END AS ocr_latex
FROM components WHERE pos % 3 = 2 OR (slide_id + pos) % 11 <> 0""", "components"))
def verdict_merge(spark, sf):
    c = V.components(spark, sf)
    return L.merge_verdicts(c, _verdicts(c), ["slide_id", "pos"]).select("slide_id", "pos", "is_text_only", "ocr_latex")


@query("prune_invalid", sql("SELECT slide_id, pos FROM components WHERE NOT (pos % 3 <> 2 AND (slide_id + pos) % 11 = 0)", "components"))
def prune_invalid(spark, sf):
    c = V.components(spark, sf)
    return L.prune_invalid(c, _verdicts(c), ["slide_id", "pos"]).select("slide_id", "pos")


@query("verdict_rollup", sql("""SELECT slide_id, count(*) FILTER ((slide_id + pos) % 11 <> 0) AS n_valid, count(*) FILTER ((slide_id + pos) % 11 = 0) AS n_invalid,
count(*) FILTER ((slide_id + pos) % 11 <> 0 AND pos % 2 = 0) AS n_ocr FROM components WHERE pos % 3 <> 2 GROUP BY slide_id""", "components"))
def verdict_rollup(spark, sf):
    c = V.components(spark, sf)
    return L.verdict_rollup(_verdicts(c), K)


@query("rejected_and_transcribed", sql("""SELECT slide_id, pos, concat('f', cast(pos AS VARCHAR)) AS filename, CASE WHEN (slide_id + pos) % 11 <> 0 THEN concat('t', cast(pos AS VARCHAR)) END AS latex
FROM components WHERE pos % 3 <> 2 AND ((slide_id + pos) % 11 = 0 OR pos % 2 = 0)""", "components"))
def rejected_and_transcribed(spark, sf):
    v = _verdicts(V.components(spark, sf)).withColumn("filename", F.concat(F.lit("f"), F.col("pos")))
    return L.invalid_components(v, K).withColumn("latex", F.lit(None).cast("string")).unionByName(L.transcriptions(v, K))


@query("consolidated_components", sql("""SELECT granularity, source, count(*) AS n, count(merged_from) AS with_members FROM (
 SELECT 'fine' AS granularity, 'detector' AS source, NULL AS merged_from FROM components WHERE pos > 0 UNION ALL SELECT 'fine', 'layout_review', NULL FROM components WHERE pos = 0 AND score % 2 = 0
 UNION ALL SELECT 'merged', 'merge_group', 'x' FROM grp) t GROUP BY 1, 2""", "components", extra=_GROUPS))
def consolidated_components(spark, sf):
    c = V.components(spark, sf)
    missed = c.where("pos = 0 AND score % 2 = 0").select("slide_id", "x0", "y0", "x1", "y1")
    merged = _groups(c).select("slide_id", "x0", "y0", "x1", "y1", F.col("member_filenames").alias("merged_from"))
    return L.consolidate(c.where("pos > 0"), missed, merged).groupBy("granularity", "source").agg(F.count(F.lit(1)).alias("n"), F.count("merged_from").alias("with_members"))


def _groups(c):
    """One proposed merge group per slide of two or more components: all its boxes."""
    m = c.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("f"), F.col("pos")))).alias("member_filenames"),
                                                   F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return m.where("size(member_filenames) >= 2").withColumns({
        "group_idx": F.lit(0), "n_members": F.size("member_filenames"), "slide_w": F.lit(SLIDE_W), "slide_h": F.lit(SLIDE_H),
        "merged_class": F.expr("element_at(array('line chart', 'flow chart', 'photo', 'table', 'diagram'), cast(slide_id % 5 + 1 AS int))")})





@query("merge_caps", sql("""SELECT slide_id, CAST(n AS INTEGER) AS n_members, round((x1 - x0) * (y1 - y0) / CAST(600000 AS DOUBLE), 9) AS area_frac,
 cls IN ('line chart', 'table') OR NOT (((x1 - x0) * (y1 - y0) / CAST(600000 AS DOUBLE) > CAST(0.5 AS DOUBLE) AND n >= 3) OR n > 4) AS kept FROM grp""", "components", extra=_GROUPS))
def merge_caps(spark, sf):
    g = L.merge_caps(_groups(V.components(spark, sf)), 0.5, 3, 4)
    return g.select("slide_id", "n_members", F.round("area_frac", 9).alias("area_frac"), "kept")


@query("merge_caps_refined", sql("""SELECT slide_id, cls IN ('line chart', 'table') OR NOT ((x1 - x0) * (y1 - y0) / CAST(600000 AS DOUBLE) > CAST(0.5 AS DOUBLE) AND n >= 3) AS kept FROM grp""", "components", extra=_GROUPS))
def merge_caps_refined(spark, sf):
    return L.merge_caps(_groups(V.components(spark, sf)), 0.5, 3, 4, after_refine=True).select("slide_id", "kept")


def _files(c):
    return c.selectExpr("slide_id", "pos", "concat('f', cast(pos AS string)) AS filename", "concat('o', cast(pos AS string)) AS iter_original_filename",
                        "iter_idx", "'fine' AS granularity", "'detector' AS source", "is_text_only", "x0", "y0", "x1", "y1")


@query("merge_members", sql("SELECT c.slide_id, c.pos, concat('f', cast(c.pos AS VARCHAR)) AS filename FROM components c JOIN grp g ON g.slide_id = c.slide_id", "components", extra=_GROUPS))
def merge_members(spark, sf):
    c = V.components(spark, sf)
    g = _groups(c).withColumn("member_filenames", F.transform("member_filenames", lambda m, i: F.when(i % 2 == 0, m).otherwise(F.concat(F.lit("o"), F.substring(m, 2, 9)))))
    return L.resolve_members(g, _files(c)).select("slide_id", F.substring("filename", 2, 9).cast("long").alias("pos"), "filename")


@query("all_text_groups", sql("SELECT slide_id FROM grp WHERE all_text", "components", extra=_GROUPS))
def all_text_groups(spark, sf):
    c = V.components(spark, sf)
    return L.all_text_groups(L.resolve_members(_groups(c), _files(c)), _files(c)).select("slide_id")


@query("group_hulls", sql("SELECT slide_id, x0, y0, x1, y1 FROM grp", "components", extra=_GROUPS))
def group_hulls(spark, sf):
    c = V.components(spark, sf)
    return L.group_hulls(L.resolve_members(_groups(c), _files(c)), _files(c)).select("slide_id", "x0", "y0", "x1", "y1")


@query("final_components", sql("""SELECT slide_id, n AS num_components, n - k AS num_fine, k AS num_merged, CAST(0 AS BIGINT) AS num_layout_review_missed, t AS num_bbox_tightened, n - a AS num_final_components FROM (
SELECT slide_id, count(*) AS n, count(*) FILTER (pos % 4 = 3) AS k, count(*) FILTER (score % 2 = 0) AS t, count(*) FILTER (pos % 4 IN (1, 2)) AS a FROM components GROUP BY 1) q""", "components"))
def final_components(spark, sf):
    c = V.components(spark, sf).withColumns({
        "granularity": F.when(F.col("pos") % 4 == 3, "merged").otherwise("fine"), "source": F.lit("detector"), "bbox_was_tightened": F.col("score") % 2 == 0,
        "merged_into": F.when((F.col("pos") % 4).isin(1, 2), F.lit("m"))})
    return L.manifest_counters(c)


@query("needs_mask", sql(f"""SELECT b.slide_id, b.pos, EXISTS (SELECT 1 FROM components a WHERE a.slide_id = b.slide_id AND a.label <> b.label AND b.area < a.area AND {HIT}) AS needs_mask FROM components b""", "components"))
def needs_mask(spark, sf):
    return L.needs_mask(V.components(spark, sf), K).select("slide_id", "pos", "needs_mask")


@query("class_conflict_layers", sql(f"""SELECT slide_id, label, conflict, CASE WHEN bool_or(conflict) OVER w AND NOT bool_and(conflict) OVER w AND conflict THEN 2 ELSE 1 END AS layer FROM (
 SELECT u.slide_id, u.label, EXISTS (SELECT 1 FROM components a JOIN components b ON a.slide_id = b.slide_id AND a.label <> b.label WHERE a.slide_id = u.slide_id AND a.label = u.label AND {HIT} AND {INTER} > 1) AS conflict
 FROM (SELECT DISTINCT slide_id, label FROM components UNION ALL SELECT DISTINCT slide_id, 'ZZ' FROM components) u) t WINDOW w AS (PARTITION BY slide_id)""", "components"))
def class_conflict_layers(spark, sf):
    c = V.components(spark, sf)
    wanted = c.select("slide_id", "label").union(c.select("slide_id", F.lit("ZZ"))).distinct()
    return L.conflict_layers(c, wanted)


@query("overlap_arbitration_pairs", sql(f"""SELECT a.slide_id, a.node_id AS first, b.node_id AS second, {INTER} AS overlap_px FROM components a JOIN components b ON a.slide_id = b.slide_id AND a.node_id < b.node_id WHERE {HIT} AND {INTER} >= 100""", "components"))
def overlap_arbitration_pairs(spark, sf):
    return L.overlap_to_arbitrate(V.components(spark, sf).withColumn("filename", F.col("node_id")))


_CARVE = f"""ov AS (SELECT a.slide_id, a.pos AS p, b.pos AS q, {INTER} AS px FROM components a JOIN components b ON a.slide_id = b.slide_id AND a.node_id < b.node_id WHERE {HIT} AND {INTER} >= 100),
ed AS (SELECT slide_id, i, j, row_number() OVER (PARTITION BY slide_id ORDER BY i, j) AS k FROM (SELECT slide_id, CASE WHEN px % 3 = 1 THEN p ELSE q END AS i, CASE WHEN px % 3 = 1 THEN q ELSE p END AS j FROM ov WHERE px % 3 < 2) t),
full_ed AS (SELECT e.*, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM ed e JOIN components a ON a.slide_id = e.slide_id AND a.pos = e.i JOIN components b ON b.slide_id = e.slide_id AND b.pos = e.j),
walk AS (SELECT DISTINCT slide_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(p BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT, c BIGINT)[]) AS moved FROM ed UNION ALL
 SELECT slide_id, k, CASE WHEN done OR n = 0 OR n = 4 OR ox1 <= ox0 OR oy1 <= oy0 OR (ox1 - ox0) * (oy1 - oy0) < 100 OR nx1 - nx0 < 1 OR ny1 - ny0 < 1 THEN moved ELSE list_append(moved, {{'p': i, 'x0': nx0, 'y0': ny0, 'x1': nx1, 'y1': ny1, 'c': j}}) END FROM (
  SELECT *, CASE WHEN NOT t AND NOT b AND NOT (l AND (NOT r OR ox0 - ax0 >= ax1 - ox1)) THEN ox1 ELSE ax0 END AS nx0, CASE WHEN NOT t AND NOT b AND l AND (NOT r OR ox0 - ax0 >= ax1 - ox1) THEN ox0 ELSE ax1 END AS nx1,
   CASE WHEN (t OR b) AND NOT l AND NOT r AND NOT (t AND (NOT b OR oy0 - ay0 >= ay1 - oy1)) THEN oy1 ELSE ay0 END AS ny0, CASE WHEN (t OR b) AND NOT l AND NOT r AND t AND (NOT b OR oy0 - ay0 >= ay1 - oy1) THEN oy0 ELSE ay1 END AS ny1,
   l::INT + t::INT + r::INT + b::INT AS n FROM (SELECT *, ox0 > ax0 AS l, oy0 > ay0 AS t, ox1 < ax1 AS r, oy1 < ay1 AS b FROM (
    SELECT slide_id, k, i, j, moved, done, ax0, ay0, ax1, ay1, greatest(ax0, coalesce(m.x0, bx0)) AS ox0, greatest(ay0, coalesce(m.y0, by0)) AS oy0, least(ax1, coalesce(m.x1, bx1)) AS ox1, least(ay1, coalesce(m.y1, by1)) AS oy1 FROM (
     SELECT e.*, w.moved, len(list_filter(w.moved, lambda x: x.p = e.i)) > 0 AS done, list_filter(w.moved, lambda x: x.p = e.j)[1] AS m FROM walk w JOIN full_ed e ON e.slide_id = w.slide_id AND e.k = w.k + 1) q1) q2) q3) q4),
cuts AS (SELECT slide_id, unnest(arg_max(moved, k), recursive := true) FROM walk GROUP BY 1)"""


@query("carved_boxes", sql("""SELECT c.slide_id, c.pos, CAST(coalesce(m.x0, c.x0) AS DOUBLE) AS x0, CAST(coalesce(m.y0, c.y0) AS DOUBLE) AS y0, CAST(coalesce(m.x1, c.x1) AS DOUBLE) AS x1, CAST(coalesce(m.y1, c.y1) AS DOUBLE) AS y1, m.c AS carved_by
 FROM components c LEFT JOIN cuts m ON m.slide_id = c.slide_id AND m.p = c.pos""", "components", extra=_CARVE, recursive=True))
def carved_boxes(spark, sf):
    c = cut(V.components(spark, sf).select("slide_id", "pos", F.col("node_id").alias("filename"), "x0", "y0", "x1", "y1"))
    d = L.overlap_to_arbitrate(c).withColumns({"first_owns": F.col("overlap_px") % 3 == 0, "second_owns": F.col("overlap_px") % 3 == 1})
    return L.carve_overlaps(c, d).select("slide_id", "pos", "x0", "y0", "x1", "y1", "carved_by")


@query("carved_manifest", sql("""SELECT c.slide_id, c.pos, CASE WHEN m.c IS NOT NULL THEN concat(c.x0, ',', c.y0, ',', c.x1, ',', c.y1) END AS original,
 concat(tx0, ',', ty0, ',', tx1, ',', ty1) AS tight FROM (SELECT *, CASE WHEN ok THEN greatest(x0 + 5, nx0) ELSE nx0 END AS tx0, CASE WHEN ok THEN greatest(y0 + 5, ny0) ELSE ny0 END AS ty0,
 CASE WHEN ok THEN least(x1 - 5, nx1) ELSE nx1 END AS tx1, CASE WHEN ok THEN least(y1 - 5, ny1) ELSE ny1 END AS ty1 FROM (
  SELECT c.*, coalesce(m.x0, c.x0) AS nx0, coalesce(m.y0, c.y0) AS ny0, coalesce(m.x1, c.x1) AS nx1, coalesce(m.y1, c.y1) AS ny1,
  m.c IS NULL OR least(c.x1 - 5, m.x1) > greatest(c.x0 + 5, m.x0) AND least(c.y1 - 5, m.y1) > greatest(c.y0 + 5, m.y0) AS ok FROM components c LEFT JOIN cuts m ON m.slide_id = c.slide_id AND m.p = c.pos) t) c
 LEFT JOIN cuts m ON m.slide_id = c.slide_id AND m.p = c.pos""", "components", extra=_CARVE, recursive=True))
def carved_manifest(spark, sf):
    """What a cut leaves in the manifest: the original box, and the tight box (5 px inside it) clamped to the cut."""
    c = cut(V.components(spark, sf).select("slide_id", "pos", F.col("node_id").alias("filename"), "x0", "y0", "x1", "y1")).withColumn("tight_bbox", F.array(F.col("x0") + 5, F.col("y0") + 5, F.col("x1") - 5, F.col("y1") - 5)).withColumns({"sw": F.lit(1000), "sh": F.lit(600)})
    d = L.overlap_to_arbitrate(c).withColumns({"first_owns": F.col("overlap_px") % 3 == 0, "second_owns": F.col("overlap_px") % 3 == 1})
    out = L.carve_overlaps(c, d, slide_size=("sw", "sh"))
    line = lambda a: F.array_join(F.transform(a, lambda v: v.cast("long").cast("string")), ",")
    return out.select("slide_id", "pos", line(F.col("original_bbox")).alias("original"), line(F.col("tight_bbox")).alias("tight"))


@query("placement_plan", sql("""SELECT slide_id, component_file, cls, layer, source, skip_reason, row_number() OVER (PARTITION BY slide_id ORDER BY layer, pos) - 1 AS paint_order FROM (
SELECT slide_id, pos, concat('f', cast(pos AS VARCHAR)) AS component_file, CAST(score % 7 AS INTEGER) AS cls,
 CASE score % 7 WHEN 5 THEN 0 WHEN 4 THEN 1 WHEN 3 THEN 2 WHEN 2 THEN 3 WHEN 1 THEN 4 ELSE 2 END AS layer,
 CASE WHEN score % 7 IN (1, 3, 4) THEN CASE WHEN pos % 2 = 0 THEN 'step4' ELSE 'step3' END WHEN score % 7 = 2 AND pos % 2 = 1 THEN 'step3' WHEN score % 7 = 5 AND pos % 2 = 0 THEN 'image' END AS source,
 CASE WHEN score % 7 = 0 THEN 'decorative' WHEN score % 7 = 6 THEN 'unsupported' WHEN (score % 7 = 2 AND pos % 2 = 0) OR (score % 7 = 5 AND pos % 2 = 1) THEN 'no artefact' END AS skip_reason FROM components) t""", "components"))
def placement_plan(spark, sf):
    c = V.components(spark, sf).withColumns({"page": F.col("slide_id"), "component_file": F.concat(F.lit("f"), F.col("pos"))})
    routes = c.select("page", "component_file", (F.col("score") % 7).cast("int").alias("cls"), "pos")
    art = c.select("page", "component_file", F.explode(F.when(F.col("pos") % 2 == 0, F.array(F.lit("step4"), F.lit("image"))).otherwise(F.array(F.lit("step3")))).alias("source"))
    p = L.placements(c, routes, art)
    return p.select(F.col("page").alias("slide_id"), "component_file", "cls", "layer", "source", "skip_reason", "paint_order")


# class vocabularies -------------------------------------------------------------------------------------------------
def _taxonomy(spark, sf):
    """Part types stand for fine classes, brands for coarse ones; the position is the alphabetical rank."""
    t = V.table(spark, sf, "part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_brand").alias("coarse"))
    return positions(t.withColumn("_g", F.lit(0)), ["_g"], ["name"], "t_pos").drop("_g")


_TAX = "tax AS (SELECT name, coarse, row_number() OVER (ORDER BY name) - 1 AS t_pos FROM (SELECT p_type AS name, min(p_brand) AS coarse FROM part GROUP BY 1) t)"


@query("class_union", sql("""SELECT DISTINCT l.l_orderkey AS slide_id, t.name AS class, t.t_pos FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN tax t ON lower(t.name) = lower(p.p_type)
WHERE l.l_linenumber % 4 <> 3""", extra=_TAX))
def class_union(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    ans = li.join(p, "l_partkey").select(F.col("l_orderkey").alias("slide_id"), "l_linenumber", F.upper("p_type").alias("_k"), F.lower("p_type").alias("low"))
    b = ans.where("l_linenumber % 4 < 2").select("slide_id", F.concat(F.lit(" "), F.col("_k")).alias("name"))
    c = ans.where("l_linenumber % 4 IN (1, 2)").select("slide_id", F.col("low").alias("name"))
    return C.union_classes(b, c, _taxonomy(spark, sf), "slide_id")


@query("canonical_classes", sql("""SELECT l.l_orderkey AS slide_id, t.name AS class, t.t_pos, min(l.l_linenumber) AS pos FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN tax t ON lower(t.name) = lower(p.p_type) GROUP BY 1, 2, 3""", extra=_TAX))
def canonical_classes(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_type").alias("name"))
    return C.canonical(li.join(p, "l_partkey").select(F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("pos"), "name"), _taxonomy(spark, sf), "slide_id")


@query("coarse_classes", sql("SELECT p_partkey, p_type AS label, CASE WHEN p_size % 10 = 0 THEN NULL ELSE coarse END AS coarse FROM part LEFT JOIN tax ON name = p_type", extra=_TAX))
def coarse_classes(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_type").alias("label"))
    out = C.coarse_of(p.withColumn("name", F.when(F.col("p_size") % 10 != 0, F.upper("label"))), _taxonomy(spark, sf).select("name", "coarse").withColumnRenamed("name", "name"), "name")
    return out.select("p_partkey", "label", "coarse")


@query("retry_classes", sql("""SELECT slide_id, label AS class, CAST(min(CASE WHEN src = 0 THEN 0 ELSE 1 END) AS INTEGER) AS src FROM (
 SELECT slide_id, label, 0 AS src FROM components c WHERE NOT EXISTS (SELECT 1 FROM components e WHERE e.slide_id = c.slide_id AND lower(e.label) = lower(c.label) AND e.iter_idx = 0)
 UNION ALL SELECT slide_id, label, 1 FROM components WHERE pos % 3 = 0) t GROUP BY 1, 2""", "components"))
def retry_classes(spark, sf):
    c = V.components(spark, sf)
    prop = c.select("slide_id", "pos", F.col("label").alias("class"))
    r = C.retry_classes(prop, C.extracted_classes(c.where("iter_idx = 0"), "slide_id"), prop.where("pos % 3 = 0"), "slide_id")
    return r.select("slide_id", "class", F.col("ord.src").alias("src"))


@query("extracted_classes", sql("SELECT DISTINCT slide_id, lower(trim(label)) AS class FROM components", "components"))
def extracted_classes(spark, sf):
    return C.extracted_classes(V.components(spark, sf), "slide_id")


@query("phrase_dedup", sql("""SELECT slide_id, min(pos) AS pos, arg_min(phrase, pos) AS phrase FROM (SELECT slide_id, pos, CASE WHEN pos % 2 = 0 THEN label ELSE lower(label) END AS phrase FROM components) t GROUP BY slide_id, lower(phrase)""", "components"))
def phrase_dedup(spark, sf):
    c = V.components(spark, sf).select("slide_id", "pos", F.when(F.col("pos") % 2 == 0, F.concat("label", F.lit(" "))).otherwise(F.lower("label")).alias("phrase"))
    return C.dedup_phrases(c, "slide_id")


@query("work_items", sql("SELECT o_orderkey AS image, (SELECT count(*) FROM tax) AS n_classes FROM orders", extra=_TAX))
def work_items(spark, sf):
    w = C.work_items(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image")), _taxonomy(spark, sf))
    return w.select("image", F.size("text_types").cast("long").alias("n_classes"))


@query("layered_union", sql("""SELECT slide_id, pos, row_number() OVER (PARTITION BY slide_id ORDER BY seg_layer, pos) AS n, seg_layer FROM (SELECT slide_id, pos, CAST(z_index % 2 AS BIGINT) AS seg_layer FROM components) t""", "components"))
def layered_union(spark, sf):
    c = V.components(spark, sf).withColumn("seg_layer", F.col("z_index") % 2)
    out, _ = L.unite_layers(c, c.groupBy("slide_id", "seg_layer").agg(F.count(F.lit(1)).alias("num_components")))
    return out.select("slide_id", "pos", "n", "seg_layer")


@query("z_order")
def z_order(spark, sf):
    """White ratios are stood in by the score: overlapping boxes, less white on top."""
    from slidemesh.operators.zorder import paint_order
    c = cut(V.components(spark, sf).select("slide_id", "pos", "score", "x0", "y0", "x1", "y1"))
    p = box_pairs(c.select("slide_id", "pos", "score", "x0", "y0", "x1", "y1"), K, lambda a, b: a("pos") < b("pos"))
    r = p.select("slide_id", F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), (F.col("a.score") % 100 / 100).alias("ratio_i"), (F.col("b.score") % 100 / 100).alias("ratio_j"))
    return paint_order(c, r, K)


@query("stacked_text")
def stacked_text(spark, sf):
    from slidemesh.operators.zorder import stack_text
    return stack_text(V.components(spark, sf).where("is_text_only"), K, float(SLIDE_H))


@query("refined_groups")
def refined_groups(spark, sf):
    """Groups of the first two boxes of a slide, refined by verdicts on all its other boxes; the verdicts follow from the scores."""
    from slidemesh.operators.refine import refine_groups
    c = V.components(spark, sf)
    f = c.select("slide_id", "pos", F.concat(F.lit("f"), F.col("pos")).alias("filename"), "label", "x0", "y0", "x1", "y1")
    g = _groups(c.where("pos < 2"))
    d = c.where("pos >= 2").select("slide_id", F.lit(0).alias("group_idx"), F.concat(F.lit("f"), F.col("pos")).alias("filename"),
                                   (F.col("score") % 3 == 0).alias("should_merge"), (F.col("score") % 2 == 0).alias("visually_overlaps"))
    r = refine_groups(g, f, d)
    return r.select("slide_id", "x0", "y0", "x1", "y1", F.array_join("members", " ").alias("members"), F.array_join("erases", " ").alias("erases"), "area", "rectangular")
