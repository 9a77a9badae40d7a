"""The deck state graph as two tables: nodes (components, native objects, slides) and edges (slide_id, src, dst, kind, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.operators.pairs import box_pairs
from slidemesh.operators.scan import next_row

CONTAIN_FRAC = 0.9  # fixed value
BIND_IOU = 0.5      # fixed value
EDGE_KINDS = ["contains", "reads_before", "above", "merged_with", "binds"]


def _no_weight():
    return F.lit(None).cast("double").alias("weight")


def overlap_edges(comps: DataFrame) -> DataFrame:
    """`contains` (child >= 90 % inside a strictly larger parent) and `above` (higher z over an overlap), one pair pass."""
    a, b = B.box("a."), B.box("b.")
    slim = comps.select("slide_id", "node_id", "pos", "z_index", "x0", "y0", "x1", "y1", B.area(B.box()).alias("area"))
    inter = B.inter_area(a, b).cast("double")
    contains = (F.col("a.area") > F.col("b.area")) & (F.col("b.area") > 0) & (inter / F.col("b.area") >= CONTAIN_FRAC)
    above = F.coalesce(F.col("a.z_index") > F.col("b.z_index"), F.lit(False))
    pairs = box_pairs(slim, ["slide_id"], lambda x, y: (x("pos") != y("pos")) & (contains | above))
    kinds = F.array_compact(F.array(F.when(contains, "contains"), F.when(above, "above")))
    return pairs.select("slide_id", F.col("a.node_id").alias("src"), F.col("b.node_id").alias("dst"), F.explode(kinds).alias("kind"), _no_weight())


def reading_order(comps: DataFrame) -> DataFrame:
    """Each component to the next one, top to bottom then left to right."""
    nxt = next_row(comps.select("slide_id", "node_id", "y0", "x0", "pos"), ["slide_id"], ["y0", "x0", "pos"], ["node_id"])
    return nxt.where("next_node_id IS NOT NULL").select("slide_id", F.col("node_id").alias("src"), F.col("next_node_id").alias("dst"),
                                                        F.lit("reads_before").alias("kind"), _no_weight())


def bind_objects(comps: DataFrame, objects: DataFrame, min_iou: float = BIND_IOU) -> DataFrame:
    """Edit bindings: every component-object pair with IoU >= 0.5, many to many, weight rounded to 3 digits."""
    v = B.iou(B.box("a."), B.box("b."))
    pairs = box_pairs(comps.select("slide_id", "node_id", "x0", "y0", "x1", "y1"), ["slide_id"], lambda a, b: v >= min_iou,
                      right=objects.select("slide_id", "object_id", "x0", "y0", "x1", "y1"))
    return pairs.select("slide_id", F.col("a.node_id").alias("src"), F.col("b.object_id").alias("dst"), F.lit("binds").alias("kind"), F.bround(v, 3).alias("weight"))


def merged_edges(comps: DataFrame) -> DataFrame:
    """Members of one merge group, pointing from the merged component to each member found in the table.

    Needs filename and merged_from (array of filenames)."""
    m = comps.where(F.size("merged_from") > 0).select("slide_id", F.col("node_id").alias("src"), F.explode("merged_from").alias("filename"))
    to = comps.select("slide_id", "filename", F.col("node_id").alias("dst"))
    return m.join(to, ["slide_id", "filename"]).select("slide_id", "src", "dst", F.lit("merged_with").alias("kind"), _no_weight())


def derive_edges(comps: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    out = overlap_edges(comps).unionByName(reading_order(comps))
    if "merged_from" in comps.columns:
        out = out.unionByName(merged_edges(comps))
    return out if objects is None else out.unionByName(bind_objects(comps, objects))


def summary(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Components and edges per slide and kind; slides without edges stay, the totals row has a NULL slide."""
    n = comps.groupBy("slide_id").agg(F.count(F.lit(1)).alias("components"))
    e = edges.groupBy("slide_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in EDGE_KINDS])
    per = n.join(e, "slide_id", "left").fillna(0, EDGE_KINDS)
    return per.rollup("slide_id").agg(*[F.sum(c).alias(c) for c in ["components", *EDGE_KINDS]])
