"""Colour audits over run and shape tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.functions import color as C
from slidemesh.operators.pairs import points_in_boxes


def local_background(shapes: DataFrame, page_colour: DataFrame | None = None, key: str = "slide_id") -> DataFrame:
    """Background behind each shape: own fill, else the topmost earlier filled shape holding its centre, else the page mean.

    shapes: key, idx, fill (hex or NULL), x0..y1. page_colour: key, idx, mean_hex."""
    cx, cy = B.centre(B.box())
    pts = shapes.where("fill IS NULL").select(key, "idx", cx.alias("cx"), cy.alias("cy"))
    under = points_in_boxes(pts, shapes.where("fill IS NOT NULL").select(key, "idx", "fill", "x0", "y0", "x1", "y1"), [key]).where("b.idx < a.idx")
    top = under.groupBy(key, F.col("a.idx").alias("idx")).agg(F.max_by("b.fill", "b.idx").alias("_under"))
    out = shapes.join(top, [key, "idx"], "left")
    if page_colour is not None:
        out = out.join(page_colour, [key, "idx"], "left")
    return out.withColumn("local_bg", F.coalesce("fill", "_under", *(["mean_hex"] if page_colour is not None else []))).drop("_under")


def audit_runs(runs: DataFrame, candidates: list[str], minimum: float = C.LOCAL_CONTRAST) -> DataFrame:
    """Runs (fg_r.., bg_r..) below the local minimum with the replacement colour and both ratios."""
    ratio = C.contrast(C.rgb("fg_"), C.rgb("bg_"))
    low = runs.withColumn("old_ratio", ratio).where(F.col("old_ratio") < minimum).withColumn("new_hex", C.best_candidate(candidates, C.rgb("bg_")))
    new = tuple(F.conv(F.substring("new_hex", i, 2), 16, 10).cast("int") for i in (1, 3, 5))
    return low.withColumns({"old_ratio": F.bround("old_ratio", 2), "new_ratio": F.bround(C.contrast(new, C.rgb("bg_")), 2)})


def recolour_runs(runs: DataFrame, target: str, minimum: float = C.TEXT_CONTRAST) -> DataFrame:
    """Adds kept and hex: readable runs keep their colour, the others get the target."""
    kept = C.keep_run_colour(C.rgb("fg_"), C.rgb("bg_"), F.col("fg_r").isNotNull(), minimum)
    return runs.withColumns({"kept": kept, "hex": F.when(kept, C.rgb_hex(*C.rgb("fg_"))).otherwise(F.lit(target))})


def histogram(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role, hex, n) of normalised fill and border colours."""
    return cells.withColumn("hex", C.hex_norm(F.col("hex"))).where("hex IS NOT NULL").groupBy(*keys, "role", "hex").agg(F.count(F.lit(1)).alias("n"))


def histogram_text(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Listing '#HEX (xN), ...' by count; at most 2^24 colours exist, so the list is bounded."""
    item = F.struct((-F.col("n")).alias("k"), F.col("hex"))
    rows = F.array_sort(F.collect_list(item))
    text = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("#"), r["hex"], F.lit(" (x"), (-r["k"]).cast("string"), F.lit(")"))), ", ")
    return hist.groupBy(*keys, "role").agg(text.alias("listing"))


def map_colours(cells: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Same source colour, same target: equi join on (role, hex); the map is validated before."""
    m = mapping.select("role", C.hex_norm(F.col("source")).alias("hex"), C.hex_norm(F.col("target")).alias("_to"))
    return cells.withColumn("hex", C.hex_norm(F.col("hex"))).join(m, ["role", "hex"], "left").withColumn("new_hex", F.coalesce("_to", "hex")).drop("_to")


def best_font(palette: DataFrame, keys: list[str]) -> DataFrame:
    """Palette entry of the highest stated contrast, the first one on ties (keys, pos, hex, contrast_ratio)."""
    return palette.groupBy(*keys).agg(F.max_by("hex", F.struct("contrast_ratio", -F.col("pos"))).alias("hex"))
