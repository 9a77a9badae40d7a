"""Pairs of overlapping boxes within a key.

A key with few boxes is joined on the key alone with the box test as residual. A key with many boxes is laid on a grid:
boxes go to the cells they touch, the join key is (key, cell), and a pair counts only in the cell that holds the
top-left corner of its intersection, so no pair is lost or repeated and no task sees all boxes of a hot key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.runtime import cut

HOT_BOXES = 2_000


def _pack(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*keys, F.struct(*[F.col(c) for c in df.columns if c not in keys]).alias(name))


def _cells(b: B.Box, cell: Column) -> Column:
    def span(lo, hi):
        a = F.floor(lo / cell).cast("long")
        return F.sequence(a, F.greatest(a, F.floor(hi / cell).cast("long")))
    ys = span(b.y0, b.y1)
    return F.flatten(F.transform(span(b.x0, b.x1), lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def _edge(df: DataFrame, boxed: bool) -> list[Column]:
    """Rows, and sums of width, height and area, of a side; points have none."""
    w, h = ((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")) if boxed else (F.lit(0.0), F.lit(0.0))
    return [F.count(F.lit(1)).alias("_n"), F.sum(F.lit(1 if boxed else 0)).alias("_m"), F.sum(w).alias("_w"), F.sum(h).alias("_h"), F.sum(w * h).alias("_a")]


def _both(left: DataFrame, right: DataFrame | None, keys: list[str], limit: int, cell: float | None, boxed: bool = True) -> DataFrame | None:
    """Keys with more than `limit` rows on a side and the edge of their grid's cells, or None. The edge follows the boxes: it is at least
    their mean width, mean height and the root of their mean area, so that all boxes together touch about four cells each."""
    counts = left.groupBy(*keys).agg(*_edge(left, boxed))
    if right is not None:
        both = counts.unionByName(right.groupBy(*keys).agg(*_edge(right, True)))
        counts = both.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.sum(c).alias(c) for c in ("_m", "_w", "_h", "_a")])
    mean = lambda c: F.col(c) / F.greatest("_m", F.lit(1))
    edge = F.greatest(mean("_w"), mean("_h"), F.sqrt(mean("_a")))
    edge = F.lit(float(cell)) if cell else F.when(edge > 0, edge).otherwise(1.0)
    big = counts.where(F.col("_n") > limit).select(*keys, edge.alias("_cell"))
    return None if big.isEmpty() else cut(big)


def box_pairs(left: DataFrame, keys: list[str], on: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
              right: DataFrame | None = None, limit: int = HOT_BOXES, cell: float | None = None) -> DataFrame:
    """Properly overlapping pairs as (keys, a, b) with struct columns a and b.

    `on(a, b)` gets two column getters, e.g. `lambda a, b: a("pos") < b("pos")`. Without `right` the table is joined
    with itself. Both tables carry x0, y0, x1, y1. `cell` fixes the edge of the grid's cells; otherwise it follows the boxes of each key."""
    big = _both(left, right, keys, limit, cell)
    other = left if right is None else right
    a, b = B.box("a."), B.box("b.")
    cond = B.overlaps(a, b) & on(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    if big is None:
        l, r = _pack(left, keys, "a").alias("l"), _pack(other, keys, "b").alias("r")
        eq = B.all_of(*[F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys])
        return l.join(r, eq & cond).select(*[F.col(f"l.{k}") for k in keys], "a", "b")
    plain = box_pairs(left.join(big, keys, "left_anti"), keys, on, other.join(big, keys, "left_anti"), limit=2**62)
    grid = big.select(*keys, "_cell")

    def spread(df, name):
        p = _pack(df, keys, name).join(grid, keys)
        return p.withColumn("_c", F.explode(_cells(B.box(f"{name}."), F.col("_cell")))).select(*keys, name, "_cell", "_c.cx", "_c.cy")

    l, r = spread(left, "a").alias("l"), spread(other, "b").alias("r")
    eq = B.all_of(*[F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "cx", "cy"]])
    own = B.intersection(a, b)
    mine = (F.floor(own.x0 / F.col("l._cell")) == F.col("l.cx")) & (F.floor(own.y0 / F.col("l._cell")) == F.col("l.cy"))
    gridded = l.join(r, eq & cond & mine).select(*[F.col(f"l.{k}") for k in keys], "a", "b")
    return plain.unionByName(gridded)


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], px: str = "cx", py: str = "cy",
                    limit: int = HOT_BOXES, cell: float | None = None) -> DataFrame:
    """(keys, a = point row, b = box row) for each box that holds the point, borders included."""
    big = _both(points, boxes, keys, limit, cell, boxed=False)
    hit = B.contains_point(B.box("b."), F.col(f"a.{px}"), F.col(f"a.{py}"))

    def joined(pp, bb, extra):
        l, r = pp.alias("l"), bb.alias("r")
        eq = B.all_of(*[F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, *extra]])
        return l.join(r, eq & hit).select(*[F.col(f"l.{k}") for k in keys], "a", "b")

    pk, bk = _pack(points, keys, "a"), _pack(boxes, keys, "b")
    if big is None:
        return joined(pk, bk, [])
    hot_p = pk.join(big, keys).select(*keys, "a", F.floor(F.col(f"a.{px}") / F.col("_cell")).alias("cx"), F.floor(F.col(f"a.{py}") / F.col("_cell")).alias("cy"))
    hot_b = bk.join(big, keys).withColumn("_c", F.explode(_cells(B.box("b."), F.col("_cell")))).select(*keys, "b", "_c.cx", "_c.cy")
    return joined(pk.join(big, keys, "left_anti"), bk.join(big, keys, "left_anti"), []).unionByName(joined(hot_p, hot_b, ["cx", "cy"]))
