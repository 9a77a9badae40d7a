"""Mask forms: boxes, disjoint rectangles, pixel runs, column-major run lengths, and outlines as polygons with holes.

Rectangles (keys, x0, y0, x1, y1; right and bottom exclusive) that do not overlap are the common form: a row run is one of height 1, a
column run one of width 1. Corners of an outline are the points where the mixed difference of the mask is not zero. They come from one
sum over the rectangles' own corners, so straight borders vanish in the aggregate however many rows they cross, and only corners reach
the kernel that closes them to rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidemesh.operators.assign import per_key

POINTS = "array<struct<x:double,y:double>>"


def merged_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, x0, x1) of one line per `keys`, with overlapping and touching ones joined."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.coalesce((F.col("x0") > reach).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def disjoint(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The union of boxes per key as rectangles (keys, x0, y0, x1, y1) that do not overlap: one per run and band between box edges."""
    b = boxes.where("x1 > x0 and y1 > y0")
    cuts = b.select(*keys, F.explode(F.array("y0", "y1")).alias("y")).distinct()
    bands = cuts.select(*keys, "y", F.lead("y").over(Window.partitionBy(*keys).orderBy("y")).alias("_ny")).where("_ny is not null")
    inside = b.join(bands, keys).where("y0 <= y and _ny <= y1").select(*keys, "y", "_ny", "x0", "x1")
    return merged_runs(inside, [*keys, "y", "_ny"]).select(*keys, "x0", F.col("y").alias("y0"), "x1", F.col("_ny").alias("y1"))


def row_runs(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Rectangles as pixel rows (keys, y, x0, x1), touching runs joined."""
    rows = rects.where("x1 > x0 and y1 > y0").select(*keys, "x0", "x1", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))
    return merged_runs(rows, [*keys, "y"])


def corners(rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, d) of the outline's corners: d is 1 or -1, and 2 or -2 where two parts touch at a point only.

    d adds up, over the four pixels around the point, those below right and above left less the other two."""
    four = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(s).alias("s")) for x, y, s in (("x0", "y0", 1), ("x1", "y0", -1), ("x0", "y1", -1), ("x1", "y1", 1))])
    return rects.select(*keys, F.explode(four).alias("c")).groupBy(*keys, F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("c.s").alias("d")).where("d <> 0")


def _rings(xs: list, ys: list, ds: list, diagonal: bool) -> list[tuple[float, list[tuple]]]:
    """(signed area, points) of the closed rings through corners sorted by y and x; outer rings are positive, holes negative.

    Corners pair off along their row and along their column, and rings alternate between both. A point where two parts touch is two
    corners; `diagonal` decides whether the ring goes on to the other part there."""
    at = []     # x, y, place among corners of its point along the row, along the column, sign
    for x, y, d in zip(xs, ys, ds):
        if abs(d) == 1:
            at.append((x, y, 0, 0, d))
        else:
            first = 1 if (d > 0) == diagonal else 0
            at += [(x, y, 0, first, d), (x, y, 1, 1 - first, d)]
    across, along = [0] * len(at), [0] * len(at)
    for k in range(0, len(at), 2):
        across[k], across[k + 1] = k + 1, k
    order = sorted(range(len(at)), key=lambda k: (at[k][0], at[k][1], at[k][3]))
    for a, b in zip(order[::2], order[1::2]):
        along[a], along[b] = b, a
    seen, rings = [False] * len(at), []
    for k in range(0, len(at), 2):
        if seen[k]:
            continue
        start = k if at[k][4] > 0 else k + 1      # a border with the mask below it runs to the right, one above it to the left
        points, area, p = [], 0, start
        while not seen[p]:
            q = across[p]
            seen[p] = seen[q] = True
            points += [at[p][:2], at[q][:2]]
            area += at[p][1] * (at[p][0] - at[q][0])
            p = along[q]
        rings.append((area, points))
    return rings


def _simplified(points: list[tuple], tolerance: float) -> list[tuple]:
    """A closed ring with only the points that keep it within `tolerance` of all (Douglas and Peucker), anchored at the first and its farthest point."""
    if tolerance <= 0 or len(points) < 4:
        return points
    far = max(range(len(points)), key=lambda k: math.dist(points[0], points[k]))
    ring, keep, todo = [*points, points[0]], {0, far}, [(0, far), (far, len(points))]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = ring[a], ring[b]
        span = math.hypot(bx - ax, by - ay)
        worst, where = tolerance, None
        for k in range(a + 1, b):
            x, y = ring[k]
            off = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / span if span else math.hypot(x - ax, y - ay)
            if off > worst:
                worst, where = off, k
        if where is not None:
            keep.add(where)
            todo += [(a, where), (where, b)]
    return [points[k] for k in sorted(keep)]


def outlines(rects: DataFrame, keys: list[str], tolerance: float = 0.0, diagonal: bool = True, min_area: float = 0.0) -> DataFrame:
    """(keys, ring, hole, area, points): the rings of each mask of non-overlapping rectangles along its pixel borders.

    `area` is that of the ring before it is simplified, holes included in the outer ring's; rings of `min_area` or less are left out. The sum of outer less
    hole areas is the mask's pixel count. One mask is closed to rings in one task: it is bounded by its picture."""
    def walk(xs: list, ys: list, ds: list) -> list[tuple]:
        out = []
        for area, points in _rings(xs, ys, ds, diagonal):
            if abs(area) > min_area:
                points = _simplified(points, tolerance)
                if len(points) >= 3:
                    out.append((len(out), area < 0, float(abs(area)), [{"x": float(x), "y": float(y)} for x, y in points]))
        return out

    return per_key(corners(rects, keys), keys, ["y", "x"], ["x", "y", "d"], walk, f"ring int, hole boolean, area double, points {POINTS}")


def vertex_lists(rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vertices): the points of masks that are one ring and no plain upright rectangle; null for all others, for which their box will do."""
    one = rings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first("points").alias("p"))
    n_of = lambda axis: F.size(F.array_distinct(F.transform("p", lambda q: F.round(q[axis], 3))))
    plain = (F.size("p") == 4) & (n_of("x") == 2) & (n_of("y") == 2)
    return one.select(*keys, F.when((F.col("_n") == 1) & (F.size("p") >= 4) & ~plain, F.col("p")).alias("vertices"))


def polygon_rects(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Scan conversion of rings (keys, points) by even-odd crossings: rectangles (keys, x0, y0, x1, y1) of the pixels whose centres lie inside.

    Rows between neighbouring ends of edges form a band. A band that only upright edges pass is one row of crossings, however high it
    is; one with a slanted edge is taken row by row. Crossings of a row pair off from the left. Nothing is painted."""
    after = F.concat(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 1, 1))
    e = rings.where(F.size("points") >= 3).select(*keys, F.explode(F.arrays_zip(F.col("points").alias("p"), after.alias("q"))).alias("_s"))
    e = e.select(*keys, *[F.col(f"_s.{a}.{c}").alias(f"{c}{a}") for a in "pq" for c in "xy"]).where("yp <> yq")
    e = e.withColumns({"_a": F.ceil(F.least("yp", "yq") - 0.5), "_b": F.ceil(F.greatest("yp", "yq") - 0.5)}).where("_a < _b")
    all_of = Window.partitionBy(*keys)
    e = e.withColumn("_ys", F.array_sort(F.array_union(F.collect_set("_a").over(all_of), F.collect_set("_b").over(all_of))))
    e = e.withColumn("_ys", F.filter("_ys", lambda v: v.between(F.col("_a"), F.col("_b"))))
    bands = F.transform(F.slice("_ys", 1, F.size("_ys") - 1), lambda v, i: F.struct(v.alias("y0"), F.element_at("_ys", i + 2).alias("y1")))
    e = e.select(*keys, "xp", "yp", "xq", "yq", F.explode(bands).alias("_v")).select("*", "_v.y0", "_v.y1").drop("_v")
    e = e.withColumn("_slant", F.max(F.col("xp") != F.col("xq")).over(Window.partitionBy(*keys, "y0")))
    lines = F.when(F.col("_slant"), F.transform(F.sequence("y0", F.col("y1") - 1), lambda v: F.struct(v.alias("y0"), (v + 1).alias("y1")))).otherwise(F.array(F.struct("y0", "y1")))
    x = F.col("xp") + (F.col("_v.y0") + 0.5 - F.col("yp")) * (F.col("xq") - F.col("xp")) / (F.col("yq") - F.col("yp"))
    crossed = e.withColumn("_v", F.explode(lines)).select(*keys, F.col("_v.y0").alias("y0"), F.col("_v.y1").alias("y1"), x.alias("x"))
    w = Window.partitionBy(*keys, "y0").orderBy("x")
    spans = crossed.select(*keys, "y0", "y1", "x", F.lead("x").over(w).alias("_to"), F.row_number().over(w).alias("_n")).where("_n % 2 = 1 and _to is not null")
    spans = spans.select(*keys, "y0", "y1", F.ceil(F.col("x") - 0.5).alias("x0"), F.ceil(F.col("_to") - 0.5).alias("x1")).where("x1 > x0")
    return merged_runs(spans, [*keys, "y0", "y1"]).select(*keys, "x0", "y0", "x1", "y1")


def polygon_runs(rings: DataFrame, keys: list[str]) -> DataFrame:
    """The same as pixel rows (keys, y, x0, x1)."""
    return polygon_rects(rings, keys).select(*keys, F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1")


def polygon_points(flat: Column) -> Column:
    """A ring [x, y, x, y, ...] as points."""
    n = F.floor(F.size(flat) / 2)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(flat[(2 * k - 2).cast("int")].cast("double").alias("x"), flat[(2 * k - 1).cast("int")].cast("double").alias("y")))) \
        .otherwise(F.array().cast(POINTS))


def counts_rects(masks: DataFrame, keys: list[str], counts: str = "counts", h: str = "h") -> DataFrame:
    """Column-major run lengths (background first) as rectangles: of each foreground run its first column, its whole columns, its last column."""
    # outer: no filter on the array is inferred, which would evaluate a computed one again and again
    c = masks.select(*keys, F.col(h).cast("long").alias("_h"), F.posexplode_outer(counts).alias("_i", "_c"))
    ends = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    r = c.withColumn("_to", ends).where("_i % 2 = 1 and _c > 0").withColumn("_from", F.col("_to") - F.col("_c"))
    r = r.select(*keys, "_h", "_from", "_to", F.expr("_from div _h").alias("_x"), F.expr("(_to - 1) div _h").alias("_z"))
    one = lambda x0, x1, y0, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    x, z, hh, zero = F.col("_x"), F.col("_z"), F.col("_h"), F.lit(0).cast("long")
    first = one(x, x + 1, F.col("_from") - x * hh, F.least(hh, F.col("_to") - x * hh))
    parts = F.array(first, one(x + 1, z, zero, hh), one(F.greatest(z, x + 1), z + 1, zero, F.col("_to") - z * hh))
    return r.select(*keys, F.explode(parts).alias("r")).select(*keys, "r.*").where("x1 > x0 and y1 > y0")


def rects_counts(rects: DataFrame, keys: list[str], h: Column, w: Column) -> DataFrame:
    """Non-overlapping rectangles inside an h x w picture as column-major run lengths (keys, h, w, counts), background first."""
    turned = disjoint(rects.select(*keys, F.col("y0").alias("x0"), F.col("x0").alias("y0"), F.col("y1").alias("x1"), F.col("x1").alias("y1")), keys)
    bands = turned.groupBy(*keys, F.col("y0").alias("_a"), F.col("y1").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("r"))
    g = bands.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_a", "_b", "r"))).alias("bands"))
    g = g.select(*keys, h.cast("long").alias("h"), w.cast("long").alias("w"), "bands")
    column = lambda r: lambda x: F.transform(r, lambda p: F.struct((x * F.col("h") + p["x0"]).alias("a"), (x * F.col("h") + p["x1"]).alias("b")))
    g = g.withColumn("r", F.flatten(F.transform("bands", lambda b: F.flatten(F.transform(F.sequence(b["_a"], b["_b"] - 1), column(b["r"]))))))
    # a run that reaches the foot of a column goes on at the head of the next
    before = lambda i: F.element_at("r", F.greatest(i, F.lit(1)))["b"]
    after = lambda i: F.element_at("r", F.least(i + 2, F.size("r")))["a"]
    g = g.select(*keys, "h", "w", F.filter("r", lambda p, i: (i == 0) | (p["a"] != before(i))).alias("s"), F.filter("r", lambda p, i: (i + 1 == F.size("r")) | (p["b"] != after(i))).alias("e"))
    gaps = F.transform("s", lambda p, i: F.array(p["a"] - F.when(i > 0, F.element_at("e", F.greatest(i, F.lit(1)))["b"]).otherwise(F.lit(0)), F.element_at("e", i + 1)["b"] - p["a"]))
    rest = F.col("h") * F.col("w") - F.element_at("e", -1)["b"]
    return g.select(*keys, "h", "w", F.concat(F.flatten(gaps), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))).alias("counts"))
