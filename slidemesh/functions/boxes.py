"""Box geometry as Column expressions. A Box is four Columns (x0, y0, x1, y1); nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EMU_PER_PX = 9525  # fixed value


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    def struct(self) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(self, ("x0", "y0", "x1", "y1"))])

    def array(self) -> Column:
        return F.array(*[c.cast("double") for c in self])


def box(prefix: str = "") -> Box:
    """Columns `<prefix>x0` ...; use prefix 'a.' for a struct column."""
    return Box(*[F.col(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1")])


def box_of_array(c: Column) -> Box:
    return Box(*[F.try_element_at(c, F.lit(i)) for i in (1, 2, 3, 4)])


def pos(c: Column) -> Column:
    """max(c, 0)."""
    return F.greatest(c, F.lit(0))


def width(b: Box) -> Column:
    return pos(b.x1 - b.x0)


def height(b: Box) -> Column:
    return pos(b.y1 - b.y0)


def area(b: Box) -> Column:
    return width(b) * height(b)


def intersection(a: Box, b: Box) -> Box:
    return Box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))


def inter_area(a: Box, b: Box) -> Column:
    return area(intersection(a, b))


def overlaps(a: Box, b: Box, min_area: float | None = None) -> Column:
    """Proper overlap, or overlap of at least `min_area` (inclusive)."""
    if min_area is not None:
        return inter_area(a, b) >= F.lit(min_area)
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 where den <= 0."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def union_area(a: Box, b: Box) -> Column:
    return area(a) + area(b) - inter_area(a, b)


def iou(a: Box, b: Box) -> Column:
    return ratio(inter_area(a, b), union_area(a, b))


def ioa_second(a: Box, b: Box) -> Column:
    """Intersection over the second box's area (box helper convention)."""
    return ratio(inter_area(a, b), area(b))


def ioa_first(a: Box, b: Box) -> Column:
    """Intersection over the first box's area (tracking convention)."""
    return ratio(inter_area(a, b), area(a))


def iom(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return ratio(inter_area(a, b), F.least(area(a), area(b)))


def near_duplicate_ratio(a: Box, b: Box) -> Column:
    return inter_area(a, b).cast("double") / F.greatest(F.lit(1e-6), F.least(area(a), area(b)).cast("double"))


def hull(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def giou(a: Box, b: Box) -> Column:
    h = area(hull(a, b))
    return iou(a, b) - ratio(h - union_area(a, b), h)


def overlap_ratios(a: Box, b: Box) -> tuple[Column, Column]:
    """Overlap over each side's area, areas floored at 1."""
    i = inter_area(a, b).cast("double")
    return tuple(F.when(i <= 0, 0.0).otherwise(i / F.greatest(F.lit(1.0), area(s).cast("double"))) for s in (a, b))


# encodings ---------------------------------------------------------------------------------------------------------
def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def xyxy_to_xywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x0, b.y0, b.x1 - b.x0, b.y1 - b.y0


def cxcywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def xyxy_to_cxcywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2, b.x1 - b.x0, b.y1 - b.y0


def rotated_hull(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Box:
    """Axis-parallel hull of a rectangle turned about its centre."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    hw, hh = (c * w + s * h) / 2, (s * w + c * h) / 2
    return Box(cx - hw, cy - hh, cx + hw, cy + hh)


def xywha_to_xyxy(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Box:
    return rotated_hull(cx, cy, w, h, degrees)


# clamp, scale, predicates ------------------------------------------------------------------------------------------
def _clip(v: Column, lo, hi) -> Column:
    return F.greatest(lo if isinstance(lo, Column) else F.lit(lo), F.least(hi if isinstance(hi, Column) else F.lit(hi), v))


def clamp_to_image(b: Box, w: Column, h: Column) -> Box:
    """Inside the image, each side at least one pixel."""
    d = [c.cast("double") for c in b]
    w, h = w.cast("double"), h.cast("double")
    x0, y0 = _clip(d[0], 0.0, w - 1), _clip(d[1], 0.0, h - 1)
    return Box(x0, y0, F.greatest(x0 + 1.0, F.least(w, d[2])), F.greatest(y0 + 1.0, F.least(h, d[3])))


def clip(b: Box, w: Column, h: Column) -> Box:
    z = w - w
    return Box(_clip(b.x0, z, w), _clip(b.y0, z, h), _clip(b.x1, z, w), _clip(b.y1, z, h))


def nonempty(b: Box, threshold: float = 0.0) -> Column:
    return (b.x1 - b.x0 > threshold) & (b.y1 - b.y0 > threshold)


def inside(b: Box, w: Column, h: Column, margin: float = 0.0) -> Column:
    return (b.x0 >= -margin) & (b.y0 >= -margin) & (b.x1 < w + margin) & (b.y1 < h + margin)


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2


def scale(b: Box, sx, sy) -> Box:
    return Box(b.x0 * sx, b.y0 * sy, b.x1 * sx, b.y1 * sy)


def point_distance(px: Column, py: Column, b: Box) -> tuple[Column, Column, Column, Column]:
    """Signed distances of a point to left, top, right, bottom (negative outside)."""
    return px - b.x0, py - b.y0, b.x1 - px, b.y1 - py


def contains_point(b: Box, px: Column, py: Column) -> Column:
    return (b.x0 <= px) & (px <= b.x1) & (b.y0 <= py) & (py <= b.y1)


def normalise(b: Box, w: Column, h: Column) -> Box:
    return Box(b.x0 / w, b.y0 / h, b.x1 / w, b.y1 / h)


def from_model_space(b: Box, w: Column, h: Column) -> Box:
    """Model boxes are relative to the longer image side; result is clipped to the image."""
    side = F.greatest(w, h).cast("double")
    return clip(scale(b, side, side), w.cast("double"), h.cast("double"))


def is_zero_box(c: Column) -> Column:
    """NULL, fewer than four numbers, or no positive number among the first four."""
    return c.isNull() | (F.size(c) < 4) | F.forall(F.slice(c, 1, 4), lambda v: v <= 0)


def near_boundary(b: Box, margin: float = 0.025) -> Column:
    """Centre of a normalised box within `margin` of an edge."""
    cx, cy = centre(b)
    ok = (cx > margin) & (cx < 1 - margin) & (cy > margin) & (cy < 1 - margin)
    return ~ok


def px_to_emu(px: Column) -> Column:
    return F.bround(px.cast("double") * EMU_PER_PX).cast("long")


def extend_horizontally(b: Box, extend: Column, slide_w: Column) -> Box:
    """Widen by `extend` px centred; slack one side lacks goes to the other."""
    sl, sr = F.greatest(F.lit(0.0), b.x0.cast("double")), F.greatest(F.lit(0.0), (slide_w - b.x1).cast("double"))
    half = extend / 2.0
    al, ar = F.least(half, sl), F.least(half, sr)
    rem = extend - al - ar
    more_l = F.least(rem, sl - al)
    more_r = F.least(rem - more_l, sr - ar)
    idle = (extend <= 0) | (sl + sr <= 0)
    return Box(F.when(idle, b.x0.cast("double")).otherwise(b.x0 - al - more_l), b.y0,
               F.when(idle, b.x1.cast("double")).otherwise(b.x1 + ar + more_r), b.y1)


def fit_geometry(b: Box, img_w: Column, img_h: Column, letterbox: float = 1.5) -> Column:
    """Fit-inside and fill scale of an image in a box, aspect mismatch and whether bars need a backing panel."""
    bw, bh = (b.x1 - b.x0).cast("double"), (b.y1 - b.y0).cast("double")
    box_ar, img_ar = bw / F.greatest(F.lit(1e-6), bh), img_w / F.greatest(F.lit(1), img_h)
    mismatch = F.greatest(box_ar / img_ar, img_ar / box_ar)
    fit, fill = F.least(bw / img_w, bh / img_h), F.greatest(bw / img_w, bh / img_h)
    return F.struct(fit.alias("fit"), fill.alias("fill"), mismatch.alias("mismatch"), (mismatch > letterbox).alias("letterbox"),
                    (b.x0 + (bw - img_w * fit) / 2).alias("off_x"), (b.y0 + (bh - img_h * fit) / 2).alias("off_y"))


def crop_edge_strips(b: Box, text_boxes: Column, max_frac: float = 0.30, min_left: float = 0.4) -> Column:
    """Pull box sides in past text boxes that touch them.

    `text_boxes` is an array of structs x0..y1 in paint order. A strip deeper than `max_frac` of the side is ignored;
    a result under `min_left` of a side gives the box back unchanged. Returns a struct x0..y1."""
    d = Box(*[c.cast("double") for c in b])
    ow, oh = d.x1 - d.x0, d.y1 - d.y0

    def step(acc, t):
        cur = Box(acc["x0"], acc["y0"], acc["x1"], acc["y1"])
        i = intersection(cur, Box(*[t[n].cast("double") for n in ("x0", "y0", "x1", "y1")]))
        hit = (i.x1 > i.x0) & (i.y1 > i.y0)
        top = hit & (i.y0 <= cur.y0 + 1) & (i.y1 - cur.y0 <= max_frac * oh)
        bottom = hit & ~top & (i.y1 >= cur.y1 - 1) & (cur.y1 - i.y0 <= max_frac * oh)
        left = hit & ~top & ~bottom & (i.x0 <= cur.x0 + 1) & (i.x1 - cur.x0 <= max_frac * ow)
        right = hit & ~top & ~bottom & ~left & (i.x1 >= cur.x1 - 1) & (cur.x1 - i.x0 <= max_frac * ow)
        return Box(F.when(left, i.x1).otherwise(cur.x0), F.when(top, i.y1).otherwise(cur.y0),
                   F.when(right, i.x0).otherwise(cur.x1), F.when(bottom, i.y0).otherwise(cur.y1)).struct()

    out = F.aggregate(text_boxes, d.struct(), step)
    bad = (ow <= 1) | (oh <= 1) | (out["x1"] - out["x0"] < min_left * ow) | (out["y1"] - out["y0"] < min_left * oh)
    return F.when(bad, d.struct()).otherwise(out)


def let(value: Column, body) -> Column:
    """Bind a (struct) value once and use it many times in `body`, which keeps the expression tree small."""
    return F.transform(F.array(value), body)[0]


def subtract_box(a: Box, b: Box) -> Column:
    """A minus B for rectangles, as struct(kind, x0..y1, vertices).

    kind: 'none' no overlap; 'empty' nothing left; 'hole' B strictly inside A; 'split' A falls apart, the larger part is
    returned; 'rect' a side is cut off; 'poly' a corner or a notch is cut out (hull = A, vertices listed)."""
    names = ("x0", "y0", "x1", "y1")
    bound = F.struct(*[c.cast("double").alias(f"a{n}") for n, c in zip(names, a)], *[c.cast("double").alias(f"i{n}") for n, c in zip(names, intersection(a, b))])
    return let(bound, lambda s: let(_cut_sides(s, names), lambda f: _cut_shape(f, names)))


def _cut_sides(s: Column, names) -> Column:
    a, i = Box(*[s[f"a{n}"] for n in names]), Box(*[s[f"i{n}"] for n in names])
    return F.struct(s.alias("s"), ((i.x1 > i.x0) & (i.y1 > i.y0)).alias("hit"), (i.x0 <= a.x0).alias("l"), (i.y0 <= a.y0).alias("t"),
                    (i.x1 >= a.x1).alias("r"), (i.y1 >= a.y1).alias("m"))


def _cut_shape(f: Column, names) -> Column:
    a, i = Box(*[f["s"][f"a{n}"] for n in names]), Box(*[f["s"][f"i{n}"] for n in names])
    l, t, r, m, hit = (f[k] for k in ("l", "t", "r", "m", "hit"))
    n = sum(c.cast("int") for c in (l, t, r, m))
    tall, flat = t & m, l & r
    kind = (F.when(~hit, "none").when(n == 4, "empty").when(n == 0, "hole").when(n == 3, "rect")
            .when((n == 2) & (tall | flat), "split").otherwise("poly"))
    part = hit & ((n == 3) | ((n == 2) & (tall | flat)))
    keep_left = part & tall & ~l & (r | ((i.x0 - a.x0) >= (a.x1 - i.x1)))
    keep_right = part & tall & ~keep_left
    keep_top = part & flat & ~tall & ~t & (m | ((i.y0 - a.y0) >= (a.y1 - i.y1)))
    keep_bottom = part & flat & ~tall & ~keep_top
    out = Box(F.when(keep_right, i.x1).otherwise(a.x0), F.when(keep_bottom, i.y1).otherwise(a.y0),
              F.when(keep_left, i.x0).otherwise(a.x1), F.when(keep_top, i.y0).otherwise(a.y1))

    def ring(*pts):
        return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts])

    nw, ne, se, sw = (a.x0, a.y0), (a.x1, a.y0), (a.x1, a.y1), (a.x0, a.y1)
    outline = (
        F.when(~hit | (n == 0) | (n > 2) | ((n == 2) & (tall | flat)), F.lit(None))
        .when(l & t, ring((i.x1, a.y0), ne, se, sw, (a.x0, i.y1), (i.x1, i.y1)))
        .when(r & t, ring(nw, (i.x0, a.y0), (i.x0, i.y1), (a.x1, i.y1), se, sw))
        .when(r & m, ring(nw, ne, (a.x1, i.y0), (i.x0, i.y0), (i.x0, a.y1), sw))
        .when(l & m, ring(nw, ne, se, (i.x1, a.y1), (i.x1, i.y0), (a.x0, i.y0)))
        .when(t, ring(nw, (i.x0, a.y0), (i.x0, i.y1), (i.x1, i.y1), (i.x1, a.y0), ne, se, sw))
        .when(m, ring(nw, ne, se, (i.x1, a.y1), (i.x1, i.y0), (i.x0, i.y0), (i.x0, a.y1), sw))
        .when(l, ring(nw, ne, se, sw, (a.x0, i.y1), (i.x1, i.y1), (i.x1, i.y0), (a.x0, i.y0)))
        .otherwise(ring(nw, ne, (a.x1, i.y0), (i.x0, i.y0), (i.x0, i.y1), (a.x1, i.y1), se, sw)))
    return F.struct(kind.alias("kind"), *[c.alias(k) for c, k in zip(out, names)], outline.alias("vertices"))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of structs (x, y)."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def keypoint_box(keypoints: Column) -> Column:
    """Box of a flat x,y,v,x,y,v,... array as struct x0..y1 and its area."""
    def stride(k):
        return F.filter(keypoints, lambda v, i: i % 3 == k)
    b = Box(F.array_min(stride(0)), F.array_min(stride(1)), F.array_max(stride(0)), F.array_max(stride(1)))
    return F.struct(*[c.alias(n) for c, n in zip(b, ("x0", "y0", "x1", "y1"))], ((b.x1 - b.x0) * (b.y1 - b.y0)).alias("area"))


def frame_inter_union(a: Column, b: Column) -> Column:
    """Per-frame intersection and union of two arrays of xywh arrays (NULL = absent)."""
    def one(p, q):
        pa, qa = box_of_xywh(p), box_of_xywh(q)
        i = F.when(p.isNotNull() & q.isNotNull(), inter_area(pa, qa)).otherwise(F.lit(0.0))
        u = F.coalesce(area(pa), F.lit(0.0)) + F.coalesce(area(qa), F.lit(0.0)) - i
        return F.struct(i.alias("inter"), u.alias("union"))
    return F.zip_with(a, b, one)


def box_of_xywh(c: Column) -> Box:
    g = [F.try_element_at(c, F.lit(i)).cast("double") for i in (1, 2, 3, 4)]
    return xywh_to_xyxy(*g)


def all_of(*conds: Column) -> Column:
    return reduce(lambda p, q: p & q, conds)
