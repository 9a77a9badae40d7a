"""Paint order from pairwise white ratios, and stacking of overlapping text boxes."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.operators.assign import components_of, per_key
from slidemesh.operators.scan import positions
from slidemesh.runtime import cut, split_hot

HOT_EDGES = 20_000
MARGIN = 0.02  # fixed value


def precedence(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, under, over): of two overlapping components the clearly less white one is painted later.

    ratios: keys, i, j, ratio_i, ratio_j (NULL when a crop is missing: no edge)."""
    i_top = F.col("ratio_i") < F.col("ratio_j") - MARGIN
    j_top = F.col("ratio_j") < F.col("ratio_i") - MARGIN
    return ratios.where(i_top | j_top).select(*keys, F.when(i_top, F.col("j")).otherwise(F.col("i")).alias("under"), F.when(i_top, F.col("i")).otherwise(F.col("j")).alias("over"))


def z_order(comps: DataFrame, ratios: DataFrame, keys: list[str]) -> DataFrame:
    """Adds z_index: topological order that takes the largest ready component first (then position); by area where a cycle exists."""
    return comps.drop("z_index").join(paint_order(comps, ratios, keys), [*keys, "pos"])


def paint_order(comps: DataFrame, ratios: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, z_index) of z_order. A slide of bounded size is one heap walk over its components and edges, sorted together."""
    order = comps.select(*keys, "pos", (-((F.bround("x1") - F.bround("x0")) * (F.bround("y1") - F.bround("y0")))).cast("double").alias("neg_area"))
    lowest = F.lit(float("-inf"))
    nodes = order.select(*keys, F.lit(False).alias("edge"), F.col("pos").cast("long").alias("a"), F.col("pos").cast("long").alias("b"), F.coalesce("neg_area", lowest).alias("neg_area"))
    edges = precedence(ratios, keys).select(*keys, F.lit(True).alias("edge"), F.col("under").cast("long").alias("a"), F.col("over").cast("long").alias("b"), F.lit(0.0).alias("neg_area"))
    rows = cut(nodes.unionByName(edges))
    per = rows.groupBy(*keys).agg(F.count_if("edge").alias("_e"), F.count(F.lit(1)).alias("_n"))
    large = per.where((F.col("_e") > HOT_EDGES) | (F.col("_n") > 10 * HOT_EDGES)).select(*keys)
    if large.isEmpty():
        return _walked(rows, keys)
    large = cut(large)
    hot = cut(rows.join(large, keys, "left_semi"))
    parts = _merged(hot.where("NOT edge").select(*keys, F.col("a").alias("pos"), "neg_area"), hot.where("edge").select(*keys, F.col("a").alias("under"), F.col("b").alias("over")), keys)
    return _walked(rows.join(large, keys, "left_anti"), keys).unionByName(parts)


def _walked(rows: DataFrame, keys: list[str]) -> DataFrame:
    def walk(edge: list, a: list, b: list, neg_area: list) -> list[tuple]:
        n = len(edge) - sum(edge)       # components come first
        area = dict(zip(a[:n], neg_area))
        heap = [(area[v], v) for v in area]
        if n == len(edge):
            return [(v, k) for k, (_, v) in enumerate(sorted(heap))]
        nxt: dict = {}
        need = dict.fromkeys(area, 0)
        for u, o in zip(a[n:], b[n:]):
            if u in area and o in area:
                nxt.setdefault(u, []).append(o)
                need[o] += 1
        heap, done = [h for h in heap if not need[h[1]]], []
        heapq.heapify(heap)
        while heap:
            v = heapq.heappop(heap)[1]
            done.append(v)
            for o in nxt.get(v, ()):
                need[o] -= 1
                if not need[o]:
                    heapq.heappush(heap, (area[o], o))
        if len(done) < len(area):
            done = sorted(area, key=lambda v: (area[v], v))
        return [(v, k) for k, v in enumerate(done)]

    return per_key(rows, keys, ["edge"], ["edge", "a", "b", "neg_area"], walk, "pos long, z_index long")


def _merged(order: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Slides of any size. Only components with an edge need the heap walk. Independent walks merge exactly by the running maximum of the
    walk's sort key, so that isolated components, and the connected parts of a slide with very many edges, are merged by one sort."""
    a = order.select(*keys, F.col("pos").alias("under"), F.col("neg_area").alias("ua"))
    b = order.select(*keys, F.col("pos").alias("over"), F.col("neg_area").alias("oa"))
    cold, hot = split_hot(edges.join(a, [*keys, "under"]).join(b, [*keys, "over"]), keys, HOT_EDGES)
    schema = "pos long, m_area double, m_pos long, seq long, cyclic boolean"
    cols = ["under", "over", "ua", "oa"]

    def walk(under: list, over: list, ua: list, oa: list) -> list[tuple]:
        area = {**dict(zip(under, ua)), **dict(zip(over, oa))}
        nxt: dict = {}
        need = dict.fromkeys(area, 0)
        for u, o in zip(under, over):
            nxt.setdefault(u, []).append(o)
            need[o] += 1
        heap = [(area[v], v) for v in area if need[v] == 0]
        heapq.heapify(heap)
        rows, top = [], (float("-inf"), -1)
        while heap:
            item = heapq.heappop(heap)
            top = max(top, item)
            rows.append((item[1], top[0], top[1], len(rows), False))
            for o in nxt.get(item[1], []):
                need[o] -= 1
                if need[o] == 0:
                    heapq.heappush(heap, (area[o], o))
        return rows if len(rows) == len(area) else [(v, 0.0, 0, 0, True) for v in area]

    walked = per_key(cold, keys, ["under", "over"], cols, walk, schema)
    if hot is not None:
        h = cut(hot)
        both = h.select(*keys, F.col("under").alias("r"), F.col("over").alias("c")).union(h.select(*keys, "over", "under")).union(h.select(*keys, "under", "under")).union(h.select(*keys, "over", "over")).distinct()
        part = components_of(cut(both), keys).select(*keys, F.col("r").alias("under"), "comp").distinct()
        walked = walked.unionByName(per_key(h.join(part, [*keys, "under"]), [*keys, "comp"], ["under", "over"], cols, walk, schema).drop("comp"))
    walked = cut(walked)
    bad = walked.groupBy(*keys).agg(F.max("cyclic").alias("_cyc"))
    j = order.join(walked, [*keys, "pos"], "left").join(bad, keys, "left")
    cyc = F.coalesce("_cyc", F.lit(False))
    ranked = j.select(*keys, "pos", F.when(cyc, F.col("neg_area")).otherwise(F.coalesce("m_area", "neg_area")).alias("k1"),
                      F.when(cyc, F.col("pos")).otherwise(F.coalesce("m_pos", "pos")).alias("k2"), F.when(cyc, F.lit(0)).otherwise(F.coalesce("seq", F.lit(0))).alias("k3"))
    return positions(ranked, keys, ["k1", "k2", "k3", "pos"], "z_index").select(*keys, "pos", "z_index")


def stack_text(boxes: DataFrame, keys: list[str], slide_h: float, threshold: float = 0.12, margin: float = 10.0) -> DataFrame:
    """Text boxes in order are pushed below or above earlier placed ones they overlap by more than 12 % of either side.

    Each placement depends on all earlier ones of the page, so a page is one walk (pages hold a screenful of text boxes)."""
    def share(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / max(1.0, min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])))

    def place(cur, placed):
        for _ in range(5):
            moved = False
            for p in placed:
                if share(cur, p) <= threshold:
                    continue
                h = cur[3] - cur[1]
                below, above = p[3] + margin, p[1] - margin - h
                prefer_below = (cur[1] + cur[3]) / 2 >= (p[1] + p[3]) / 2
                fits = [below] if below + h <= slide_h else []
                fits = fits + ([above] if above >= 0 else []) if prefer_below else ([above] if above >= 0 else []) + fits
                if fits:
                    cur = (cur[0], fits[0], cur[2], fits[0] + h)
                    moved = True
            if not moved:
                break
        return cur

    def walk(pos: list, x0: list, y0: list, x1: list, y1: list) -> list[tuple]:
        placed: list[tuple] = []
        for cur in zip(x0, y0, x1, y1):
            placed.append(place(cur, placed))
        return [(p, *map(float, q)) for p, q in zip(pos, placed)]

    cols = ["pos", "x0", "y0", "x1", "y1"]
    return per_key(boxes.select(*keys, *cols), keys, ["pos"], cols, walk, "pos long, x0 double, y0 double, x1 double, y1 double")
