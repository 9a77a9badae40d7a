"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are normalised and turned onto the principal axes of the whole table (second moments about the origin), most energy first. Rows
are cut into tiles along the first axis; a pair of tiles is compared unless the gap between their boxes already excludes the threshold.
Inside a pair the leading coordinates are multiplied first; the rest of the product is bounded by the norms of the remaining suffixes, and
comparison stops where the bound is below the threshold. What survives is verified by the cosine of the original vectors in double
precision. Links are counted and reduced to a spanning forest inside the task, so a dense cluster returns rows per vector, not per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidemesh.llm.common import Scratch, components, query, table

BLOCK = 1024            # rows of a matrix product
MAX_TILE = 16_384
SLACK = 1e-5            # over the rounding of single-precision bounds


def _matrix(col: pa.Array, dtype: str) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(dtype)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(nodes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes as columns, share of energy left after each axis) over all rows; d x d numbers reach the driver, whatever the row count."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            u = unit(_matrix(b.column(0), "f8"))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(group: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, "f8") for x in group.column("row").to_pylist()]
        return pa.table({"i": group.column("i")[:1], "row": pa.array([np.sum(rows, 0).tobytes()], pa.binary())})

    got = nodes.select("vec").mapInArrow(sums, "i long, row binary").groupBy("i").applyInArrow(add, "i long, row binary").collect()
    moment = np.zeros((dim, dim))
    for r in got:
        moment[r["i"]] = np.frombuffer(r["row"], "f8")
    values, vectors = np.linalg.eigh((moment + moment.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    return np.ascontiguousarray(vectors), 1 - np.cumsum(values) / max(values.sum(), 1e-300)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of n points, by array steps."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            return label


class Comparer:
    """Compares two tiles: leading `cuts[0]` coordinates as a matrix product, then to `cuts[1]` for survivors, then in full."""

    def __init__(self, axes: np.ndarray, left: np.ndarray, threshold: float):
        d = len(axes)
        self.axes, self.threshold = axes, threshold
        self.cuts = [int(min(d, max(1, np.searchsorted(-left, -share) + 1))) for share in (0.62, 0.3)]

    def prepare(self, vectors: np.ndarray) -> tuple:
        u = unit(vectors)
        turned = u @ self.axes
        suffix = [np.sqrt(np.maximum((turned[:, k:] ** 2).sum(1), 0)) for k in self.cuts]
        lead = np.concatenate([turned[:, :self.cuts[0]], suffix[0][:, None]], 1).astype(np.float32)
        middle = np.concatenate([turned[:, :self.cuts[1]], suffix[1][:, None]], 1)
        return u, lead, middle

    def block(self, x: tuple, y: tuple, r: slice, s: slice) -> tuple[np.ndarray, np.ndarray]:
        bound = x[1][r] @ y[1][s].T
        i, j = np.nonzero(bound >= self.threshold - SLACK)
        i, j = i + r.start, j + s.start
        if len(i) * 8 > bound.size:     # most pairs are near: the full product is cheaper than gathering rows
            full = x[0][r] @ y[0][s].T
            i, j = np.nonzero(full >= self.threshold - SLACK)
            sure = full[i, j] >= self.threshold + SLACK
            i, j = i + r.start, j + s.start
            near = np.flatnonzero(~sure)
            keep = sure.copy()
            keep[near] = self._exact(x, y, i[near], j[near])
            return i[keep], j[keep]
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), 65_536):
            a, b = i[at:at + 65_536], j[at:at + 65_536]
            ok = np.flatnonzero(np.einsum("ij,ij->i", x[2][a], y[2][b]) >= self.threshold - SLACK)
            keep[at + ok[self._exact(x, y, a[ok], b[ok])]] = True
        return i[keep], j[keep]

    def _exact(self, x: tuple, y: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), 65_536):
            out[at:at + 65_536] = (x[0][a[at:at + 65_536]] * y[0][b[at:at + 65_536]]).sum(1) >= self.threshold
        return out

    def links(self, x: tuple, y: tuple, wx: np.ndarray, wy: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(links of each row of x then y, smallest row index each is joined to, counted through x and then y)."""
        nx, ny = len(wx), len(wy)
        total = nx if same else nx + ny
        count, ends = np.zeros(total, np.int64), [np.empty((0, 2), np.int64)]
        for r in range(0, nx, BLOCK):
            for s in range(r if same else 0, ny, BLOCK):
                i, j = self.block(x, y, slice(r, r + BLOCK), slice(s, s + BLOCK))
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                count[:nx] += np.bincount(i, wy[j], nx).astype(np.int64)
                far = j if same else j + nx
                count += np.bincount(far, wx[i], total).astype(np.int64)
                points = np.unique(np.concatenate([i, far]))
                label = _labels(len(points), np.searchsorted(points, i), np.searchsorted(points, far))
                ends.append(np.stack([points, points[label]], 1))
        ends = np.concatenate(ends)
        return count, _labels(total, ends[:, 0], ends[:, 1])


def _tiled(nodes: DataFrame, dim: int, n: int, axes: np.ndarray, scratch: Scratch, threshold: float, tile_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """(tiles packed one per row, pairs of tiles whose boxes leave the threshold possible)."""
    rows = tile_rows or int(min(MAX_TILE, max(256, n // 16)))
    wanted = max(1, -(-n // rows))
    few = min(8, dim)
    single = "float" in nodes.schema["vec"].dataType.simpleString()
    store = "f4" if single else "f8"

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = unit(_matrix(b.column(2), "f8")) @ axes[:, :few]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(c), pa.list_(pa.float64()))], ["node", "rows", "vec", "lead"])

    kind = nodes.schema["vec"].dataType.simpleString()
    placed = scratch.save(nodes.select("node", "rows", "vec").mapInArrow(lead, f"node long, rows long, vec {kind}, lead array<double>"), "lead")
    first = F.col("lead")[0]
    edges = placed.agg(F.percentile_approx(first, [k / wanted for k in range(1, wanted)] or [0.5], 10_000)).first()[0] or []
    edges = sorted(set(edges)) if wanted > 1 else []
    # equal first coordinates cannot be cut by range: such a tile is split by a hash of the node
    wide = placed.withColumn("range", F.size(F.filter(F.lit(edges) if edges else F.array().cast("array<double>"), lambda e: e < first)))
    parts = wide.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / (2 * rows)).alias("parts"))
    tiled = wide.join(parts, "range").withColumn("tile", F.concat_ws("-", F.col("range"), F.pmod(F.xxhash64("node"), F.col("parts"))))

    def pack(group: pa.Table) -> pa.Table:
        c = _matrix(group.column("lead"), "f8")
        parts = [group.column("node").to_numpy(), group.column("rows").to_numpy(), _matrix(group.column("vec"), store)]
        return pa.table({"tile": group.column("tile")[:1], "low": pa.array([c.min(0)], pa.list_(pa.float64())), "high": pa.array([c.max(0)], pa.list_(pa.float64())),
                         "size": pa.array([len(c)], pa.int64()), "data": pa.array([b"".join(p.tobytes() for p in parts)], pa.binary())})

    tiles = scratch.save(tiled.select("tile", "node", "rows", "vec", "lead").groupBy("tile").applyInArrow(pack, "tile string, low array<double>, high array<double>, size long, data binary"), "tiles")
    scratch.forget(placed)
    box = tiles.select("tile", "low", "high")
    numbered = scratch.save(box.select(F.row_number().over(Window.orderBy("tile")).alias("no"), "*"), "boxes")  # a row per tile, not per vector
    count = numbered.count()
    other = numbered.select(*[F.col(c).alias(f"{c}_b") for c in numbered.columns])
    gap = F.aggregate(F.zip_with(F.zip_with("low", "high_b", lambda a, b: a - b), F.zip_with("low_b", "high", lambda a, b: a - b), lambda p, q: F.greatest(p, q, F.lit(0.0))), F.lit(0.0), lambda t, g: t + g * g)
    pairs = numbered.select("*", F.explode(F.sequence(F.col("no"), F.lit(max(1, count)))).alias("no_b")).join(other, "no_b")
    return tiles, scratch.save(pairs.where(1 - gap / 2 >= threshold - SLACK).select(F.col("tile").alias("x"), F.col("tile_b").alias("y")), "pairs")



def cosine_links(nodes: DataFrame, dim: int, n: int, scratch: Scratch, threshold: float, tile_rows: int | None = None) -> DataFrame:
    """(node, links, peer) rows of `nodes` (node, rows, vec of `dim` finite components): per pair of tiles, the linked rows there and one node of
    the same component. Sums of links over a node are its links; (node, peer) spans the components."""
    axes, left = principal_axes(nodes, dim)
    tiles, pairs = _tiled(nodes, dim, n, axes, scratch, threshold, tile_rows)
    store = "f4" if "float" in nodes.schema["vec"].dataType.simpleString() else "f8"
    comparer = Comparer(axes, left, threshold)
    width = np.dtype(store).itemsize

    def unpack(size: int, data: bytes) -> tuple:
        return (np.frombuffer(data, "i8", size), np.frombuffer(data, "i8", size, 8 * size),
                np.frombuffer(data, store, size * dim, 16 * size).reshape(size, dim))

    def compare(group: pa.Table) -> pa.Table:
        sides = {s: unpack(n, d) for s, n, d in zip(*(group.column(c).to_pylist() for c in ("side", "size", "data")))}
        same = 1 not in sides
        x = sides[0]
        y = x if same else sides[1]
        px = comparer.prepare(x[2])
        count, label = comparer.links(px, px if same else comparer.prepare(y[2]), x[1], y[1], same)
        ids = x[0] if same else np.concatenate([x[0], y[0]])
        hit = np.flatnonzero(count)
        return pa.table({"node": ids[hit], "links": count[hit], "peer": ids[label[hit]]})

    left_side = pairs.join(tiles, F.col("x") == F.col("tile")).select("x", "y", F.lit(0).alias("side"), "size", "data")
    right_side = pairs.where("x <> y").join(tiles, F.col("y") == F.col("tile")).select("x", "y", F.lit(1).alias("side"), "size", "data")
    return left_side.unionAll(right_side).groupBy("x", "y").applyInArrow(compare, "node long, links long, peer long")


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tile_rows: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links at cosine >= threshold, components named by their smallest id.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of unlike length do not link. Equal
    vectors are compared once and counted as often as they occur, so copies of any number cost one row. Ids may repeat; a row with a null id
    takes part, but is not kept. An empty table gives an empty result; other columns are not looked at."""
    scratch = Scratch(vectors.sparkSession, "cosine")
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    vec = F.col(vec_col).cast(f"array<{kind}>")
    fine = F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(vec, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, vec).alias("vec"))
    nodes = scratch.save(rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
                         .withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = None
    for d in nodes.groupBy(F.size("vec").alias("dim")).count().collect():     # one row per length of vectors
        own = cosine_links(nodes.where(F.size("vec") == d["dim"]), d["dim"], d["count"], scratch, threshold, tile_rows)
        own = scratch.save(own, "links")
        found = own if found is None else found.unionAll(own)
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    parts = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")), scratch)
    tagged = nodes.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = tagged.groupBy("root").agg(F.min("first").alias("component"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = tagged.join(best, "root").join(sums, "node", "left").select("vec", "component", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = rows.join(scratch.save(named, "named"), "vec", "left")
    component = F.when(F.col("vec").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


@query("op1_embedding_neardup")
def op1_embedding_neardup(spark, sf):
    """One row per vector of embeddings: links at cosine >= 0.9, component, and whether it stays."""
    out = embedding_groups(table(spark, sf, "embeddings"), 0.9)
    return out.withColumnRenamed("id", "vec_id")
