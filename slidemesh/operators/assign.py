"""One-to-one assignment of two sides by highest total value, per key.

Only pairs of positive value are needed: a zero pair adds nothing to the total. Pairs that compete with no other pair are
settled in the JVM; contested ones go to a small numpy solver that runs over sorted partitions, many keys per batch. A key
with very many contested pairs is first broken into connected components, which are independent of each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from slidemesh.runtime import cut, split_hot

HOT_PAIRS = 20_000


def solve(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Indices of the pairs chosen by a maximum-total assignment (shortest augmenting paths with potentials)."""
    if (rows == rows[0]).all() or (cols == cols[0]).all():
        return np.array([np.argmax(values)], dtype=np.int64)     # one against many: the best, the first one on ties
    ru, ri = np.unique(rows, return_inverse=True)
    cu, ci = np.unique(cols, return_inverse=True)
    flip = len(ru) > len(cu)
    if flip:
        ri, ci, ru, cu = ci, ri, cu, ru
    n, m = len(ru), len(cu)
    gain = np.zeros((n, m))
    gain[ri, ci] = values
    where = np.full((n, m), -1, dtype=np.int64)
    where[ri, ci] = np.arange(len(values))
    cost = gain.max() - gain
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist = cost[start] - u[start] - v
        prev = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row_dist = {start: 0.0}
        while True:
            j = int(np.where(done, np.inf, dist).argmin())
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            row_dist[i] = dist[j]
            alt = dist[j] + cost[i] - u[i] - v
            better = ~done & (alt < dist)
            dist[better] = alt[better]
            prev[better] = j
        end = dist[j]
        for i, d in row_dist.items():
            u[i] += end - d
        v[done] -= end - dist[done]
        while j >= 0:
            p = int(prev[j])
            owner[j] = owner[p] if p >= 0 else start
            j = p
    picked = [where[i, j] for j, i in enumerate(owner) if i >= 0]
    return np.array(sorted(k for k in picked if k >= 0), dtype=np.int64)


def per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Walk every key's rows in order: `fn` gets plain lists of `columns` and returns tuples of the columns after the keys.

    Rows are hashed by key and sorted; many keys share a Python batch and one output frame. Only for keys of bounded size;
    callers split larger ones off first."""
    names, made = list(keys), to_arrow_schema(StructType.fromDDL(schema))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    full = ", ".join([*[f"`{k}` {types[k]}" for k in names], schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_batches(batches, names):
            lists = [rows.column(c).to_numpy(zero_copy_only=False).tolist() for c in columns]
            got = [fn(*[v[a:b] for v in lists]) for a, b in zip(starts, starts[1:])]
            out = [row for g in got for row in g]
            if out:
                at = pa.array(np.repeat(starts[:-1], [len(g) for g in got]))
                yield pa.RecordBatch.from_arrays([*[rows.column(k).take(at) for k in names], *[pa.array(v, t, from_pandas=True) for v, t in zip(zip(*out), made.types)]], [*names, *made.names])

    return _by_key(df, keys, order).mapInArrow(run, full)


def choose_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fn: Callable[..., np.ndarray]) -> DataFrame:
    """Like per_key for kernels that only pick rows: `fn` gets plain arrays of `columns` and returns positions to keep."""
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _whole_groups(batches, names):
            arrays = [pdf[c].to_numpy() for c in columns]
            picked = [a + fn(*[v[a:b] for v in arrays]) for a, b in zip(starts, starts[1:])]
            yield pdf.iloc[np.concatenate(picked)]

    return _by_key(df, keys, order).mapInPandas(run, df.schema)


def _by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Hash partitions in a stated number: Python work is not proportional to bytes, so small partitions stay apart."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)


def _whole_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """_whole_groups for Arrow batches."""
    tail: pa.RecordBatch | None = None
    for b in batches:
        if tail is not None:
            b = pa.concat_batches([tail, b])
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in names:
            v = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            change |= v[1:] != v[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change) + 1))
        last = int(starts[-1])
        tail = b.slice(last)
        if last:
            yield b.slice(0, last), starts
    if tail is not None and tail.num_rows:
        yield tail, np.array([0, tail.num_rows])


def _whole_groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Re-cut Arrow batches at key changes: (rows, group starts and end); the last group waits for the next batch."""
    def starts_of(pdf: pd.DataFrame) -> np.ndarray:
        ident = pdf[names]
        return np.flatnonzero((ident != ident.shift()).any(axis=1).to_numpy())

    tail: pd.DataFrame | None = None
    for pdf in batches:
        if tail is not None:
            pdf = pd.concat([tail, pdf], ignore_index=True)
        if not len(pdf):
            continue
        starts = starts_of(pdf)
        last = int(starts[-1])
        tail = pdf.iloc[last:]
        if last:
            yield pdf.iloc[:last], [int(v) for v in starts]
    if tail is not None and len(tail):
        yield tail.reset_index(drop=True), [0, len(tail)]


def components_of(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Label the connected components of the bipartite pairs (keys, r, c, ...): adds `comp`, the smallest row id reached.

    Labels spread along pairs and jump to the label of their label, so rounds grow with the log of the diameter."""
    label = cut(pairs.groupBy(*keys, "r").agg(F.min("r").alias("comp")))
    while True:
        by_col = pairs.join(label, [*keys, "r"]).groupBy(*keys, "c").agg(F.min("comp").alias("_m"))
        near = pairs.join(by_col, [*keys, "c"]).groupBy(*keys, "r").agg(F.min("_m").alias("_m"))
        jump = label.select(*keys, F.col("r").alias("_m"), F.col("comp").alias("_j"))
        new = cut(label.join(near, [*keys, "r"]).join(jump, [*keys, "_m"], "left")
                  .select(*keys, "r", F.least("comp", "_m", "_j").alias("comp2"), "comp"))
        moved = new.where("comp2 <> comp").limit(1).count()
        label = new.select(*keys, "r", F.col("comp2").alias("comp"))
        if not moved:
            return pairs.join(label, [*keys, "r"])


def best_assignment(pairs: DataFrame, keys: list[str], limit: int = HOT_PAIRS) -> DataFrame:
    """Chosen pairs (keys, r, c, value, sim) of positive-value pairs (keys, r, c, value, sim).

    r and c are longs. `value` drives the choice, `sim` is carried along."""
    cols = [*keys, "r", "c", "value", "sim"]
    # tested after the cut: pushed into the join of the pairs, IoU makes its loop too large a method for the JVM to compile
    base = cut(pairs.select(*cols)).where("value > 0")
    deg_r = base.groupBy(*keys, "r").agg(F.count(F.lit(1)).alias("_dr"))
    deg_c = base.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("_dc"))
    tagged = base.join(deg_r, [*keys, "r"]).join(deg_c, [*keys, "c"])
    free = tagged.where("_dr = 1 and _dc = 1").select(*cols)
    contested = tagged.where("_dr > 1 or _dc > 1").select(*cols)
    cold, hot = split_hot(contested, keys, limit)
    rcv = ["r", "c", "value"]
    out = free.unionByName(choose_per_key(cold, keys, ["r", "c"], rcv, solve))
    if hot is not None:
        parts = components_of(cut(hot), keys)
        out = out.unionByName(choose_per_key(parts, [*keys, "comp"], ["r", "c"], rcv, solve).select(*cols))
    return out


def pairwise_max(pairs: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """Best pair per `side` by `value`, ties to the smaller other id; a hash aggregate, no sort."""
    other = "c" if side == "r" else "r"
    return pairs.groupBy(*keys, side).agg(F.max_by(other, F.struct(F.col(value), -F.col(other))).alias(other), F.max(value).alias(value))
