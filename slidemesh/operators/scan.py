"""Ordered scans inside a key (row positions, running sums, last value seen) that do not put a hot key into one task.

Ordinary keys use a plain window. Keys above `limit` rows are range-partitioned on (key, order), scanned per slice, and
the slice totals (a few rows per key) are carried over in a second, small window. Both give the same numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidemesh.runtime import cut, key_sizes, split_hot, spread

HOT_ROWS = 200_000


def _order_cols(order: list[str]) -> list[Column]:
    """'-x' sorts x downwards."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """Add running sums (inclusive) and last non-null values in `order` per `keys`. `order` must be total."""
    sums, lasts = sums or {}, lasts or {}
    rows, most = key_sizes(df, keys, limit)
    cold, hot = split_hot(df, keys, limit) if most > limit else (df, None)
    upto = (Window.unboundedPreceding, Window.currentRow)

    def apply(part: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*_order_cols(order)).rowsBetween(*upto)
        return part.withColumns({**{n: F.sum(c).over(w) for n, c in sums.items()},
                                 **{n: F.last(c, ignorenulls=True).over(w) for n, c in lasts.items()}})

    out = apply(spread(cold, keys, rows), keys)
    if hot is None:
        return out
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut(hot.repartitionByRange(n, *[F.col(k) for k in keys], *_order_cols(order)).withColumn("_slice", F.spark_partition_id()))
    local = apply(sliced, [*keys, "_slice"])
    w_end = Window.partitionBy(*keys, "_slice").orderBy(*_order_cols(order))
    names = [*sums, *lasts]
    ends = (local.withColumn("_rn", F.row_number().over(w_end)).groupBy(*keys, "_slice")
            .agg(F.max_by(F.struct(*names), "_rn").alias("_e")))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_slice",
                        *[F.sum(f"_e.{s}").over(before).alias(f"_c_{s}") for s in sums],
                        *[F.last(f"_e.{s}", ignorenulls=True).over(before).alias(f"_c_{s}") for s in lasts])
    fixed = local.join(carry, [*keys, "_slice"])
    fixed = fixed.withColumns({**{s: F.col(s) + F.coalesce(F.col(f"_c_{s}"), F.col(s) - F.col(s)) for s in sums},
                               **{s: F.coalesce(F.col(s), F.col(f"_c_{s}")) for s in lasts}})
    return out.unionByName(fixed.select(*out.columns))


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", start: int = 0, limit: int = HOT_ROWS) -> DataFrame:
    """0-based row position per key (row_number that survives a hot key)."""
    out = running(df, keys, order, sums={name: F.lit(1).cast("long")}, limit=limit)
    return out.withColumn(name, F.col(name) - 1 + start)


def next_row(df: DataFrame, keys: list[str], order: list[str], cols: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """Values of the following row in `order`, as columns next_<col>."""
    cold, hot = split_hot(df, keys, limit)
    w = Window.partitionBy(*keys).orderBy(*_order_cols(order))
    out = cold.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols})
    if hot is None:
        return out
    at = cut(positions(hot, keys, order, "_at", limit=limit))
    follow = at.select(*keys, (F.col("_at") - 1).alias("_at"), *[F.col(c).alias(f"next_{c}") for c in cols])
    return out.unionByName(at.join(follow, [*keys, "_at"], "left").drop("_at"))


def dense_ids(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Dense 0..n-1 relabelling of `value` per key, through the distinct values only."""
    ids = positions(df.select(*keys, value).where(F.col(value).isNotNull()).distinct(), keys, [value], name)
    return df.join(ids, [*keys, value], "left")


def top_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First n rows per key; Spark's window group limit trims each map task to n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_order_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
