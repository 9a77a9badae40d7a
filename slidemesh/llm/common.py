"""Shared by the operators of this folder: table access, written intermediate tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidemesh.runtime import ensure_checkpoint_dir, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


class Scratch:
    """Tables of one operator run below spark.checkpoint.dir. `save` cuts lineage, `forget` deletes what no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, label: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{label}{self.n}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def forget(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in (getattr(x, "_scratch_path", None) for x in frames):
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


BROADCAST_ROWS = 1_000_000


def small_or_shuffled(table_: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few numbers per row, marked for broadcast while it has at most `most` rows; beyond that Spark shuffles both sides.
    Joined this way, texts stay in their scan when few of them are concerned."""
    return F.broadcast(table_) if table_.count() <= most else table_


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected `edges` (a, b) of one orderable type: (node, root) of every node but the roots, which are the smallest
    nodes of their components.

    Alternating large-star and small-star steps: each step hangs neighbours on the smallest one, so the edge set shrinks to stars in
    about log(n) rounds. A hub's neighbours are never gathered: the minimum is a map-side combined aggregate and the join that spreads
    it can be split by key. Rounds end when the edge set no longer changes (count and two checksums of the written table).
    Null ends and self loops are ignored."""
    cur = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours of a go to the smallest node around a
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.save(large, "large")
        # small star: smaller neighbours of a, and a itself, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.save(small, "small")
        scratch.forget(large, cur)
        cur = new
        sign = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if sign == last:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = sign
