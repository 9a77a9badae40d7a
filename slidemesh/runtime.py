"""Session settings, lineage cuts and hot-key detection shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "slidemesh", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume; on a cluster the submitted conf wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = (b.master(master).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (b.config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application: Python kernels then run wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "slidemesh.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in (x for x in names if x.endswith(".py")):
                z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; fall back to a local one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(named)
    return named


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store; errors of the store are raised."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it back: lineage ends, executor loss is harmless, and the planner
    then knows the true size, so that it broadcasts the result only when it is small."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/slidemesh-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys with more than `limit` rows, or None. The count is combined map-side, so a hot key costs nothing extra."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)
    return None if big.isEmpty() else cut(big)


ROWS_A_TASK = 100_000      # rows of a keyed table that one task holds; what operators make of a row may be a hundred times its size


def key_sizes(df: DataFrame, keys: list[str], limit: int) -> tuple[int, int]:
    """(rows of the keys with up to `limit` rows, rows of the largest key) in one job, combined map-side."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = per.agg(F.sum(F.when(F.col("_n") <= limit, F.col("_n"))).alias("rows"), F.max("_n").alias("most")).first()
    return r["rows"] or 0, r["most"] or 0


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """`df` in hash partitions by key whose number follows its rows. Operators on the same keys then work inside these partitions, so
    that a task's memory stays the same however large the table is. Tables of a few tasks are left to the planner."""
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *[F.col(k) for k in keys]) if n > df.sparkSession.sparkContext.defaultParallelism else df


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None); together they are exactly `df`."""
    big = hot_keys(df, keys, limit)
    if big is None:
        return df, None
    return df.join(big, keys, "left_anti"), df.join(big, keys, "left_semi")
