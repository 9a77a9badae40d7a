"""Streaming forms of the usage log: attribution to the open slide, event-time windows, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slidemesh.operators.usage import calls_of
from slidemesh.runtime import cut, path_exists

ATTRIBUTED = "run string, line_no long, agent string, input_tokens long, output_tokens long, latency_ms long, open_image string"


def _attribute(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current = state.get[0] if state.exists else None
    pdf = pd.concat(list(batches), ignore_index=True).sort_values("line_no", kind="stable")
    rows = []
    for r in pdf.itertuples(index=False):
        if r.marker == "slide_start":
            current = r.image
        elif r.marker == "slide_end":
            current = None if r.image == current else current
        elif r.is_call:
            rows.append((key[0], r.line_no, r.agent, r.input_tokens, r.output_tokens, r.latency_ms, current))
    state.update((current,))
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ATTRIBUTED.split(", ")])


def attribute_stream(log: DataFrame) -> DataFrame:
    """Calls with the slide that is open at their line, per run; lines of a run arrive in order."""
    backend = F.col("backend") if "backend" in log.columns else F.lit("")
    cols = log.select("run", "line_no", "marker", "image", "agent", "input_tokens", "output_tokens", "latency_ms", backend.isNotNull().alias("is_call"))
    return cols.groupBy("run").applyInPandasWithState(_attribute, ATTRIBUTED, "image string", "append", GroupStateTimeout.NoTimeout)


def windowed(log: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Calls and tokens per agent in tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (calls_of(log).withWatermark("ts", late).groupBy(w.alias("w"), "agent")
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens")).select("w.start", "w.end", "agent", "calls", "input_tokens"))


def sessions(log: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return (calls_of(log).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "agent")
            .agg(F.count(F.lit(1)).alias("calls")).select("w.start", "w.end", "agent", "calls"))


BUCKETS = 1024


def ingest_slides(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Upsert finished slides into a component table: a slide sent again replaces its rows.

    The table is partitioned by a hash bucket of the slide, not by slide, so that directories stay few; a micro-batch rewrites
    the buckets it touches. Replaying a batch gives the same table."""
    def upsert(batch: DataFrame, _: int) -> None:
        new = cut(batch.withColumn("bucket", F.pmod(F.xxhash64("slide_id"), F.lit(buckets)).cast("int")))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        merged = new
        if path_exists(spark, path):
            old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
            merged = cut(old.join(new.select("slide_id").distinct(), "slide_id", "left_anti").select(*new.columns).unionByName(new))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
