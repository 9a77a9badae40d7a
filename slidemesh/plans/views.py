"""Component-shaped views over the given tables, so that every operator runs on their whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidemesh.operators.scan import positions
from slidemesh.runtime import ship


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def components(spark: SparkSession, sf: str) -> DataFrame:
    """One slide per order, one box per order line; six columns make the order total."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = table(spark, sf, "lineitem").select("l_orderkey", *order, "l_returnflag", "l_linestatus")
    t = positions(li, ["l_orderkey"], order)
    return t.selectExpr(
        "l_orderkey AS slide_id", "pos", "concat(cast(l_orderkey AS string), '/c', cast(pos AS string)) AS node_id",
        "concat(l_returnflag, l_linestatus) AS label", "(l_partkey * 7919 + l_linenumber) % 10007 AS score",
        "l_linenumber % 3 AS iter_idx", "(l_suppkey + l_linenumber) % 5 AS z_index",
        "(l_partkey * 37) % 400 AS x0", "(l_partkey * 17) % 250 AS y0",
        "(l_partkey * 37) % 400 + 60 + (l_suppkey * 53 + l_linenumber * 29) % 500 AS x1",
        "(l_partkey * 17) % 250 + 40 + (l_linenumber * 61 + l_partkey) % 260 AS y1",
        "(60 + (l_suppkey * 53 + l_linenumber * 29) % 500) * (40 + (l_linenumber * 61 + l_partkey) % 260) AS area",
        "l_linenumber % 2 = 0 AS is_text_only")


def native_objects(comps: DataFrame) -> DataFrame:
    return comps.where("pos % 2 = 0").selectExpr(
        "slide_id", "pos", "x0 + (pos * 4) % 13 AS x0", "y0", "x1 + (pos * 4) % 13 AS x1", "y1",
        "concat('shape', cast(pos % 4 AS string)) AS shape_type")


def ground_truth(comps: DataFrame) -> DataFrame:
    return comps.selectExpr("slide_id AS image_id", "pos AS gt_id", "label", "x0", "y0", "x1", "y1", "pos = 3 AS iscrowd")


def detections(comps: DataFrame) -> DataFrame:
    return comps.where("(slide_id + pos) % 5 <> 0").selectExpr(
        "slide_id AS image_id", "pos AS dt_id", "label", "score", "x0 + (score % 5) * 9 AS x0", "y0 + (score % 3) * 7 AS y0",
        "x1 + (score % 5) * 9 AS x1", "y1 + (score % 3) * 7 AS y1")


def track_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Video = user, frame = running event number of the user, track = event type."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    t = positions(ev, ["user_id"], ["ts", "event_id"], "frame_idx")
    return t.selectExpr(
        "user_id AS video_id", "event_type AS track", "frame_idx", "(frame_idx * 3 + length(event_type) * 40) % 300 AS x0",
        "length(event_type) * 11 AS y0", "(frame_idx * 3 + length(event_type) * 40) % 300 + 50 AS x1",
        "length(event_type) * 11 + 40 AS y1", "event_id % 4 <> 0 AS matched")


def usage_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS line_no", "ts", "CASE event_type WHEN 'signup' THEN 'slide_start' WHEN 'error' THEN 'slide_end' END AS marker",
        "CASE WHEN event_type IN ('signup', 'error') THEN concat('img', cast(user_id AS string)) END AS image",
        "CASE WHEN event_type NOT IN ('signup', 'error') THEN concat('agent_', event_type) END AS agent",
        "CASE WHEN event_type NOT IN ('signup', 'error') AND event_id % 11 <> 0 THEN 'vlm' END AS backend",
        "event_id % 977 AS input_tokens", "event_id % 131 AS output_tokens", "(event_id * 13) % 5000 AS latency_ms")


def text_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS run_id", "p_size AS page", "(p_partkey * 73) % 256 AS fg_r", "(p_partkey * 151) % 256 AS fg_g",
        "(p_partkey * 199) % 256 AS fg_b", "(p_partkey * 11) % 256 AS bg_r", "(p_partkey * 29) % 256 AS bg_g", "(p_partkey * 83) % 256 AS bg_b")


def page_words(spark: SparkSession, sf: str) -> DataFrame:
    """(page, word, side) from documents: original text, and a render that lost words of length divisible by seven."""
    from slidemesh.functions.text import words
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.explode(words(F.col("text"))).alias("word"))
    both = F.when(F.length("word") % 7 == 0, F.array(F.lit("orig"))).otherwise(F.array(F.lit("orig"), F.lit("render")))
    return docs.withColumn("side", F.explode(both))
