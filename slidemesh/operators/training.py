"""Filters and samplers over query tables of training data.

queries: datapoint, query_id, query_text, image_id, is_exhaustive, is_pixel_exhaustive, has_input_bbox, n_out; query_objects:
datapoint, query_id, image_id, object_id; objects: datapoint, image_id, object_id, area, is_crowd, box. A filter is a
function of these tables that returns the query keys to drop, so that user filters plug in the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.operators.scan import positions

Q = ["datapoint", "query_id"]
O = ["datapoint", "image_id", "object_id"]  # noqa: E741


def by_text(queries: DataFrame, texts: list[str]) -> DataFrame:
    return queries.where(F.col("query_text").isin(texts)).select(*Q)


def geometric(queries: DataFrame) -> DataFrame:
    return queries.where("has_input_bbox").select(*Q)


def zero_box(query_objects: DataFrame, objects: DataFrame) -> DataFrame:
    """Queries that predict an object without width or height."""
    flat = objects.where((F.col("x1") == F.col("x0")) | (F.col("y1") == F.col("y0"))).select(*O)
    return query_objects.join(flat, O, "left_semi").select(*Q).distinct()


def too_many_outputs(queries: DataFrame, n: int) -> DataFrame:
    return queries.where(F.col("n_out") > n).select(*Q)


def non_exhaustive(queries: DataFrame, kind: str) -> DataFrame:
    """'instance': the flag must be true; 'pixel': an unknown flag is kept."""
    bad = ~F.coalesce("is_exhaustive", F.lit(False)) if kind == "instance" else F.coalesce(~F.col("is_pixel_exhaustive"), F.lit(False))
    return queries.where(bad).select(*Q)


def empty_geometric(queries: DataFrame) -> DataFrame:
    return queries.where("has_input_bbox AND query_text = 'geometric' AND n_out = 0").select(*Q)


def crowd_objects(objects: DataFrame) -> DataFrame:
    return objects.where("is_crowd").select(*O)


def empty_objects(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("area") < 1e-6).select(*O)


def apply_filter(queries: DataFrame, query_objects: DataFrame, objects: DataFrame, drop_queries: DataFrame | None = None,
                 drop_objects: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove, then renumber what is left from 0 per datapoint (queries) and per image (objects); references follow: those of
    removed rows find no partner when they are renumbered."""
    if drop_queries is not None:
        queries = queries.join(drop_queries, Q, "left_anti")
    if drop_objects is not None:
        objects = objects.join(drop_objects, O, "left_anti")
    q = positions(queries, ["datapoint"], ["query_id"], "_q")
    o = positions(objects, ["datapoint", "image_id"], ["object_id"], "_o")
    links = (query_objects.join(q.select(*Q, "_q"), Q).join(o.select(*O, "_o"), O)
             .select("datapoint", F.col("_q").alias("query_id"), "image_id", F.col("_o").alias("object_id")))
    n = query_objects.join(objects.select(*O), O).groupBy(*Q).agg(F.count(F.lit(1)).alias("n_out"))     # no link needs its new numbers for that
    qs = q.drop("n_out").join(n, Q, "left").drop("query_id").withColumnRenamed("_q", "query_id").fillna(0, ["n_out"])
    return qs, links, o.drop("object_id").withColumnRenamed("_o", "object_id")


def keep_max_queries(queries: DataFrame, n: int, positives_first: bool = False, seed: int = 0) -> DataFrame:
    """At most n queries per datapoint, drawn by a seeded hash of the key (stable under retries)."""
    r = F.xxhash64(F.lit(seed), *Q)
    order = (["_neg"] if positives_first else []) + ["_r", "query_id"]
    d = queries.withColumns({"_r": r, "_neg": (F.col("n_out") == 0).cast("int")})
    return positions(d, ["datapoint"], order, "_k").where(F.col("_k") < n).drop("_k", "_r", "_neg")


def keep_max_queries_video(queries: DataFrame, n: int, positives_first: bool = False, seed: int = 0) -> DataFrame:
    """The choice is made on frame 0 and its positions apply to every frame of the datapoint."""
    at = positions(queries, ["datapoint", "image_id"], ["query_id"], "_at")
    over = at.where(F.col("_at") >= n).select("datapoint").distinct()
    first = keep_max_queries(at.where("image_id = 0"), n, positives_first, seed).select("datapoint", "_at")
    whole = at.join(over, "datapoint", "left_anti")
    cutdown = at.join(over, "datapoint", "left_semi").join(first, ["datapoint", "_at"], "left_semi")
    return whole.unionByName(cutdown).drop("_at")


def deterministic_sample(ids: DataFrame, ident: str, n: int) -> DataFrame:
    """n ids in the order of a hash seeded with n (not the draw of another generator)."""
    return ids.orderBy(F.xxhash64(F.lit(n), ident), ident).limit(n)


def decorate_text(queries: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    return queries.withColumn("query_text", F.concat(F.lit(prefix), "query_text", F.lit(suffix)))


def _draw(seed: int) -> Column:
    """Uniform number in [0, 1) that depends on the key only."""
    return F.pmod(F.xxhash64(F.lit(seed), *Q), F.lit(1_000_000)) / 1_000_000


def overwrite_text(queries: DataFrame, text: str, probability: float = 1.0, seed: int = 0) -> DataFrame:
    return queries.withColumn("query_text", F.when(_draw(seed) < probability, F.lit(text)).otherwise(F.col("query_text")))


def text_to_visual(queries: DataFrame, probability: float, seed: int = 0) -> DataFrame:
    """Some text queries that have a box become visual ones."""
    return overwrite_text(queries.where("has_input_bbox"), "visual", probability, seed).unionByName(queries.where("NOT has_input_bbox"))


def remove_input_boxes(queries: DataFrame) -> DataFrame:
    return queries.withColumn("has_input_bbox", F.lit(False))


def sample_stages(queries: DataFrame, n: int, stride: int, seed: int = 0, reverse: bool = False) -> DataFrame:
    """n stages of each video, `stride` apart from a hashed start, renumbered from 0 (backwards when reversed).

    queries: datapoint, stage, ...; stages are counted through their distinct values."""
    st = positions(queries.select("datapoint", "stage").distinct(), ["datapoint"], ["stage"], "_k")
    size = st.groupBy("datapoint").agg(F.count(F.lit(1)).alias("_n"))
    room = F.greatest(F.lit(1), F.col("_n") - (n - 1) * stride)
    chosen = (st.join(size, "datapoint").withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "datapoint"), room))
              .where((F.col("_k") >= F.col("_b")) & ((F.col("_k") - F.col("_b")) % stride == 0) & (F.col("_k") - F.col("_b") < n * stride))
              .withColumn("new_stage", ((F.col("_k") - F.col("_b")) / stride).cast("long")))
    if reverse:
        top = chosen.groupBy("datapoint").agg(F.max("new_stage").alias("_t"))
        chosen = chosen.join(top, "datapoint").withColumn("new_stage", F.col("_t") - F.col("new_stage"))
    return queries.join(chosen.select("datapoint", "stage", "new_stage"), ["datapoint", "stage"]).drop("stage").withColumnRenamed("new_stage", "stage")


def uneven_stages(queries: DataFrame) -> DataFrame:
    """Datapoints whose stages do not all hold the same number of queries (must be empty)."""
    per = queries.groupBy("datapoint", "stage").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("datapoint").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo <> hi").select("datapoint")


def clamp_boxes(objects: DataFrame, images: DataFrame) -> DataFrame:
    im = images.select("datapoint", "image_id", "width", "height")
    j = objects.join(im, ["datapoint", "image_id"])
    lim = {"x0": "width", "x1": "width", "y0": "height", "y1": "height"}
    return j.withColumns({c: F.greatest(F.lit(0), F.least(F.col(m), F.col(c))) for c, m in lim.items()}).drop("width", "height")
