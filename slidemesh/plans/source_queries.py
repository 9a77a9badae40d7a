"""Readers and set operators: the given tables written in a source's own layout and read back, and image and video sets joined and reshaped."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slidemesh.plans import views as V
from slidemesh.plans.registry import query, sql
from slidemesh.runtime import ensure_checkpoint_dir
from slidemesh.sources import coco, runs

BUCKETS = 16            # files of a written set, at least
FILE_ROWS = 50_000      # boxes of one file: a file is one document, built and parsed whole by one task


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def _set(spark, sf):
    """Slides as images, ground truth as annotations, the first letter of a label as its category."""
    g = V.ground_truth(V.components(spark, sf))
    images = g.select(F.col("image_id").alias("id")).distinct().selectExpr(
        "id", "1000 AS width", "600 AS height", "concat('s', id, '.png') AS file_name", "id % 3 <> 0 AS is_instance_exhaustive", "concat('phrase ', id % 50) AS text_input")
    ann = g.selectExpr("image_id * 1000 + gt_id AS id", "image_id", "ascii(label) AS category_id", "array(x0, y0, x1 - x0, y1 - y0) AS bbox", "(x1 - x0) * (y1 - y0) AS area", "int(iscrowd) AS iscrowd")
    ann = ann.withColumns({"bbox": F.col("bbox").cast("array<double>"), "area": F.col("area").cast("double")})
    return images, ann, g.selectExpr("ascii(label) AS id", "substr(label, 1, 1) AS name").distinct()


def _one_file_each(rows, key, value, name, n):
    """(_b, name): the rows' structs as one array per file. An image goes to one file, but for each further FILE_ROWS of its rows to another."""
    part = F.pmod(F.xxhash64(key, F.expr(f"{value} div {FILE_ROWS}")), F.lit(n)).cast("int")
    cols = [c for c in rows.columns if c != "_k"]
    return rows.withColumn("_b", part).repartition(n, "_b").groupBy("_b").agg(F.collect_list(F.struct(*cols)).alias(name))


def _files_for(n_rows):
    return max(BUCKETS, -(-n_rows // FILE_ROWS))


@query("coco_set_read", sql("""SELECT image_id, count(*) AS n, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area, max(substr(label, 1, 1)) AS last_name, count(*) FILTER (iscrowd) AS crowds FROM gt GROUP BY 1""", "components", "gt"))
def coco_set_read(spark, sf):
    """A COCO set in files of whole documents, read as three tables and joined again."""
    images, ann, cats = _set(spark, sf)
    cats = cats.agg(F.collect_list(F.struct("id", "name")).alias("categories"))     # a dimension of a few names
    n, path = _files_for(V.table(spark, sf, "lineitem").count()), _folder(spark, "coco")
    a = _one_file_each(ann.withColumn("_k", F.col("id") - F.col("image_id") * 1000), "image_id", "_k", "annotations", n)
    i = _one_file_each(images.withColumn("_k", F.lit(0)), "id", "_k", "images", n)
    # categories make a document of their own
    docs = i.join(a, "_b", "full").drop("_b").unionByName(cats, allowMissingColumns=True)
    docs.write.option("maxRecordsPerFile", 1).json(path)
    images, ann, cats = coco.read_set(spark, path)
    j = ann.join(images.select(F.col("id").alias("image_id"), "width"), "image_id").join(F.broadcast(cats.select(F.col("id").alias("category_id"), "name")), "category_id")
    return j.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bbox")[2] * F.col("bbox")[3]).cast("long").alias("area"), F.max("name").alias("last_name"), F.sum("iscrowd").alias("crowds"))


@query("coco_predictions_read", sql("""SELECT image_id, count(*) AS n, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area, CAST(max(x1) AS BIGINT) AS right_edge, CAST(sum(score) AS BIGINT) AS score FROM dt GROUP BY 1""", "components", "dt"))
def coco_predictions_read(spark, sf):
    """Predictions as files of one JSON array each, read with their corners and areas."""
    d = V.detections(V.components(spark, sf))
    images = d.select(F.col("image_id").alias("id")).distinct()
    rows = d.selectExpr("image_id", "ascii(label) AS category_id", "array(x0, y0, x1 - x0, y1 - y0) AS bbox", "score", "dt_id AS _k")
    path, n = _folder(spark, "predictions"), _files_for(V.table(spark, sf, "lineitem").count())
    _one_file_each(rows, "image_id", "_k", "rows", n).select(F.to_json("rows").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    p = coco.load_results(coco.read_predictions(spark, path), images)
    return p.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("area").cast("long").alias("area"), F.max("x1").cast("long").alias("right_edge"), F.sum("score").cast("long").alias("score"))


@query("usage_log_read", sql("""SELECT agent, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(latency_ms) AS BIGINT) AS latency_ms
 FROM usage_log WHERE agent IS NOT NULL GROUP BY 1""", "usage_log"))
def usage_log_read(spark, sf):
    """The usage log written as JSON lines among lines that are no JSON, read back without them."""
    u = V.usage_log(spark, sf).select("marker", "image", "agent", "input_tokens", "output_tokens", (F.col("latency_ms") / 1000.0).alias("latency_sec"))
    path = _folder(spark, "usage")
    lines = u.select(F.explode(F.array(F.to_json(F.struct(*u.columns)), F.lit("not json"))).alias("value"))
    lines.write.text(path)
    r = runs.read_usage(spark, path).where("agent IS NOT NULL")
    return r.groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("latency_ms").alias("latency_ms"))


@query("image_annotation_lists", sql("""SELECT image_id, count(*) AS n, string_agg(CAST(gt_id AS VARCHAR), ',' ORDER BY gt_id) AS ids FROM gt GROUP BY 1""", "components", "gt"))
def image_annotation_lists(spark, sf):
    images, ann, _ = _set(spark, sf)
    g = coco.group_by_image(images, ann)
    return g.select(F.col("id").alias("image_id"), F.size("annotations").cast("long").alias("n"), F.array_join(F.transform("annotations", lambda a: (a["id"] % 1000).cast("string")), ",").alias("ids"))


@query("normalised_boxes", sql("""SELECT image_id * 1000 + gt_id AS id, round(least(1.0, x0 / CAST(1000 AS DOUBLE)), 9) AS x0, round(least(1.0, y0 / CAST(600 AS DOUBLE)), 9) AS y0, round(least(1.0, x1 / CAST(1000 AS DOUBLE)), 9) AS x1,
 round(least(1.0, y1 / CAST(600 AS DOUBLE)), 9) AS y1 FROM gt""", "components", "gt"))
def normalised_boxes(spark, sf):
    images, ann, _ = _set(spark, sf)
    return coco.normalised_boxes(ann, images).select("id", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("class_chunk_units", sql("""SELECT i.image_id, c.chunk AS chunk_id, c.ids, count(g.image_id) AS n_objects FROM (SELECT DISTINCT image_id FROM gt) i CROSS JOIN
 (SELECT chunk, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM k GROUP BY 1) c LEFT JOIN (SELECT image_id, k.chunk FROM gt JOIN k ON k.id = ascii(gt.label)) g ON g.image_id = i.image_id AND g.chunk = c.chunk GROUP BY ALL""", "components", "gt",
                                extra="k AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 2 AS chunk FROM (SELECT DISTINCT ascii(label) AS id FROM gt) t)"))
def class_chunk_units(spark, sf):
    """Work units of an image and two classes each, with the image's objects of them."""
    images, ann, cats = _set(spark, sf)
    u = coco.class_chunks(images, ann, cats, 2)
    return u.select("image_id", "chunk_id", F.array_join(F.transform("category_ids", lambda c: c.cast("string")), ",").alias("ids"), "n_objects")


@query("phrase_query_rows", sql("""SELECT image_id, concat('phrase ', image_id % 50) AS query_text, image_id % 3 <> 0 AS is_exhaustive, count(*) AS n_objects, min(image_id * 1000 + gt_id) AS first_object FROM gt GROUP BY 1""", "components", "gt"))
def phrase_query_rows(spark, sf):
    images, ann, _ = _set(spark, sf)
    q = coco.phrase_queries(images, ann)
    return q.select("image_id", "query_text", "is_exhaustive", F.size("object_ids").cast("long").alias("n_objects"), F.col("object_ids")[0].alias("first_object"))


@query("frame_image_ids", sql("""SELECT video_id, frame_idx, row_number() OVER (ORDER BY video_id, frame_idx) AS image_id FROM track_frames""", "track_frames"))
def frame_image_ids(spark, sf):
    """Videos with a file name per frame, as images numbered over all of them."""
    t = V.track_frames(spark, sf).groupBy(F.col("video_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("frame_idx").cast("string"), 9, "0"), F.lit(".jpg")))).alias("file_names"))
    return coco.frame_images(t).select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("image_id").cast("long").alias("image_id"))


def _dense_tracks(spark, sf):
    """One row per (video, track) with a box, or none, for every frame of the video."""
    t = V.track_frames(spark, sf).select("video_id", "track", "frame_idx", F.array(*[F.col(c).cast("double") for c in ("x0", "y0")], (F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")).alias("b"))
    n = t.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("frames"))
    m = t.groupBy("video_id", "track").agg(F.map_from_entries(F.collect_list(F.struct("frame_idx", "b"))).alias("m"))
    return m.join(n, "video_id").select("video_id", "track", F.transform(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1), lambda i: F.try_element_at("m", i)).alias("bboxes"))


@query("frame_annotations", sql("""SELECT t.video_id, t.track, t.frame_idx, i.image_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM track_frames t
 JOIN (SELECT video_id, frame_idx, row_number() OVER (ORDER BY video_id, frame_idx) AS image_id FROM track_frames) i ON i.video_id = t.video_id AND i.frame_idx = t.frame_idx""", "track_frames"))
def frame_annotations(spark, sf):
    """Tracks with absent frames, taken apart into annotations of the frames' images."""
    fr = coco.to_frame_annotations(_dense_tracks(spark, sf), frame_image_ids(spark, sf))
    return fr.select("video_id", "track", F.col("frame_idx").cast("long").alias("frame_idx"), "image_id", "x0", "y0", "x1", "y1")


@query("track_mean_areas", sql("""SELECT t.video_id, t.track, CAST(avg((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area, max(f.n) - count(*) AS absent FROM track_frames t JOIN (SELECT video_id, max(frame_idx) + 1 AS n FROM track_frames GROUP BY 1) f ON f.video_id = t.video_id GROUP BY 1, 2""", "track_frames"))
def track_mean_areas(spark, sf):
    d = coco.dense_boxes(_dense_tracks(spark, sf))
    return d.select("video_id", "track", "area", F.size(F.filter("bboxes", lambda b: (b[2] == 0) & (b[3] == 0))).cast("long").alias("absent"))


@query("sizes_filled", sql("""SELECT video_id, track, CASE WHEN bool_or(matched) THEN 720 ELSE 480 + video_id % 3 END AS height, CASE WHEN bool_or(matched) THEN 1280 ELSE 640 END AS width FROM track_frames GROUP BY 1, 2""", "track_frames"))
def sizes_filled(spark, sf):
    """Tracks without a size take their video's."""
    t = V.track_frames(spark, sf).groupBy("video_id", "track").agg(F.bool_or("matched").alias("m"))
    t = t.select("video_id", "track", F.when(F.col("m"), F.lit(720).cast("long")).alias("height"), F.when(F.col("m"), F.lit(1280)).alias("width"))
    v = t.select(F.col("video_id").alias("id")).distinct().select("id", (F.col("id") % 3 + 480).alias("height"), F.lit(640).alias("width"))
    return coco.fill_sizes(t, v).select("video_id", "track", "height", "width")


@query("video_ids_filled", sql("""SELECT event_id AS id, user_id AS video_id FROM events"""))
def video_ids_filled(spark, sf):
    """Annotations without a video take that of their image."""
    e = V.table(spark, sf, "events")
    a = e.select(F.col("event_id").alias("id"), F.col("event_id").alias("image_id"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("video_id"))
    return coco.fill_video_ids(a, e.select(F.col("event_id").alias("id"), F.col("user_id").alias("video_id"))).select("id", "video_id")


@query("categories_merged", sql("""SELECT CASE ascii(label) WHEN 82 THEN 65 ELSE ascii(label) END AS category_id, count(*) AS n FROM gt GROUP BY 1""", "components", "gt"))
def categories_merged(spark, sf):
    m = spark.createDataFrame([(82, 65)], "source int, target int")
    return coco.merge_categories(_set(spark, sf)[1], m).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))


@query("graph_stored", sql("""SELECT slide_id, kind, count(*) AS n, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT slide_id, 'self' AS kind, score AS w FROM components UNION ALL SELECT slide_id, 'next', z_index FROM components) t GROUP BY 1, 2""", "components"))
def graph_stored(spark, sf):
    """Nodes and edges written by kind and read back."""
    c = V.components(spark, sf)
    edges = c.selectExpr("slide_id", "'self' AS kind", "node_id AS src", "node_id AS dst", "score AS weight").unionByName(c.selectExpr("slide_id", "'next' AS kind", "node_id AS src", "node_id AS dst", "cast(z_index AS bigint) AS weight"))
    path = _folder(spark, "graph")
    runs.write_graph(c, edges.withColumn("weight", F.col("weight").cast("long")), path)
    nodes, back = runs.read_graph(spark, path)
    return back.join(nodes.select("slide_id", F.col("node_id").alias("src")), ["slide_id", "src"]).groupBy("slide_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query("resumed_work", sql("""SELECT slide_id, pos FROM components WHERE label <> (SELECT min(label) FROM components)""", "components"))
def resumed_work(spark, sf):
    """Work left when the results of the first label are stored already."""
    c = V.components(spark, sf)
    first = c.agg(F.min("label").alias("label"))
    path = _folder(spark, "results")
    runs.write_results(c.join(F.broadcast(first), "label").select("slide_id", "pos", "label"), path, "label")
    return runs.pending(c.select("slide_id", "pos"), spark, path, ["slide_id", "pos"])
