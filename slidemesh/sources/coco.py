"""COCO-style image sets, predictions and video sets as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.operators.scan import dense_ids, positions

IMAGES = "id BIGINT, width INT, height INT, file_name STRING, is_instance_exhaustive BOOLEAN, text_input STRING"
ANNOTATIONS = "id BIGINT, image_id BIGINT, category_id INT, bbox ARRAY<DOUBLE>, area DOUBLE, iscrowd INT"
CATEGORIES = "id INT, name STRING"
PREDICTIONS = "image_id BIGINT, category_id INT, bbox ARRAY<DOUBLE>, score DOUBLE"


def _struct(ddl: str) -> str:
    return "STRUCT<" + ", ".join(p.replace(" ", ": ", 1) for p in ddl.split(", ")) + ">"


def read_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of JSON files in the usual layout."""
    schema = f"images ARRAY<{_struct(IMAGES)}>, annotations ARRAY<{_struct(ANNOTATIONS)}>, categories ARRAY<{_struct(CATEGORIES)}>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return tuple(raw.select(F.inline(c)) for c in ("images", "annotations", "categories"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).option("multiLine", True).json(path)


def group_by_image(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image with its annotations in id order; images without any keep an empty array."""
    a = annotations.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "category_id", "bbox", "area", "iscrowd"))).alias("annotations"))
    empty = F.array().cast(a.schema["annotations"].dataType)
    return images.join(a, "id", "left").withColumn("annotations", F.coalesce("annotations", empty))


def load_results(preds: DataFrame, images: DataFrame) -> DataFrame:
    """Predictions with ids, area and box corners derived; fails on unknown images."""
    unknown = preds.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti").limit(1).count()
    if unknown:
        raise ValueError("predictions name images that the set does not have")
    b = B.box_of_xywh(F.col("bbox"))
    return preds.select("*", *[c.alias(n) for c, n in zip(b, ("x0", "y0", "x1", "y1"))], (F.col("bbox")[2] * F.col("bbox")[3]).alias("area"), F.lit(0).alias("iscrowd"))


def with_ids(preds: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Running ids from 1 in a stated order, by the distributed scan."""
    return positions(preds.withColumn("_g", F.lit(0)), ["_g"], order, name, start=1).drop("_g")


def shift_to_one_based(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add one to ids of a table that uses 0, and to the foreign keys pointing at it."""
    def off(df):
        return df.agg(F.max((F.col("id") == 0).cast("int")).alias("o")).select(F.coalesce("o", F.lit(0)).alias("o"))

    oi, oc, oa = off(images), off(categories), off(annotations)
    ann = (annotations.crossJoin(F.broadcast(oi.withColumnRenamed("o", "oi"))).crossJoin(F.broadcast(oc.withColumnRenamed("o", "oc")))
           .crossJoin(F.broadcast(oa.withColumnRenamed("o", "oa"))))  # one-row sides
    ann = ann.withColumns({"id": F.col("id") + F.col("oa"), "image_id": F.col("image_id") + F.col("oi"), "category_id": F.col("category_id") + F.col("oc")}).drop("oi", "oc", "oa")
    def shift(df, o):
        return df.crossJoin(F.broadcast(o)).withColumn("id", F.col("id") + F.col("o")).drop("o")
    return shift(images, oi), shift(categories, oc), ann


def normalised_boxes(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """xywh boxes as corners in [0, 1]."""
    b = B.normalise(B.box_of_xywh(F.col("bbox")), F.col("width"), F.col("height"))
    im = images.select(F.col("id").alias("image_id"), "width", "height")
    return annotations.join(im, "image_id").select("id", "image_id", "category_id", *[F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)).alias(n) for c, n in zip(b, ("x0", "y0", "x1", "y1"))])


def class_chunks(images: DataFrame, annotations: DataFrame, categories: DataFrame, chunk: int, include_negatives: bool = True) -> DataFrame:
    """Work units (image_id, chunk_id, category_ids, n_objects): classes in id order cut in chunks, per image.

    Without negatives only chunks the image has annotations for; then nothing is crossed, the chunk comes from the annotation."""
    c = positions(categories.withColumn("_g", F.lit(0)), ["_g"], ["id"], "_p").withColumn("chunk_id", F.floor(F.col("_p") / chunk)).select(F.col("id").alias("category_id"), "chunk_id")
    sets = c.groupBy("chunk_id").agg(F.array_sort(F.collect_list("category_id")).alias("category_ids"))
    n = annotations.join(c, "category_id").groupBy("image_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_objects"))
    if not include_negatives:
        return n.join(sets, "chunk_id")
    packed = sets.agg(F.collect_list(F.struct("chunk_id", "category_ids")).alias("_all"))  # one row of class ids, not of data
    units = images.select(F.col("id").alias("image_id")).join(F.broadcast(packed)).select("image_id", F.inline("_all"))
    return units.join(n, ["image_id", "chunk_id"], "left").fillna(0, ["n_objects"])


def phrase_queries(images: DataFrame, annotations: DataFrame, key: str = "image_id") -> DataFrame:
    """Noun-phrase queries: one per image row, object ids in order; phrases without objects are negatives."""
    a = annotations.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("object_ids"))
    return images.join(a, "id", "left").select(F.col("id").alias(key), F.col("text_input").alias("query_text"),
                                               F.coalesce("object_ids", F.array().cast("array<bigint>")).alias("object_ids"),
                                               F.coalesce("is_instance_exhaustive", F.lit(True)).alias("is_exhaustive"))


def training_boxes(df: DataFrame, limit: int = 10) -> DataFrame:
    """image, text and up to `limit` boxes scaled from the original to the padded canvas and clamped to [0, 1].

    Boxes are xyxy unless box_format says cxcywh; the limit is part of the format."""
    def one(b):
        v = [b[i] for i in range(4)]
        c = B.cxcywh_to_xyxy(*v)
        cx = F.col("box_format") == "cxcywh"
        corners = [F.when(cx, x).otherwise(y) for x, y in zip(c, v)]
        side = F.greatest("width", "height").cast("double")
        return F.array(*[F.least(F.lit(1.0), F.greatest(F.lit(0.0), p / side)) for p in corners])
    return df.select("image", "text", F.transform(F.slice("boxes", 1, limit), one).alias("boxes"))


def prediction_rows(outputs: DataFrame) -> DataFrame:
    """One row per predicted box of model output arrays (image_id, boxes, scores, labels): xywh, rounded to five digits."""
    z = F.explode(F.arrays_zip("boxes", "scores", "labels"))
    b = [F.col("z.boxes")[i] for i in range(4)]
    xywh = F.array(*[F.round(v, 5) for v in (b[0], b[1], b[2] - b[0], b[3] - b[1])])
    return outputs.select("image_id", z.alias("z")).select("image_id", F.col("z.labels").alias("category_id"), xywh.alias("bbox"), F.round("z.scores", 5).alias("score"))


def detections_of(logits: DataFrame, threshold: float, forced_label: int | None = None) -> DataFrame:
    """Model outputs to detections: best class score, cxcywh to scaled corners, score strictly above the threshold.

    logits: image_id, q, scores (array), cx, cy, w, h in [0, 1], img_w, img_h."""
    best = F.array_max("scores")
    b = B.scale(B.cxcywh_to_xyxy(*[F.col(c) for c in ("cx", "cy", "w", "h")]), 1.0, 1.0)
    sx, sy = F.col("img_w"), F.col("img_h")
    label = F.lit(forced_label) if forced_label is not None else F.array_position("scores", best).cast("int") - 1
    return logits.where(best > threshold).select("image_id", "q", best.alias("score"), label.alias("label"), (b.x0 * sx).alias("x0"), (b.y0 * sy).alias("y0"), (b.x1 * sx).alias("x1"), (b.y1 * sy).alias("y1"))


# video ------------------------------------------------------------------------------------------------------------
def track_frames(tracks: DataFrame) -> DataFrame:
    """Tracks with per-frame boxes (xywh, NULL absent) exploded: keys, frame_idx, corners; absent frames have no row."""
    t = tracks.select(*[c for c in tracks.columns if c != "bboxes"], F.posexplode("bboxes").alias("frame_idx", "_b")).where(~B.is_zero_box(F.col("_b")))
    return t.select(*[c for c in t.columns if c != "_b"], *[c.alias(n) for c, n in zip(B.box_of_xywh(F.col("_b")), ("x0", "y0", "x1", "y1"))])


def dense_boxes(tracks: DataFrame) -> DataFrame:
    """Absent boxes become zeros; adds the mean area over present frames."""
    zero = F.array(*[F.lit(0.0)] * 4)
    present = F.filter("bboxes", lambda b: ~B.is_zero_box(b))
    mean = F.aggregate(present, F.lit(0.0), lambda s, b: s + b[2] * b[3]) / F.nullif(F.size(present), F.lit(0))
    return tracks.withColumn("area", F.coalesce(mean, F.lit(0.0))).withColumn("bboxes", F.transform("bboxes", lambda b: F.coalesce(b, zero)))


def frame_images(videos: DataFrame) -> DataFrame:
    """Videos (id, file_names) to frame images with running ids over (video, frame)."""
    f = videos.select(F.col("id").alias("video_id"), F.posexplode("file_names").alias("frame_idx", "file_name"))
    return positions(f.withColumn("_g", F.lit(0)), ["_g"], ["video_id", "frame_idx"], "image_id", start=1).drop("_g")


def to_frame_annotations(tracks: DataFrame, images: DataFrame) -> DataFrame:
    """Frame-level annotations of tracks; fails when a (video, frame) has no image."""
    fr = track_frames(tracks)
    lost = fr.join(images, ["video_id", "frame_idx"], "left_anti").limit(1).count()
    if lost:
        raise ValueError("a track frame has no image")
    return fr.join(images.select("video_id", "frame_idx", "image_id"), ["video_id", "frame_idx"])


def fill_sizes(tracks: DataFrame, videos: DataFrame) -> DataFrame:
    v = videos.select(F.col("id").alias("video_id"), F.col("height").alias("_h"), F.col("width").alias("_w"))
    return tracks.join(v, "video_id", "left").withColumns({"height": F.coalesce("height", "_h"), "width": F.coalesce("width", "_w")}).drop("_h", "_w")


def fill_video_ids(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Missing video ids come from the annotation's image."""
    im = images.select(F.col("id").alias("image_id"), F.col("video_id").alias("_v"))
    return annotations.join(im, "image_id", "left").withColumn("video_id", F.coalesce("video_id", "_v")).drop("_v")


def class_agnostic(tracks: DataFrame, ident: str) -> DataFrame:
    """Category 1 for all, dense track ids per video."""
    return dense_ids(tracks, ["video_id"], ident, "track_id").withColumn("category_id", F.lit(1))


def merge_categories(df: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("source").alias("category_id"), F.col("target").alias("_t"))
    return df.join(m, "category_id", "left").withColumn("category_id", F.coalesce("_t", "category_id")).drop("_t")


def remapped_name(video: Column, frame: Column) -> Column:
    return F.format_string("remapped_vid_%012d/%s", video, frame)


def read_tracking_text(spark: SparkSession, path: str, columns: list[str], valid: dict[str, list] | None = None, ignore: dict[str, list] | None = None,
                       convert: DataFrame | None = None) -> DataFrame:
    """Comma-separated tracking rows. `valid` keeps listed values, `ignore` drops them, `convert` (column, source, target) renames."""
    df = spark.read.csv(path, schema=", ".join(f"`{c}` STRING" for c in columns))
    for c, vals in (valid or {}).items():
        df = df.where(F.col(c).isin([str(v) for v in vals]))
    for c, vals in (ignore or {}).items():
        df = df.where(~F.col(c).isin([str(v) for v in vals]))
    if convert is not None:
        for c in columns:
            m = convert.where(F.col("column") == c).select(F.col("source").alias(c), F.col("target").alias("_t"))
            df = df.join(m, c, "left").withColumn(c, F.coalesce("_t", c)).drop("_t")
    return df.select(*columns)
