"""Readers and writers of run directories, graphs, usage logs and native shape files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.runtime import cut, path_exists

_COMPONENT = ("filename: STRING, granularity: STRING, source: STRING, iter_idx: INT, iter_original_filename: STRING, text_type: STRING, score: DOUBLE, "
              "bbox_xyxy: ARRAY<DOUBLE>, bbox_area: DOUBLE, polygon_xyxy: ARRAY<ARRAY<DOUBLE>>, segmentation_mode: STRING, is_text_only: BOOLEAN, ocr_latex: STRING, "
              "bbox_was_tightened: BOOLEAN, merged_into: STRING, merged_from: ARRAY<STRING>, post_merge_ocr: BOOLEAN, z_index: INT")
MANIFEST = f"image STRING, num_components INT, num_final_components INT, components ARRAY<STRUCT<{_COMPONENT}>>, final_components ARRAY<STRUCT<{_COMPONENT}>>"
USAGE = ("ts DOUBLE, marker STRING, image STRING, idx INT, wall_clock_sec DOUBLE, agent STRING, backend STRING, input_tokens BIGINT, output_tokens BIGINT, "
         "cache_creation_input_tokens BIGINT, cache_read_input_tokens BIGINT, latency_sec DOUBLE, _bad STRING")
_BOX = "bbox_xyxy: ARRAY<DOUBLE>, bbox: ARRAY<DOUBLE>, position_pixels: STRUCT<left: DOUBLE, top: DOUBLE, width: DOUBLE, height: DOUBLE, right: DOUBLE, bottom: DOUBLE>"
SHAPES = (f"slide_info STRUCT<file: STRING, dimensions_pixels: STRUCT<width: INT, height: INT>, dpi: INT>, "
          f"components ARRAY<STRUCT<index: INT, name: STRING, type: STRING, shape_type: STRING, text: STRING, {_BOX}>>")


def _slide_of(path: Column) -> Column:
    """Directory name of the slide in '<run>/<slide>/final/metadata.json'."""
    return F.url_decode(F.element_at(F.split(path, "/"), -3))


def read_manifests(spark: SparkSession, run_dir: str, schema: str = MANIFEST) -> DataFrame:
    """One row per slide directory that has a final manifest; an empty run is an error."""
    df = spark.read.schema(schema).option("multiLine", True).json(f"{run_dir.rstrip('/')}/*/final/metadata.json")
    df = df.withColumn("slide_id", _slide_of(F.col("_metadata.file_path")))
    if df.isEmpty():
        raise FileNotFoundError(f"no slide with final/metadata.json under {run_dir}")
    return df


def component_nodes(manifests: DataFrame) -> DataFrame:
    """Component rows of the final list (all components when there is none), node id by position."""
    listed = F.when(F.size("final_components") > 0, F.col("final_components")).otherwise(F.coalesce("components", F.array().cast(manifests.schema["components"].dataType)))
    c = manifests.select("slide_id", F.posexplode(listed).alias("pos", "c"))
    b = B.box_of_array(F.coalesce("c.bbox_xyxy", F.array(*[F.lit(0.0)] * 4)))
    keep = ["text_type", "granularity", "source", "score", "z_index", "is_text_only", "ocr_latex", "polygon_xyxy", "segmentation_mode", "merged_from", "merged_into"]
    return c.select("slide_id", "pos", F.format_string("%s/c%03d", "slide_id", "pos").alias("node_id"), F.coalesce("c.filename", F.lit("")).alias("filename"),
                    *[v.alias(n) for v, n in zip(b, ("x0", "y0", "x1", "y1"))], *[F.col(f"c.{k}").alias(k) for k in keep])


def cleaned_backgrounds(spark: SparkSession, run_dir: str) -> DataFrame:
    """First cleaned background per slide; only paths are read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "image_cleaned.png").option("recursiveFileLookup", True).load(run_dir).select("path")
    slide = F.url_decode(F.regexp_extract("path", r"([^/]+)/iter_[^/]*/segmentation/[^/]+/image_cleaned\.png$", 1))
    return f.withColumn("slide_id", slide).where("slide_id <> ''").groupBy("slide_id").agg(F.min("path").alias("cleaned_background"))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Native shape files, one object row per shape; all three box spellings are understood."""
    df = spark.read.schema(SHAPES).option("multiLine", True).json(path).withColumn("slide_id", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:_components)?\.json$", 1))
    return object_nodes(df)


def object_nodes(shapes: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Object nodes; with `rendered` (slide_id, width, height) boxes are rescaled from the native to the rendered size."""
    s = shapes.select("slide_id", F.col("slide_info.dimensions_pixels").alias("_dim"), F.posexplode("components").alias("pos", "s"))
    p = F.col("s.position_pixels")
    arr = F.coalesce("s.bbox_xyxy", "s.bbox", F.when(p.isNotNull(), F.array(p["left"], p["top"], F.coalesce(p["right"], p["left"] + p["width"]), F.coalesce(p["bottom"], p["top"] + p["height"]))),
                     F.array(*[F.lit(0.0)] * 4))
    b = B.box_of_array(arr)
    sx = sy = F.lit(1.0)
    if rendered is not None:
        s = s.join(rendered.select("slide_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "slide_id", "left")
        sx, sy = F.coalesce(F.col("_w") / F.col("_dim.width"), F.lit(1.0)), F.coalesce(F.col("_h") / F.col("_dim.height"), F.lit(1.0))
    b = B.scale(b, sx, sy)
    return s.select("slide_id", "pos", F.format_string("%s/o%03d", "slide_id", "pos").alias("object_id"), F.coalesce("s.shape_type", "s.type", F.lit("shape")).alias("shape_type"),
                    F.col("s.text").alias("text"), *[v.alias(n) for v, n in zip(b, ("x0", "y0", "x1", "y1"))])


def flatten_groups(shapes: DataFrame, min_px: float = 8.0) -> DataFrame:
    """Leaf shapes of nested groups by parent links (slide_id, shape_id, parent_id, is_group, x, y, w, h, angle).

    Zero-size shapes go, thin ones get `min_px`, turned ones their hull. Adds root_id, the outermost group: groups jump to the parent
    of their parent until none moves, so rounds grow with the logarithm of the depth. Groups that contain each other raise."""
    groups = shapes.where("is_group").select("slide_id", F.col("shape_id").alias("g"), F.col("parent_id").alias("up"))
    known = groups.select("slide_id", F.col("g").alias("up"), F.lit(True).alias("_is"))
    jump = cut(groups.join(known, ["slide_id", "up"], "left").select("slide_id", "g", F.when(F.col("_is"), F.col("up")).alias("up")))
    for _ in range(64):
        ahead = jump.select("slide_id", F.col("g").alias("up"), F.col("up").alias("_far"))
        jump = cut(jump.join(ahead, ["slide_id", "up"], "left").select("slide_id", "g", F.coalesce("_far", "up").alias("up"), F.col("_far").isNotNull().alias("_moved")))
        if not jump.where("_moved").limit(1).count():
            break
    else:
        raise ValueError("groups contain each other")
    top = jump.select("slide_id", F.col("g").alias("parent_id"), F.coalesce("up", "g").alias("root_id"))
    out = shapes.where("NOT is_group").join(top, ["slide_id", "parent_id"], "left").withColumn("root_id", F.coalesce("root_id", "parent_id"))
    solid = out.where((F.col("w") > 0) | (F.col("h") > 0)).withColumns({"w": F.greatest("w", F.lit(min_px)), "h": F.greatest("h", F.lit(min_px))})
    r = B.rotated_hull(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("w"), F.col("h"), F.coalesce("angle", F.lit(0.0)))
    return solid.select("slide_id", "shape_id", "parent_id", "root_id", *[c.alias(n) for c, n in zip(r, ("x0", "y0", "x1", "y1"))])


# usage log ----------------------------------------------------------------------------------------------------------
def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage records in file order; lines that are not JSON are skipped. line_no orders lines within a file."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", USAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = raw.select(F.col("_metadata.file_path").alias("run"), F.monotonically_increasing_id().alias("line_no"), parsed.alias("r")).where("r._bad IS NULL AND r IS NOT NULL")
    return (df.select("run", "line_no", "r.*").drop("_bad").withColumns({"event_time": F.timestamp_seconds("ts"), "latency_ms": F.bround(F.col("latency_sec") * 1000).cast("long")}))


def write_usage(records: DataFrame, path: str) -> bool:
    """Append records; a failure is reported, never raised (logging must not end a job)."""
    try:
        records.write.mode("append").json(path)
        return True
    except Exception as exc:  # noqa: BLE001
        print(f"usage log not written: {exc}")
        return False


# inputs -------------------------------------------------------------------------------------------------------------
def list_images(spark: SparkSession, directory: str) -> DataFrame:
    """Image paths below a directory, without their content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "length")
    return f.where(F.lower("path").rlike(r"\.(png|jpe?g|bmp|webp|tiff?)$"))


def listed_images(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of strings or of {"image": ...} objects: (pos, image)."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>")
    obj = F.get_json_object("item", "$.image")
    return text.select(F.posexplode(items).alias("pos", "item")).select("pos", F.coalesce(obj, "item").alias("image"))


def workspace(runs: DataFrame, originals: DataFrame) -> DataFrame:
    """Pages of a run directory: index and name from '<idx>_<name>', original image by priority of its source.

    runs: dir, image; originals: name, path, priority."""
    r = runs.withColumns({"page_idx": F.regexp_extract("dir", r"^(\d+)_(.+)$", 1).try_cast("int"), "page": F.regexp_extract("dir", r"^(\d+)_(.+)$", 2)})
    o = originals.groupBy(F.col("name").alias("page")).agg(F.min_by("path", "priority").alias("_orig"))
    return r.join(o, "page", "left").withColumn("original", F.coalesce("image", "_orig")).drop("_orig")


# graph --------------------------------------------------------------------------------------------------------------
def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def nested_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One document row per slide for export; a document holds one slide, so this is for slides that fit one."""
    n = nodes.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in nodes.columns if c not in ("slide_id", "pos")]))).alias("components"))
    e = edges.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("kind", "src", "dst", "weight"))).alias("edges"))
    return n.join(e, "slide_id", "left")


def unnest_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return docs.select("slide_id", F.inline("components")), docs.select("slide_id", F.inline("edges"))


def write_results(results: DataFrame, path: str, by: str) -> None:
    """Result sink: partitions present in `results` are replaced, the others stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def pending(work: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Work items without a stored result (resume)."""
    if not path_exists(spark, path):
        return work
    return work.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")


def apply_answers(requests: DataFrame, answer, schema: str) -> DataFrame:
    """Hook for a user callable over batches of requests: an iterator of pandas frames in, the same out."""
    return requests.mapInPandas(answer, schema)
