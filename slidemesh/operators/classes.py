"""Class vocabularies: taxonomy joins, unions and retry lists. The taxonomy is a small dimension table (name, coarse, t_pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _k(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def canonical(answers: DataFrame, taxonomy: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Model answers (key, pos, name) mapped to taxonomy spelling, unknown ones dropped, first occurrence kept."""
    t = taxonomy.select(_k("name").alias("_k"), F.col("name").alias("class"), "t_pos")
    hit = answers.withColumn("_k", _k(name)).join(t, "_k")
    return hit.groupBy(key, "class", "t_pos").agg(F.min("pos").alias("pos"))


def coarse_of(fine: DataFrame, taxonomy: DataFrame, name: str = "label") -> DataFrame:
    """Adds coarse; classes without a coarse parent get NULL."""
    t = taxonomy.select(_k("name").alias("_k"), "coarse")
    return fine.withColumn("_k", _k(name)).join(t, "_k", "left").drop("_k")


def union_classes(b: DataFrame, c: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """Case-insensitive union in taxonomy order: (key, class, t_pos)."""
    t = taxonomy.select(_k("name").alias("_k"), F.col("name").alias("class"), "t_pos")
    return b.select(key, _k("name").alias("_k")).union(c.select(key, _k("name").alias("_k"))).distinct().join(t, "_k").select(key, "class", "t_pos")


def extracted_classes(comps: DataFrame, key: str, label: str = "label") -> DataFrame:
    return comps.select(key, _k(label).alias("class")).where("class <> ''").distinct()


def retry_classes(proposed: DataFrame, extracted: DataFrame, residue: DataFrame, key: str) -> DataFrame:
    """Proposed classes not extracted, then classes mapped from the residue, first-seen order: (key, class, ord).

    All three carry (key, class); proposed and residue also pos."""
    left = proposed.withColumn("_k", _k("class")).join(extracted.select(key, _k("class").alias("_k")), [key, "_k"], "left_anti").select(key, "_k", "class", F.lit(0).alias("src"), "pos")
    both = left.unionByName(residue.select(key, _k("class").alias("_k"), "class", F.lit(1).alias("src"), "pos"))
    return both.groupBy(key, "_k").agg(F.min_by("class", F.struct("src", "pos")).alias("class"), F.min(F.struct("src", "pos")).alias("ord")).drop("_k")


def add_retry(union: DataFrame, retry: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """Union plus the retry classes that the taxonomy knows."""
    known = retry.withColumn("_k", _k("class")).join(taxonomy.select(_k("name").alias("_k")), "_k", "left_semi")
    return union.select(key, _k("class").alias("class")).union(known.select(key, F.col("_k").alias("class"))).distinct()


def dedup_phrases(phrases: DataFrame, key: str) -> DataFrame:
    """Phrases (key, pos, phrase) without case-insensitive repeats and blanks, first spelling and position kept."""
    p = phrases.withColumn("_k", F.lower(F.trim("phrase"))).where("_k <> ''")
    return p.groupBy(key, "_k").agg(F.min("pos").alias("pos"), F.min_by(F.trim("phrase"), "pos").alias("phrase")).drop("_k")


def work_items(images: DataFrame, classes: DataFrame) -> DataFrame:
    """Every image with the class list (a short vocabulary packed into one row, so each image stays one row)."""
    packed = classes.withColumn("name", F.trim("name")).where("name <> ''").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t_pos", "name"))), lambda s: s["name"]).alias("text_types"))
    return images.join(F.broadcast(packed))
