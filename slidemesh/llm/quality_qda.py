"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a normal density over the statistics below. Its covariance is shrunk to the pooled one and then to a multiple of the unit
matrix; scores are differences of log densities, from Mahalanobis distances by cached Cholesky factors. The fit needs sums of products only:
it runs over all labelled rows in one distributed pass, and what reaches the driver has the size of the model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.llm.common import Scratch, query, ship, small_or_shuffled, table

TO_POOLED = 0.7         # share of the pooled covariance
TO_UNIT = 0.02          # share of the mean variance times the unit matrix
SOFTNESS = 4.0          # log odds are divided by this; the decision at 0.5 is not moved
GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#$%&*@^~+=", b"|<>[]{}\\/_", b".,;:", b"\"'()-", b"\n"]
STATISTICS = ["log_bytes", *(f"log_share_{k}" for k in ("upper", "digit", "exclaim", "symbol", "markup", "stop", "quote", "newline")), "log_share_high", "entropy",
              "log_words", "word_length", "word_spread", "log_short", "log_long", "log_bare", "distinct", "top_word", "log_lines", "line_repeat"]
PRIOR_BYTES, PRIOR_WORDS = 120, 20
DIM = len(STATISTICS)
_GROUP_OF = np.full(256, len(GROUPS), np.int64)
for _k, _g in enumerate(GROUPS):
    _GROUP_OF[list(_g)] = _k
_USUAL = np.array([0.02, 0.0, 0.0, 0.0, 0.0, 0.02, 0.0, 0.003])    # shares of the prior, in the order of GROUPS


def statistics(data: bytes) -> list[float]:
    """Statistics of a whole text's UTF-8 bytes. Shares are taken as logarithms with a floor, over the text plus PRIOR_BYTES and PRIOR_WORDS of
    ordinary text, so that a few words are not judged by the shares of a few words; an empty text has the statistics of that prior."""
    n = len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    per = n + PRIOR_BYTES
    groups = (np.bincount(_GROUP_OF, hist, len(GROUPS) + 1)[:-1] + PRIOR_BYTES * _USUAL) / per
    p = hist[hist > 0] / max(n, 1)
    words = data.split()
    total = len(words) + PRIOR_WORDS
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    bare = sum(c for w, c in counts.items() if not any(x > 127 or 65 <= x <= 90 or 97 <= x <= 122 for x in w[:8]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    floor = np.log(np.concatenate((groups, [(hist[128:].sum() + 0.02 * PRIOR_BYTES) / per])) + 1e-3)
    mean = (lengths.sum() + 6.0 * PRIOR_WORDS) / total
    spread = np.sqrt((((lengths - mean) ** 2).sum() + 12.0 * PRIOR_WORDS) / total)
    return [np.log(per), *floor, float(-(p * np.log2(p)).sum() * n + 4.2 * PRIOR_BYTES) / per, np.log(total), np.log(mean), np.log(spread),
            np.log(((lengths <= 2).sum() + 0.2 * PRIOR_WORDS) / total + 1e-2), np.log((lengths > 15).sum() / total + 1e-2), np.log(bare / total + 1e-3),
            np.log((len(counts) + PRIOR_WORDS) / total) + 0.15 * np.log(total), np.log((max(counts.values(), default=0) + 1) / total),
            np.log1p(len(lines)), np.log((len(lines) - len(set(lines))) / (len(lines) + 2) + 1e-2)]


def with_statistics(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """`keep` columns and `stats` (array of doubles) of every row; a null text counts as empty."""
    src = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t or b"") for t in b.column(0).cast(pa.binary()).to_pylist()]).reshape(b.num_rows, DIM)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float64()))], [*b.schema.names[1:], "stats"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[1:])
    return src.mapInArrow(run, f"{kinds}, stats array<double>")


@dataclass
class Model:
    """Means, inverse Cholesky factors of the shrunk covariances, and constants of the log densities, class 0 then 1."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse_factors: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        density = [self.constants[k] - 0.5 * (((z - self.means[k]) @ self.inverse_factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / SOFTNESS, -700, 700)))


def fit(labelled: DataFrame, to_pooled: float = TO_POOLED, to_unit: float = TO_UNIT) -> Model:
    """Model of `labelled` (label 0 or 1, stats), over all its rows. Rows with another or no label are left out; a class without rows takes
    the pooled density with a prior of half a row, so that the other class wins nearly always; without any row every score is 0.5."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, DIM + 1, DIM + 1))
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy().reshape(-1, DIM)
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            for k in (0, 1):
                total[k] += x[label == k].T @ x[label == k]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["label", "sums"])

    def add(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "f8") for x in group.column("sums").to_pylist()]
        return pa.table({"label": group.column("label")[:1], "sums": pa.array([np.sum(parts, 0).tobytes()], pa.binary())})

    src = labelled.where("label IN (0, 1)").select(F.col("label").cast("int").alias("label"), "stats")
    rows = src.mapInArrow(sums, "label int, sums binary").groupBy("label").applyInArrow(add, "label int, sums binary").collect()
    moments = np.zeros((2, DIM + 1, DIM + 1))
    for r in rows:
        moments[r["label"]] = np.frombuffer(r["sums"], "f8").reshape(DIM + 1, DIM + 1)
    return from_moments(moments, to_pooled, to_unit)


def from_moments(moments: np.ndarray, to_pooled: float = TO_POOLED, to_unit: float = TO_UNIT) -> Model:
    counts = moments[:, 0, 0]
    n = counts.sum()
    whole = moments.sum(0)
    center = whole[0, 1:] / max(n, 1)
    scale = np.sqrt(np.maximum(np.diag(whole)[1:] / max(n, 1) - center ** 2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    means, scatter = np.zeros((2, DIM)), np.zeros((2, DIM, DIM))
    for k in (0, 1):
        if counts[k]:
            mean = moments[k, 0, 1:] / counts[k]
            means[k] = (mean - center) / scale
            scatter[k] = (moments[k, 1:, 1:] - counts[k] * np.outer(mean, mean)) / np.outer(scale, scale)
    pooled = scatter.sum(0) / max(n, 1) + 1e-6 * np.eye(DIM)
    factors, constants = np.zeros((2, DIM, DIM)), np.zeros(2)
    for k in (0, 1):
        own = scatter[k] / counts[k] if counts[k] > DIM else pooled
        cov = (1 - to_pooled) * own + to_pooled * pooled
        cov = (1 - to_unit) * cov + to_unit * np.trace(cov) / DIM * np.eye(DIM) + 1e-6 * np.eye(DIM)
        low = np.linalg.cholesky(cov)
        factors[k] = np.linalg.solve(low, np.eye(DIM))
        constants[k] = np.log(max(counts[k], 0.5)) - np.log(np.diag(low)).sum()
    return Model(center, scale, means, factors, constants)


def scored(with_stats: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` columns and `score`, the softened probability of label 1."""
    src = with_stats.select("stats", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, DIM)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.scores(x))], [*b.schema.names[1:], "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[1:])
    return src.mapInArrow(run, f"{kinds}, score double")


def held_out(id_col: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3; a null id is not one of them."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every row of `docs`, learnt from the labels of rows that are not held out.

    Null and empty texts are scored by the statistics of no words. A null or unknown label is not learnt from; an id with several labels
    takes the largest; repeated document rows are each scored and learnt from. Null ids have no label. An empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "quality")
    stats = scratch.save(with_statistics(docs, text_col, [F.col(id_col).alias("id")]), "stats")
    truth = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    model = fit(stats.where(~held_out(F.col("id"))).join(truth, "id"))
    return scored(stats, model, ["id"]).select("id", held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of `docs` predicted as 1, with their columns, by a model learnt as in `quality_scores`. A score depends on the text alone, so rows
    are told apart by its 64-bit hash and length: ids may repeat or be null."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stats = scratch.save(with_statistics(docs, text_col, [F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.octet_length(text).alias("size")]), "stats")
    truth = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    model = fit(stats.where(~held_out(F.col("id"))).join(truth, "id"))
    gone = scored(stats, model, ["mark", "size"]).where("score < 0.5").select(F.col("mark").alias("_mark"), F.col("size").alias("_size")).distinct()
    gone = scratch.save(gone, "rejected")
    keyed = docs.withColumn("_mark", F.xxhash64(text)).withColumn("_size", F.octet_length(text))
    return keyed.join(small_or_shuffled(gone), ["_mark", "_size"], "left_anti").select(*docs.columns)


@query("op9_quality_qda")
def op9_quality_qda(spark, sf):
    """One row per document: score and prediction of the quality label."""
    out = quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.withColumnRenamed("id", "doc_id")
