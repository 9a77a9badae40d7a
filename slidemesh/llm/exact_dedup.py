"""Exact duplicates through counting quotient filters.

Every partition builds one filter over the 64-bit fingerprints of its normalised texts. A fingerprint is split into block, quotient and
remainder; a block of the filter holds, for each quotient, a run of sorted remainders with counts. Blocks of all partitions merge by
their sorted remainders without loss, so the merged counts are those of the whole table. Only texts whose fingerprint counts more than
one are shuffled, and they are grouped by their bytes: an equal fingerprint alone never makes two texts equal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.llm.common import Scratch, query, small_or_shuffled, table

SPACE = r"[\x20\x09-\x0D]+"
QUOTIENT_BITS = 12
BLOCK_ROWS = 500_000    # fingerprints per merged block


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


@dataclass
class CountingQuotientFilter:
    """Runs of sorted remainders per quotient, with counts, for the fingerprints of one block (its leading `block_bits` are implied)."""

    block_bits: int
    runs: np.ndarray        # entries of each quotient
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, block_bits: int, fps: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From sorted distinct fingerprints of one block."""
        rest = np.uint64(64 - block_bits - QUOTIENT_BITS)
        quotients = (fps >> rest) & np.uint64((1 << QUOTIENT_BITS) - 1)
        return cls(block_bits, np.bincount(quotients.astype(np.int64), minlength=1 << QUOTIENT_BITS).astype(np.uint32),
                   fps & ((np.uint64(1) << rest) - np.uint64(1)), counts.astype(np.uint64))

    def keys(self) -> np.ndarray:
        """Quotient and remainder of each entry, in order."""
        rest = np.uint64(64 - self.block_bits - QUOTIENT_BITS)
        return (np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs) << rest) | self.remainders

    def merge(self, others: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        keys = np.concatenate([self.keys(), *(x.keys() for x in others)])
        counts = np.concatenate([self.counts, *(x.counts for x in others)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        return CountingQuotientFilter.build(self.block_bits, keys[first], np.add.reduceat(counts, first) if len(first) else counts)


def filter_counts(marks: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(fp, n) of all fingerprints that occur more than once in `marks` (fp long); `n` rows decide the number of blocks only."""
    bits = int(min(30, max(7, np.ceil(np.log2(max(1, n / block_rows))))))
    schema = pa.schema([("block", pa.int64()), ("runs", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.empty(0, np.uint64), np.empty(0, np.uint64)

        def out() -> Iterator[pa.RecordBatch]:
            block = (held >> np.uint64(64 - bits)).astype(np.int64)
            for part in np.split(np.arange(len(held)), np.flatnonzero(np.diff(block)) + 1):
                if len(part):
                    f = CountingQuotientFilter.build(bits, held[part], sums[part])
                    yield pa.RecordBatch.from_arrays([pa.array([int(block[part[0]])]), *(pa.array([x.tobytes()], pa.binary()) for x in (f.runs.astype("<u4"), f.remainders, f.counts))], schema=schema)

        for b in batches:
            fps, own = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            held, where = np.unique(np.concatenate([held, fps]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([sums, own.astype(np.uint64)])).astype(np.uint64)
            if len(held) > 8 * block_rows:      # bounded memory: a partition may return more than one filter
                yield from out()
                held, sums = held[:0], sums[:0]
        yield from out()

    def merge(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        rows = zip(*(group.column(c).to_pylist() for c in ("runs", "remainders", "counts")))
        filters = [CountingQuotientFilter(bits, np.frombuffer(a, "<u4"), np.frombuffer(b, np.uint64), np.frombuffer(c, np.uint64)) for a, b, c in rows]
        f = filters[0].merge(filters[1:])
        hot = f.counts > 1
        fps = f.keys()[hot] | (np.uint64(block) << np.uint64(64 - bits))
        return pa.table({"fp": fps.view(np.int64), "n": f.counts[hot].astype(np.int64)})

    return marks.select("fp").mapInArrow(build, "block long, runs binary, remainders binary, counts binary").groupBy("block").applyInArrow(merge, "fp long, n long")


def _hot_fingerprints(docs: DataFrame, scratch: Scratch, text_col: str, extra: list[Column]) -> tuple[DataFrame, DataFrame]:
    norm = normalised(F.col(text_col))
    marks = scratch.save(docs.select(*extra, F.xxhash64(norm).alias("fp")), "marks")
    return marks, scratch.save(filter_counts(marks, marks.count()), "hot")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, sha256) of every row: texts are equal when their bytes are after white space runs become one space.

    The row with the smallest id of a group is kept; of repeated rows with that id, one. A null text is an empty one and forms a group with
    the empty texts. Null ids come last: a group without any id keeps one row and has a null keep_id. Other columns are not looked at.
    Copies are combined within each task before the shuffle, so a group of any size moves one row per task."""
    scratch = Scratch(docs.sparkSession, "exact")
    norm = normalised(F.col(text_col))
    marks, hot = _hot_fingerprints(docs, scratch, text_col, [F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.sha2(norm, 256).alias("sha256")])
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("fp", F.xxhash64("norm")).join(small_or_shuffled(hot.select("fp")), "fp", "left_semi")
    groups = texts.groupBy("fp", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")) \
        .select("fp", F.sha2("norm", 256).alias("sha256"), "keep_id", "group_size")
    stays = marks.join(hot.select("fp"), "fp", "left_semi").groupBy("fp", "sha256").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    groups = scratch.save(groups.join(stays, ["fp", "sha256"]).select("fp", "sha256", "keep_id", "group_size", F.col("first.row").alias("stays")), "groups")
    out = marks.join(groups, ["fp", "sha256"], "left")
    single = F.col("group_size").isNull()
    return out.select("id", F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      (single | (F.col("row") == F.col("stays"))).alias("kept"), "sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns: of equal texts the one with the smallest id (null ids last, one of repeated rows)."""
    scratch = Scratch(docs.sparkSession, "exact")
    _, hot = _hot_fingerprints(docs, scratch, text_col, [])
    hot = small_or_shuffled(hot.select(F.col("fp").alias("_fp")))
    norm = normalised(F.col(text_col))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(norm).alias("_fp"))
    cold = keyed.join(hot, "_fp", "left_anti").select("_row.*")
    key = F.struct(F.col(f"_row.{id_col}").isNull(), F.col(f"_row.{id_col}"))
    warm = keyed.join(hot, "_fp", "left_semi").withColumn("_norm", normalised(F.col(f"_row.{text_col}")))
    return cold.unionByName(warm.groupBy("_fp", "_norm").agg(F.min_by("_row", key).alias("_row")).select("_row.*"))


@query("op3_exact_quotient", r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents) t""")
def op3_exact_quotient(spark, sf):
    """One row per document: the row that stays of its group of equal texts, and the group's size."""
    found = exact_groups(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))
