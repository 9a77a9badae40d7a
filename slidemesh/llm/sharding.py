"""Shards by fixed virtual slots.

Records are hashed into a fixed number of slots; bytes are summed per slot; a versioned map says which shard holds each slot. Balancing
and growing edit the map, so that only the records of moved slots move. All steps are DataFrame and SQL functions; what passes through
one row is the map, whose size is the number of slots, a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from slidemesh.llm.common import Scratch, query, table

SLOTS = 4096


def slot_of(id_col: Column, text: Column, slots: int = SLOTS) -> Column:
    """Slot of a record: a hash of its id, of its text where the id is null."""
    return F.pmod(F.xxhash64(F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.crc32(text)))), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) of all slots, empty ones too, from `records` (vslot, size); combined map-side."""
    sums = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def _folded(slots: DataFrame, shards: int, start: Column, choose: str, version: int) -> DataFrame:
    """Walk the slots from most to fewest bytes; `choose` (SQL over s.load and x) names the shard, loads follow. One row of bounded size."""
    step = f"""aggregate(all_slots, named_struct('load', {{start}}, 'to', cast(array() AS array<int>)),
      (s, x) -> named_struct('load', transform(s.load, (v, i) -> CASE WHEN x.shard = {choose} THEN v WHEN i = {choose} THEN v + x.bytes + 1 WHEN i = x.shard THEN v - x.bytes - 1 ELSE v END),
                             'to', concat(s.to, array({choose})))).to"""
    step = step.replace("{start}", "start")
    packed = slots.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes", "rows", "shard"))).alias("all_slots"))
    dealt = packed.withColumn("start", start).select("all_slots", F.expr(step).alias("to"))
    return dealt.select(F.inline(F.arrays_zip("all_slots", "to"))).select(F.lit(version).alias("version"), "all_slots.vslot", F.col("to").alias("shard"), "all_slots.bytes", "all_slots.rows")


LEAST = "cast(array_position(s.load, array_min(s.load)) - 1 AS int)"


def first_map(stats: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map (version, vslot, shard, bytes, rows): largest slot first, each to the shard with the fewest bytes so far."""
    start = F.array_repeat(F.lit(0).cast("long"), shards)
    return _folded(stats.withColumn("shard", F.lit(-1)), shards, start, LEAST, 1)


def edited_map(old: DataFrame, stats: DataFrame, shards: int, version: int, tolerance: float = 0.01) -> DataFrame:
    """The next version after sizes changed or shards were added: a slot moves only from a shard above the mean by more than `tolerance`, to
    the emptiest shard, and only if that stays at the mean or below; all other slots stay where they were. Added shards take slots only into
    themselves."""
    had = min(shards, old.agg(F.max("shard")).first()[0] + 1)
    open_ = f"slice(s.load, {had + 1}, {shards - had})" if had < shards else "s.load"
    least = f"cast({had if had < shards else 0} + array_position({open_}, array_min({open_})) - 1 AS int)"
    now = stats.join(old.select("vslot", "shard"), "vslot")
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate(F.col("all_slots"), F.lit(0).cast("long"), lambda t, x: t + F.when(x["shard"] == k, x["bytes"] + 1).otherwise(0)))
    mean = f"(aggregate(s.load, 0L, (t, v) -> t + v) / {shards})"
    choose = f"CASE WHEN s.load[x.shard] > {mean} * {1 + tolerance} AND array_min({open_}) + x.bytes <= {mean} THEN {least} ELSE x.shard END"
    return _folded(now, shards, loads, choose, version)


def write_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the stored map."""
    slot_map.repartition(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    """The given version of the stored map, the latest if none is given."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def sharded(docs: DataFrame, slot_map: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot, shard, slot, version) of every row. `slot` numbers the rows of a shard from 0 without gaps, slot by
    slot and by id within it. Text never leaves the scan. Rows are ranked within a virtual slot, not within a shard, so the largest window
    holds a few thousandths of a shard's rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot_of(F.col(id_col), text, slots).alias("vslot"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    placed = slot_map.select("version", "vslot", "shard", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "text_crc32", "size"))
    ranked = rows.withColumn("rank", rank - 1)
    # the map has `slots` rows, whatever the table's size
    return ranked.join(F.broadcast(placed), "vslot").select("id", "size", "text_crc32", "vslot", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"), "version")


def byte_shards(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", store: str | None = None) -> DataFrame:
    """Shard all rows with a fresh map, stored as version 1 below `store` (a scratch folder if none).

    A null text has no bytes and counts as empty; a record weighs its UTF-8 bytes plus 1. A null id is placed by its text. Rows that share an
    id share a slot and are numbered in order of text; repeated rows get different numbers. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = docs.select(slot_of(F.col(id_col), text, slots).alias("vslot"), (F.octet_length(text) + 1).cast("long").alias("size"))
    store = store or scratch.path("map")
    write_map(first_map(slot_bytes(sizes, slots), shards), store)
    return sharded(docs, read_map(docs.sparkSession, store, 1), id_col, text_col, slots)


@query("op2_virtual_slots")
def op2_virtual_slots(spark, sf):
    """All documents in 16 shards of near equal bytes."""
    out = byte_shards(table(spark, sf, "documents"), 16)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))
