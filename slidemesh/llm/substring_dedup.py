"""Repeated passages by level-wise doubling.

Windows that occur once at one length cannot repeat at twice that length, so only windows repeated at a length are extended to the double
of it, until no candidates survive. The first level (half the wanted length) looks at anchors only: of the first-level windows inside
every wanted window the one with the smallest hash. Equal wanted windows have equal anchors, so no repeat is lost, and about one word in
six starts an anchor. An anchor's hash has 64 bits, as a chance collision there only adds a candidate; the levels that decide have 128.

Documents are packed into compressed blocks of about BLOCK_WORDS words, one row each, so that a block meets the findings about it without
shuffling raw texts. A level sends each distinct window of a block once, whatever its copies there, to the bucket of its hash; what comes
back are the windows that repeat. After each level a block keeps just the passages that still hold candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidemesh.llm.common import Scratch, query, table

BLOCK_WORDS = 1 << 18       # words of a block; a longer document is a block of its own
BUCKET_WINDOWS = 1 << 18    # windows that one bucket should hold
PIECES = "block long, ids array<{0}>, docs binary, starts binary, words binary, alive binary"
U64, U32 = np.uint64, np.uint32
MIX = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, depending on their order."""
    x = a * MIX[0]
    x ^= a >> U64(29)
    x += b * MIX[1]
    x ^= x >> U64(32)
    x *= MIX[2]
    x ^= x >> U64(29)
    return x


def _word_hashes(text: bytes, wide: bool) -> list[np.ndarray]:
    """64-bit hashes of the words of `text` (split at white space), and where `wide` a second, independent one of each."""
    words = pa.array(text.split(), pa.binary()).dictionary_encode()
    known = words.dictionary.to_pylist()
    at = words.indices.to_numpy(zero_copy_only=False)
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), ">u8").reshape(-1, 2).astype(U64)
    return [raw[at, k] for k in range(2 if wide else 1)]


def _window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each position on. Lengths are built by doubling, odd ones with one word more."""
    if length == 1:
        return words
    half = _window_hashes(words, length // 2)
    n = len(words) - 2 * (length // 2) + 1
    if n <= 0:
        return words[:0]
    both = _mix(half[:n], half[length // 2:length // 2 + n])
    return _mix(both[:n - 1], words[length - 1:]) if length % 2 else both


def _anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` hashes the position of its smallest one, the leftmost of equal ones."""
    n = len(h) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = h[:n].copy(), np.arange(n)
    for k in range(1, span):
        less = h[k:k + n] < best
        best[less] = h[k:k + n][less]
        at[less] = np.flatnonzero(less) + k
    return at


class Piece:
    """Passages of a block: `docs` and `starts` tell document and first word of each, `alive` marks the words where candidates start."""

    def __init__(self, row: dict):
        self.docs, self.starts = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("docs", "starts"))
        self.text = zstandard.ZstdDecompressor().decompress(row["words"]) if row["words"] else b""
        lines = self.text.split(b"\n") if len(self.docs) else []
        self.sizes = np.fromiter((x.count(b" ") + 1 if x else 0 for x in lines), np.int64, len(lines))
        self.ends = np.cumsum(self.sizes)
        self.passage = np.repeat(np.arange(len(self.docs)), self.sizes)
        self.alive = None if row["alive"] is None else np.unpackbits(np.frombuffer(row["alive"], np.uint8), count=len(self.passage)).astype(bool)

    def position(self, at: np.ndarray) -> np.ndarray:
        """Place in their documents of words given by their place in the piece."""
        p = self.passage[at]
        return self.starts[p] + at - (self.ends - self.sizes)[p]

    def inside(self, length: int, n: int) -> np.ndarray:
        """Of the first n words those with `length` words of their passage from there on."""
        at = np.arange(n)
        return at + length <= self.ends[self.passage[:n]]


def _candidates(p: Piece, length: int, target: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Places and hashes of the windows of `length` to look at: anchors below the target, from there on what the level before left.
    Third, below the target, the anchor of the wanted window at each word."""
    hashes = [_window_hashes(w, length) for w in _word_hashes(p.text, length >= target)]
    n = len(hashes[0])
    if length < target:
        anchor = _anchors(hashes[0], target - length + 1)
        taken = np.zeros(n, bool)
        taken[anchor[p.inside(target, len(anchor))]] = True
        at = np.flatnonzero(taken)
    else:
        anchor = np.empty(0, np.int64)
        at = np.flatnonzero(p.alive[:n] & p.inside(length, n))
    return at, [h[at] for h in hashes], anchor


def _classes(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bounds, first): an order in which equal hashes are neighbours and otherwise as before, and where their groups begin."""
    order = np.lexsort(hashes[::-1]) if len(hashes) > 1 else np.argsort(hashes[0], kind="stable")
    if not len(order):
        return order, order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for h in hashes:
        new[1:] |= h[order][1:] != h[order][:-1]
    bounds = np.flatnonzero(new)
    return order, bounds, order[bounds]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def _pack(docs: DataFrame, scratch: Scratch, id_type: str) -> DataFrame:
    """Blocks of documents: their ids and their words, one document a line, compressed."""
    want = docs.sparkSession.createDataFrame([], PIECES.format(id_type)).schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, ids, size = 0, [], [], 0

        def out() -> pa.RecordBatch:
            n = len(held)
            block = (TaskContext.get().partitionId() << 32) | made
            cols = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(kind)), np.arange(n, dtype="<u4").tobytes(), np.zeros(n, "<u4").tobytes(),
                    zstandard.ZstdCompressor().compress(b"\n".join(held)), None]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array([c], pa.binary()) for c in cols], names=want.names)

        kind = pa.null()
        for b in batches:
            kind = b.schema.field(0).type
            texts = b.column(1)
            for i in range(b.num_rows):
                words = (texts[i].as_py() or b"").split()
                if held and size + len(words) > BLOCK_WORDS:
                    yield out()
                    made, held, ids, size = made + 1, [], [], 0
                held.append(b" ".join(words))
                ids.append(b.column(0)[i].as_py())
                size += len(words)
        if held:
            yield out()

    return scratch.save(docs.mapInArrow(pack, want), "blocks")


def _found(held: DataFrame, length: int, target: int, buckets: int, id_type: str) -> DataFrame:
    """(block, found, later) for each block with repeated windows of `length`: hashes of the repeated windows, or, at the target, the place
    of each one's first occurrence in the block, and a bit that is set where the same words also start earlier, before that block's."""
    wide, decides = length >= target, length == target
    kind = held.schema["ids"].dataType.elementType
    id_list = pa.list_(_arrow_type(kind))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            p = Piece(row)
            at, hashes, _ = _candidates(p, length, target)
            order, bounds, first = _classes(hashes)
            many = np.diff(np.append(bounds, len(order))) > 1
            if decides:     # of equal windows of a block the earliest one speaks for it: smallest id (null before all), then smallest start
                ranks = _ranks(row["ids"])
                doc, pos = ranks[p.docs[p.passage[at]]], p.position(at)
                order = np.lexsort([pos, doc, *hashes[::-1]])
                first = order[bounds] if len(order) else order
            lead = hashes[0][first]
            bucket = (lead % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by])) + 1
            if not len(by):
                continue
            parts = np.split(by, cuts)
            sent = [first[part] for part in parts]
            cols = [pa.array(bucket[by[np.concatenate(([0], cuts))]]), pa.array(np.full(len(parts), row["block"])),
                    pa.array([np.stack([h[own] for h in hashes], 1).tobytes() for own in sent], pa.binary()), pa.array([np.packbits(many[part]).tobytes() for part in parts], pa.binary())]
            if decides:
                ids = pa.array(row["ids"], id_list.value_type).take(pa.array(p.docs[p.passage[at[first[by]]]]))
                bounds_of = pa.array(np.concatenate(([0], cuts, [len(by)])), pa.int32())
                cols += [pa.ListArray.from_arrays(bounds_of, ids).cast(id_list), pa.array([p.position(at[own]).astype("<u4").tobytes() for own in sent], pa.binary()),
                         pa.array([at[own].astype("<u4").tobytes() for own in sent], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=fields.names)

    def resolve(group: pa.Table) -> pa.Table:
        k = 2 if wide else 1
        raw = [np.frombuffer(x, "<u8").reshape(-1, k) for x in group.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in raw])
        source = np.repeat(np.arange(len(raw)), sizes)
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group.column("many").to_pylist(), sizes)]).astype(bool)
        every = np.concatenate(raw)
        hashes = [every[:, i].astype(U64) for i in range(k)]
        order, bounds, _ = _classes(hashes)
        n = np.diff(np.append(bounds, len(order)))
        repeated = (n > 1) | np.maximum.reduceat(many[order], bounds)
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(n)), n)
        if decides:
            ids = group.column("ids").combine_chunks()
            rank = _ranks(ids.flatten())
            pos = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("pos").to_pylist()]).astype(np.int64)
            place = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("place").to_pylist()])
            sort = np.lexsort([pos, rank, which])
            lead = sort[bounds]                                     # the first occurrence of each class
            later = (rank != rank[lead][which]) | (pos != pos[lead][which])
        blocks, found, late = group.column("block").to_pylist(), [], []
        keep = repeated[which]
        for i, at in enumerate(np.split(np.arange(len(source)), np.cumsum(sizes)[:-1])):
            own = at[keep[at]]
            found.append((place[own].tobytes() if decides else every[own].tobytes()) if len(own) else None)
            late.append(np.packbits(later[own]).tobytes() if decides and len(own) else None)
        out = pa.table({"block": pa.array(blocks, pa.int64()), "found": pa.array(found, pa.binary()), "later": pa.array(late, pa.binary())})
        return out.filter(pc.is_valid(out.column("found")))

    fields = T.StructType().add("bucket", "long").add("block", "long").add("hashes", "binary").add("many", "binary")
    if decides:
        fields = fields.add("ids", T.ArrayType(kind)).add("pos", "binary").add("place", "binary")
    sent = held.mapInArrow(emit, fields)
    back = sent.groupBy("bucket").applyInArrow(resolve, "block long, found binary, later binary")
    return back.groupBy("block").agg(F.collect_list(F.struct("found", "later")).alias("back"))


def _ranks(ids) -> np.ndarray:
    """Ranks of ids of any ordered type, null before all others, equal ids alike."""
    ids = ids if isinstance(ids, (pa.Array, pa.ChunkedArray)) else pa.array(ids)
    if not len(ids):
        return np.empty(0, np.int64)
    if pa.types.is_null(ids.type):
        return np.zeros(len(ids), np.int64)
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _alive(row: dict, p: Piece, length: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of the words where a repeated window of `length` starts, and (at the target) of those whose words also start earlier; and, below
    the target, each word's anchor."""
    at, hashes, anchor = _candidates(p, length, target)
    alive, late = np.zeros(len(p.passage), bool), np.zeros(len(p.passage), bool)
    if length == target:
        order, bounds, _ = _classes(hashes)
        n = np.diff(np.append(bounds, len(order)))
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(n)), n)
        place = np.concatenate([np.frombuffer(x["found"], "<u4") for x in row["back"]]).astype(np.int64)
        later = np.concatenate([np.unpackbits(np.frombuffer(x["later"], np.uint8), count=len(x["found"]) // 4) for x in row["back"]]).astype(bool)
        index = np.searchsorted(at, place)
        repeated = np.zeros(len(n), bool)
        repeated[which[index]] = True
        rank, pos = _ranks(row["ids"])[p.docs[p.passage[at]]], p.position(at)
        lead = np.zeros(len(n), np.int64)
        lead[which[index]] = index
        own = lead[which]
        first_here = (rank == rank[own]) & (pos == pos[own])        # rows that repeat an id are equally early
        flagged = np.zeros(len(n), bool)
        flagged[which[index]] = later
        mark = repeated[which]
        late[at[mark & (flagged[which] | ~first_here)]] = True
    else:
        k = len(hashes)
        known = np.concatenate([np.frombuffer(x["found"], "<u8").reshape(-1, k) for x in row["back"]]).astype(U64)
        mark = pc.is_in(_keys(np.stack(hashes, 1)), value_set=_keys(known)).to_numpy(zero_copy_only=False)
    alive[at[mark]] = True
    return alive, late, anchor


def _keys(hashes: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as binary keys of one width."""
    raw = np.ascontiguousarray(hashes)
    return pa.Array.from_buffers(pa.binary(raw.shape[1] * 8), len(raw), [None, pa.py_buffer(raw)])


def _runs(cover: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of covered words, which end with their passage."""
    same = passage[1:] == passage[:-1]
    begin = np.flatnonzero(cover & ~np.concatenate(([False], cover[:-1] & same)))
    end = np.flatnonzero(cover & ~np.concatenate((cover[1:] & same, [False]))) + 1
    return begin, end


def _covered(starts: np.ndarray, reach: int, n: int) -> np.ndarray:
    """Of n words those within `reach` words from a start; starts are sorted and distinct."""
    delta = np.zeros(n + 1, np.int64)
    delta[starts] += 1
    delta[starts + reach] -= 1
    return np.cumsum(delta[:-1]) > 0


STEP = ", deep binary, s_docs binary, s_from binary, s_to binary"


def _trim(held: DataFrame, alive: DataFrame, length: int, target: int, scratch: Scratch) -> DataFrame:
    """What a level leaves of each block: the passages with candidates for the next length, which are marked (wanted windows over repeated anchors,
    then pairs of neighbouring repeated windows); from the target on, `deep`, the documents with a repeated window of `length`; at the
    target, the runs of words that later windows cover."""
    id_list = pa.list_(_arrow_type(held.schema["ids"].dataType.elementType))
    want = held.sparkSession.createDataFrame([], PIECES.format(held.schema["ids"].dataType.elementType.simpleString()) + STEP).schema

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda x: x.astype("<u4").tobytes()
        for row in _rows(batches):
            p = Piece(row)
            marks, late, at = _alive(row, p, length, target)
            if length < target:
                starts = np.flatnonzero(p.inside(target, len(at)) & marks[at])
                reach = target
            else:
                n = max(0, len(marks) - length)
                starts = np.flatnonzero(marks[:n] & marks[length:length + n] & (p.passage[:n] == p.passage[length:length + n]))
                reach = 2 * length
            pieces, deep, spans = [None] * 4, None, [None] * 3
            if len(starts):
                cover = _covered(starts, reach, len(marks))
                begin, end = _runs(cover, p.passage)
                words = p.text.split()
                flags = np.zeros(len(marks), bool)
                flags[starts] = True
                lines = [b" ".join(words[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
                pieces = [packed(p.docs[p.passage[begin]]), packed(p.position(begin)), zstandard.ZstdCompressor().compress(b"\n".join(lines)), np.packbits(flags[cover]).tobytes()]
            if length >= target:
                deep = packed(np.unique(p.docs[p.passage[np.flatnonzero(marks)]]))
            if late.any():
                begin, end = _runs(_covered(np.flatnonzero(late), target, len(marks)), p.passage)
                first = p.position(begin)
                spans = [packed(p.docs[p.passage[begin]]), packed(first), packed(first + end - begin)]
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["ids"]], id_list), *(pa.array([x], pa.binary()) for x in (*pieces, deep, *spans))], names=want.names)

    return scratch.save(held.join(alive, "block").mapInArrow(trim, want), "step")


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)


def _spans(held: DataFrame, alive: DataFrame, target: int, scratch: Scratch) -> DataFrame:
    """(block, docs, starts, ends) of the runs of words that later windows of the target length cover."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            p = Piece(row)
            late = np.flatnonzero(_alive(row, p, target, target)[1])
            if not len(late):
                continue
            delta = np.zeros(len(p.passage) + 1, np.int64)
            np.add.at(delta, late, 1)
            np.add.at(delta, late + target, -1)
            cover = np.concatenate(([False], np.cumsum(delta[:-1]) > 0, [False]))
            part = np.concatenate(([-1], p.passage, [-2]))
            edge = (cover[1:] != cover[:-1]) | (part[1:] != part[:-1]) & cover[1:] & cover[:-1]
            cuts = np.flatnonzero(edge)
            begin = cuts[cover[cuts + 1]]
            end = np.array([c for c in cuts if cover[c]], np.int64)
            first = p.position(begin)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *(pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (
                p.docs[p.passage[begin]], first, first + end - begin))], names=["block", "s_docs", "s_from", "s_to"])

    return scratch.save(held.join(alive, "block").mapInArrow(spans, "block long, s_docs binary, s_from binary, s_to binary"), "spans")


def without_repeats(docs: DataFrame, target: int = 20, id_col: str = "doc_id", text_col: str = "text", longest: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept, removed, longest) of every row.

    `kept` holds the words outside every window of `target` words that also starts earlier (in a row with a smaller id, or before it in
    the same row), joined by one space; `removed` lists the runs taken out as (from, to) word numbers, to excluded. Windows are judged on
    the texts as given. With `longest`, doubling goes on beyond the target until no candidates survive, and `longest` is the greatest of
    target, 2 target, 4 target ... words of which the row has a repeated window, 0 for none; without, it is null and doubling ends at the target.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return. A null text has no words. A null id
    comes before all others. Rows with one id are equally early: a window at the same place of both repeats neither. Rows that repeat
    wholly are therefore treated alike. An empty table gives an empty table. Other columns are not looked at. `target` must be even."""
    if target < 2 or target % 2:
        raise ValueError("target must be an even number of words")
    scratch = Scratch(docs.sparkSession, "repeats")
    id_type = docs.schema[id_col].dataType.simpleString()
    base = _pack(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), scratch, id_type)
    words = (docs.select(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0) // 6
    held, length, spans, deep = base, target // 2, None, []
    columns = held.columns
    while True:
        buckets = max(8, words // (6 * BUCKET_WINDOWS))
        alive = scratch.save(_found(held, length, target, buckets, id_type), "alive")
        if alive.isEmpty():
            break
        step = _trim(held, alive, length, target, scratch)
        scratch.forget(alive)
        if length == target:
            spans = step.where("s_docs is not null").select("block", "s_docs", "s_from", "s_to")
        if length >= target:
            if not longest:
                break
            deep.append(step.where("deep is not null").select("block", F.lit(length).cast("long").alias("length"), F.col("deep").alias("docs")))
        held, length = step.where("words is not null").select(*columns), 2 * length
        if held.isEmpty():
            break
    return _result(base, spans, deep, id_type, longest)


def _result(base: DataFrame, spans: DataFrame | None, deep: list[DataFrame], id_type: str, longest: bool) -> DataFrame:
    """Rows of the blocks again, with the runs to leave out taken from their words."""
    out = base.select("block", "ids", "words")
    empty = base.sparkSession.createDataFrame([], "block long, s_docs binary, s_from binary, s_to binary")
    out = out.join(spans if spans is not None else empty, "block", "left")
    levels = base.sparkSession.createDataFrame([], "block long, length long, docs binary")
    for d in deep:
        levels = levels.unionByName(d)
    out = out.join(levels.groupBy("block").agg(F.collect_list(F.struct("length", "docs")).alias("deep")), "block", "left")
    schema = f"id {id_type}, n_words long, n_removed long, kept string, removed array<struct<from: long, to: long>>, longest long"
    id_arrow = _arrow_type(base.schema["ids"].dataType.elementType)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lines = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n") if row["words"] else []
            lines = lines[:len(row["ids"])]
            docs, begin, end = ([] if row[c] is None else np.frombuffer(row[c], "<u4").tolist() for c in ("s_docs", "s_from", "s_to"))
            cut: dict[int, list[tuple[int, int]]] = {}
            for d, a, b in sorted(zip(docs, begin, end)):
                runs = cut.setdefault(d, [])
                if runs and a <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
                else:
                    runs.append((a, b))
            deepest = np.zeros(len(lines), np.int64)
            for x in row["deep"] or []:
                at = np.frombuffer(x["docs"], "<u4")
                deepest[at] = np.maximum(deepest[at], x["length"])
            for a in range(0, len(lines), 256):
                some = range(a, min(a + 256, len(lines)))
                n, gone, kept = [], [], []
                for i in some:
                    w = lines[i].split()
                    runs, left, last = cut.get(i, []), [], 0
                    for x, y in runs:
                        left += w[last:x]
                        last = y
                    n.append(len(w))
                    gone.append(sum(y - x for x, y in runs))
                    kept.append(b" ".join(left + w[last:] if runs else w).decode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["ids"][i] for i in some], id_arrow), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                     pa.array([[{"from": x, "to": y} for x, y in cut.get(i, [])] for i in some], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                     pa.array(deepest[a:a + len(some)] if longest else [None] * len(some), pa.int64())],
                    names=["id", "n_words", "n_removed", "kept", "removed", "longest"])

    return out.mapInArrow(rows, schema)


@query("op11_substring_doubling", r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20) t),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER p AS fd, first_value(s) OVER (PARTITION BY h ORDER BY doc_id, s) AS fs FROM win WINDOW p AS (PARTITION BY h)) t
         WHERE doc_id <> fd OR s <> fs),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM late, range(0, 20) r(k)),
kept AS (SELECT d.doc_id, len(w) AS n_words, n, list_filter(w, lambda x, i: NOT list_contains(g, i)) AS left_over
         FROM (SELECT d.doc_id, d.w, coalesce(g, []) AS g, coalesce(n, 0) AS n FROM d LEFT JOIN (SELECT doc_id, list(i) AS g, count(*) AS n FROM gone GROUP BY doc_id) x ON x.doc_id = d.doc_id) d)
SELECT doc_id, n_words, n AS n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept""")
def op11_substring_doubling(spark, sf):
    """Words of every document left after removing 20-word windows that also start earlier."""
    found = without_repeats(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
