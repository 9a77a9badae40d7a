"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at d <= 2h differing bits have a midpoint within h bits of both, so they share a variant when each emits every variant
within h. With h = 2 a 64-bit fingerprint has 1 + 64 + 2016 = 2081 variants.

A variant is not shuffled as a row. The buckets it is dealt by are a linear hash (xor of one column per set bit), so that a variant's
bucket is the bucket of its fingerprint xor that of the flipped bits. A bucket therefore gets the fingerprint once, packed with others,
and expands just those variants that fall into it, slice by slice of a finer hash, so that memory is bounded. Buckets become more where
one would hold too many fingerprints. Copies of one text have one fingerprint and are expanded once."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.llm.common import Scratch, components, query, small_or_shuffled, table

SEED = 42
TARGET = 2_000_000      # variants in memory at once
MOST = 4_000_000        # fingerprints of a bucket
PAIRS = 250_000         # pairs looked at in one step
CHUNK = 65_536          # shingles per step, bounds memory for very long texts
ROWS = 256              # texts per step: no more stand beside their Arrow batch at once, as objects, shingles or results


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, ROWS at a time."""
    for b in batches:
        yield from (b.slice(at, ROWS) for at in range(0, b.num_rows, ROWS))


def fingerprint(data: bytes, width: int = 4, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of UTF-8 bytes, A-Z lower-cased, repeats counted; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        hashes, total = [xxhash.xxh64_intdigest(text, seed)], 1
        counts = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").astype(np.int64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        total = len(words) - width + 1
        counts = np.zeros(64, np.int64)
        digest = xxhash.xxh64_intdigest
        for at in range(0, total, CHUNK):
            to = min(total, at + CHUNK)
            spans = zip(starts[at:to].tolist(), (ends[at + width - 1:to + width - 1] - 1).tolist())
            h = np.array([digest(text[s:e], seed) for s, e in spans], "<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; a null text counts as empty. Only the two columns are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            fps = np.fromiter((fingerprint(t or b"", width) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


class Ball:
    """Flip patterns of at most `half` bits, ordered by their r-bit bucket."""

    def __init__(self, bits: int, half: int, width: int = 64):
        self.bits, self.size = bits, 1 << bits
        rng = np.random.default_rng(20_011)
        self.columns = rng.integers(0, 1 << 30, width, dtype=np.int64) >> (30 - bits)     # fewer bits are a prefix of more
        self.bytes = np.zeros((-(-width // 8), 256), np.int64)                            # buckets of every value of every byte
        for i, c in enumerate(self.columns):
            self.bytes[i // 8] ^= (np.arange(256) >> i % 8 & 1) * c
        one = np.uint64(1) << np.arange(width, dtype=np.uint64)
        layers, sums = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)]
        top = [np.full(1, -1)]
        for _ in range(half):
            grown = [(p | one[i], s ^ self.columns[i], i) for p, s, t in zip(layers[-1], sums[-1], top[-1]) for i in range(t + 1, width)]
            layers.append(np.array([g[0] for g in grown], np.uint64))
            sums.append(np.array([g[1] for g in grown], np.int64))
            top.append(np.array([g[2] for g in grown]))
        flips, buckets = np.concatenate(layers), np.concatenate(sums)
        order = np.argsort(buckets, kind="stable")
        self.flips = flips[order]
        self.count = np.bincount(buckets, minlength=self.size).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.count)[:-1]))
        self.used = np.flatnonzero(self.count)

    def home(self, fps: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fps), np.int64)
        for i, of in enumerate(self.bytes):
            out ^= of[(fps >> np.uint64(8 * i) & np.uint64(255)).astype(np.uint8)]
        return out

    def sorted(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, their buckets) in order of the buckets."""
        home = self.home(fps)
        order = np.argsort(home, kind="stable")
        return fps[order], home[order]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(pairs: np.ndarray, positions: bool = False) -> np.ndarray:
    """A spanning forest of index pairs (k, 2), so that a bucket returns fewer links than it has fingerprints."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    kept = []
    for k, (a, b) in enumerate(pairs.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append(k)
    return np.array(kept, np.int64) if positions else pairs[kept]


def _met(ball: Ball, bucket: int, fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """The variants of the distinct `fps` that fall into this bucket: hash of the variant in the high bits, its owner in the `low` low ones,
    sorted, so that equal variants are neighbours. Fingerprints are in order of their buckets `home`: those that reach this bucket by
    some flips are looked up, and the others cost nothing."""
    want = ball.used ^ bucket
    first = np.searchsorted(home, want)
    n = np.searchsorted(home, want, "right") - first
    own = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
    slot = np.repeat(ball.used, n)
    reps = ball.count[slot]
    idx = np.repeat(own.astype(np.int32), reps)
    flip = np.arange(len(idx)) + np.repeat(ball.start[slot] - np.cumsum(reps) + reps, reps)
    variants = fps[idx] ^ ball.flips[flip]
    del flip
    low = np.uint64(max(1, int(len(fps)).bit_length()))
    keys = (variants * np.uint64(0x9E3779B97F4A7C15) >> low << low) | idx.astype(np.uint64)
    keys.sort()
    return keys, low


def bucket_links(ball: Ball, bucket: int, fps: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Links (k, 2) between distinct fingerprints that share a variant in this bucket, each verified at `radius` bits or fewer.

    All fingerprints that share a variant are within the radius of each other; links that join nothing new are left out."""
    keys, low = _met(ball, bucket, fps, home)
    same = np.flatnonzero(keys[1:] >> low == keys[:-1] >> low)
    if not len(same):
        return np.empty((0, 2), np.uint64)
    mask = (np.uint64(1) << low) - np.uint64(1)
    head = same + 1
    pairs = np.stack([keys[same] & mask, keys[head] & mask], 1).astype(np.int64)
    near = _popcount(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= radius
    extra = []
    if not near.all():  # unequal variants met under one hash: compare within those runs in full
        owner = (keys & mask).astype(np.int64)
        run = np.cumsum(np.concatenate(([1], (keys[1:] >> low != keys[:-1] >> low).astype(np.int64))))
        for r in np.unique(run[head[~near]]):
            own = np.unique(owner[np.searchsorted(run, r):np.searchsorted(run, r, "right")])
            for i in range(len(own) - 1):
                hit = own[i + 1:][_popcount(fps[own[i + 1:]] ^ fps[own[i]]) <= radius]
                extra.append(np.stack([np.full(len(hit), own[i]), hit], 1))
    pairs = np.concatenate([pairs[near], *extra])
    pairs = np.unique(np.sort(pairs, 1), axis=0)
    return fps[pairs[pairs[:, 0] != pairs[:, 1]]]


def _middle(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Unequal bits of each pair a <= b, and the variant halfway along them."""
    rest = a ^ b
    bits = _popcount(rest)
    middle = a.copy()
    for k in range((radius + 1) // 2):
        step = np.where(2 * k < bits, rest & (~rest + np.uint64(1)), np.uint64(0))
        middle ^= step
        rest ^= step
    return bits, middle


def _middle_pairs(fps: np.ndarray, keys: np.ndarray, low: np.uint64, radius: int) -> Iterator[np.ndarray]:
    """All pairs (k, 2) of fingerprints of one run of `keys` whose middle variant, halfway along the unequal bits, is the run's own.

    Runs are expanded in steps of about PAIRS pairs; a run has at most as many fingerprints as a ball has variants."""
    owner = (keys & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int32)
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] >> low != keys[:-1] >> low)))
    ends = np.concatenate((begins[1:], [len(keys)]))
    later = np.repeat(ends, ends - begins) - np.arange(len(keys)) - 1    # partners of a key are those after it in its run
    upto, at = np.cumsum(later), 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = later[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        a, b = fps[owner[i]], fps[owner[j]]
        a, b = np.minimum(a, b), np.maximum(a, b)      # the middle lies on the way from the smaller one, in whatever bucket they meet
        bits, middle = _middle(a, b, radius)
        own = (bits <= radius) & (bits > 0) & (middle * np.uint64(0x9E3779B97F4A7C15) >> low == keys[i] >> low)
        if own.any():
            yield np.stack([a[own], b[own]], 1)
        at = to


def _slices(bits: int, half: int, width: int, bucket: int, fps: np.ndarray, target: int) -> Iterator[tuple[Ball, int, np.ndarray, np.ndarray]]:
    """A bucket's variants in slices of about `target`: a slice is a bucket of a finer hash. Fingerprints are hashed and sorted once for all."""
    ball = _ball(bits, half, width)
    total = int(ball.count[ball.home(fps) ^ bucket].sum())
    more = max(0, int(np.ceil(np.log2(max(1, total / target)))))
    ball = _ball(bits + more, half, width)
    fps, home = ball.sorted(fps)
    for k in range(1 << more):
        yield ball, bucket << more | k, fps, home


def sliced_links(bits: int, half: int, width: int, bucket: int, fps: np.ndarray, radius: int, target: int) -> np.ndarray:
    """Links of a bucket but those that join nothing new."""
    found = [bucket_links(ball, part, own, home, radius) for ball, part, own, home in _slices(bits, half, width, bucket, fps, target)]
    pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0)
    return pairs[_forest(np.searchsorted(np.unique(pairs), pairs), True)] if len(pairs) else pairs


def every_link(bits: int, half: int, width: int, bucket: int, fps: np.ndarray, radius: int, target: int) -> Iterator[np.ndarray]:
    """All pairs whose middle variant falls into the bucket, once each, step by step: nothing but one slice and one step is held."""
    for ball, part, own, home in _slices(bits, half, width, bucket, fps, target):
        keys, low = _met(ball, part, own, home)
        # only variants that two fingerprints share make pairs; a key twice is one fingerprint under two variants of one hash
        met = keys[1:] >> low == keys[:-1] >> low
        if met.any():
            keys = keys[np.concatenate((met, [False])) | np.concatenate(([False], met))]
            yield from _middle_pairs(own, keys[np.concatenate(([True], keys[1:] != keys[:-1]))], low, radius)


def nearest_links(bits: int, half: int, width: int, bucket: int, fps: np.ndarray, radius: int, target: int) -> Iterator[np.ndarray]:
    """Of the pairs of `every_link` at least that of each fingerprint and the smallest one within the radius: only the smallest
    of the fingerprints that share a variant is paired with the others, so that work and pairs do not grow with their square.

    In the run of the middle of a pair the smallest fingerprint is a neighbour of both, hence the smallest neighbour itself."""
    for ball, part, own, home in _slices(bits, half, width, bucket, fps, target):
        keys, low = _met(ball, part, own, home)
        met = keys[1:] >> low == keys[:-1] >> low
        if not met.any():
            continue
        keys = keys[np.concatenate((met, [False])) | np.concatenate(([False], met))]
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] >> low != keys[:-1] >> low)))
        n = np.diff(np.concatenate((begins, [len(keys)])))
        b = own[(keys & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)]
        a = np.repeat(np.minimum.reduceat(b, begins), n)
        unequal, middle = _middle(a, b, radius)
        ok = (unequal > 0) & (unequal <= radius) & (middle * np.uint64(0x9E3779B97F4A7C15) >> low == keys >> low)
        if ok.any():
            yield np.unique(np.stack([a[ok], b[ok]], 1), axis=0)
        far = np.repeat(np.logical_or.reduceat(unequal > radius, begins), n)
        if far.any():   # unequal variants met under one hash: all pairs of those runs
            keys = keys[far]
            yield from _middle_pairs(own, keys[np.concatenate(([True], keys[1:] != keys[:-1]))], low, radius)


def member_pairs(bits: int, half: int, width: int, bucket: int, items: np.ndarray, radius: int, target: int, similarity: float) -> Iterator[np.ndarray]:
    """Pairs (k, 2) of nodes of different roots whose fingerprints are equal or have their middle in this bucket, but those that cannot reach
    the similarity. `items`: rows (fp, node, root, size and words of parities).

    Words that differ in a bit have an odd number of shingles there in one set alone, so unequal bits are a lower bound of the shingles
    that the sets do not share, as is the difference of their sizes. Members are compared in steps of about PAIRS."""
    items = items[np.argsort(items[:, 0], kind="stable")]
    fps, first, n = np.unique(items[:, 0], return_index=True, return_counts=True)
    low, high = np.minimum.reduceat(items[:, 2], first), np.maximum.reduceat(items[:, 2], first)
    size = items[:, 3].astype(np.int64)

    def compared(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
        """Members of the fingerprints x with those of y, by position."""
        keep = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
        x, y = x[keep], y[keep]
        for at, to in _cuts(n[x], PAIRS):
            i = np.repeat(first[x[at:to]] - np.cumsum(n[x[at:to]]) + n[x[at:to]], n[x[at:to]]) + np.arange(n[x[at:to]].sum())
            of = np.repeat(y[at:to], n[x[at:to]])
            for p, q in _cuts(n[of], PAIRS):
                m = n[of[p:q]]
                a, b = np.repeat(i[p:q], m), np.repeat(first[of[p:q]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                ok = (items[a, 2] != items[b, 2]) & ((a < b) | (items[a, 0] != items[b, 0]))
                a, b = a[ok], b[ok]
                apart = np.maximum(np.bitwise_count(items[a, 4:] ^ items[b, 4:]).sum(1, dtype=np.int64), np.abs(size[a] - size[b]))
                both = size[a] + size[b]
                ok = apart * (1 + similarity) <= both * (1 - similarity + 1e-9)
                if ok.any():
                    yield np.stack([items[a[ok], 1], items[b[ok], 1]], 1)

    own = np.flatnonzero((low != high) & (_ball(bits, half, width).home(fps) == bucket))
    yield from compared(own, own)
    for pairs in every_link(bits, half, width, bucket, fps, radius, target):
        yield from compared(np.searchsorted(fps, pairs[:, 0]), np.searchsorted(fps, pairs[:, 1]))


def _cuts(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of positions whose counts add up to about `most`; at least one position each."""
    upto, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _bits(n: int, half: int, width: int, least_bits: int) -> int:
    per = sum(comb(width, k) for k in range(half + 1))
    return least_bits if n <= MOST else int(min(22, max(least_bits, np.ceil(np.log2(n * per / MOST)))))


def _packed(rows: DataFrame, columns: list[str], bits: int, half: int, width: int) -> DataFrame:
    """(part, bucket, rows): each row once for each bucket that a variant of its fingerprint, the first of the long `columns`, falls into."""
    k = len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball(bits, half, width)
        chunk = int(max(256, min(CHUNK, 8_000_000 // len(ball.used) // k)))
        held: dict[int, list[np.ndarray]] = {}

        def out(part: int, block: np.ndarray) -> Iterator[pa.RecordBatch]:
            to = (ball.home(block[:, 0])[:, None] ^ ball.used[None, :]).ravel()
            order = np.argsort(to, kind="stable")
            to, owner = to[order], order // len(ball.used)
            cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            ends = np.concatenate((cuts[1:], [len(to)]))
            for at in range(0, len(cuts), 4096):
                own = to[cuts[at:at + 4096]]
                blobs = [block[owner[x:y]].tobytes() for x, y in zip(cuts[at:at + 4096].tolist(), ends[at:at + 4096].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part), pa.int32()), pa.array(own), pa.array(blobs, pa.binary())], ["part", "bucket", "rows"])

        for b in batches:
            parts = b.column(0).to_numpy(zero_copy_only=False)
            fresh = np.stack([b.column(1 + c).to_numpy(zero_copy_only=False).view(np.uint64) for c in range(k)], 1)
            for p in np.unique(parts).tolist():
                held.setdefault(p, []).append(fresh[parts == p])
                while sum(map(len, held[p])) >= chunk:
                    block = np.concatenate(held[p])
                    held[p] = [block[chunk:]]
                    yield from out(p, block[:chunk])
        for p, rest in held.items():
            if len(block := np.concatenate(rest)):
                yield from out(p, block)

    return rows.select("part", *columns).mapInArrow(pack, "part int, bucket long, rows binary")


def _unpacked(batches: Iterator[pa.RecordBatch], k: int) -> np.ndarray:
    """The distinct rows of a bucket, (n, k), as they were packed."""
    own = np.empty((0, k), np.uint64)
    for b in batches:
        own = np.concatenate([own, *(np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, k) for x in b.column(b.schema.get_field_index("rows")))])
        own = np.unique(own[:, 0])[:, None] if k == 1 else own
    return own


def ball_links(fps: DataFrame, n: int, radius: int = 4, target: int = TARGET, width: int = 64, forest: bool = True, least_bits: int = 7, nearest: bool = False) -> DataFrame:
    """Links (part, a, b) between the distinct fingerprints `fps` (part int, fp long of `width` bits) at `radius` or fewer bits within a part.

    With `forest` their components are those of all such pairs; without it they are all such pairs, or with `nearest` enough of them that
    each fingerprint which has any is in one. `n` is the number of fingerprints of a part and decides the number of buckets only: enough
    for parallel work, and more where a bucket would hold over MOST fingerprints. `target` bounds the variants in memory at once."""
    half = (radius + 1) // 2
    bits = _bits(n, half, width, least_bits)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bucket = (x.as_py() for x in key)
        own = _unpacked(batches, 1)[:, 0]
        for links in ([sliced_links(bits, half, width, bucket, own, radius, target)] if forest else (nearest_links if nearest else every_link)(bits, half, width, bucket, own, radius, target)):
            x = links.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part), pa.int32()), pa.array(x[:, 0]), pa.array(x[:, 1])], ["part", "a", "b"])

    return _packed(fps, ["fp"], bits, half, width).groupBy("part", "bucket").applyInArrow(meet, "part int, a long, b long")


def ball_members(items: DataFrame, n: int, similarity: float, radius: int, target: int, width: int, least_bits: int) -> DataFrame:
    """Pairs (a, b) of nodes, repeated over parts, of different roots that collide in a part and may reach the similarity (`member_pairs`).
    items: part int and the longs fp, node, root, size, p0 to p3, one row per node and part; `n` as in `ball_links`."""
    half, columns = (radius + 1) // 2, ["fp", "node", "root", "size", *PARITIES]
    bits = _bits(n, half, width, least_bits)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in member_pairs(bits, half, width, key[1].as_py(), _unpacked(batches, len(columns)), radius, target, similarity):
            x = pairs.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    return _packed(items, columns, bits, half, width).groupBy("part", "bucket").applyInArrow(meet, "a long, b long")


_BALLS: dict[tuple[int, int, int], Ball] = {}


def _ball(bits: int, half: int, width: int) -> Ball:
    if (bits, half, width) not in _BALLS:
        _BALLS[bits, half, width] = Ball(bits, half, width)
    return _BALLS[bits, half, width]


def simhash_components(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET) -> DataFrame:
    """(id, fp, component, members): fingerprint of every row and the smallest id reachable over links at `radius` or fewer bits.

    Rows with equal fingerprints are one node, so groups of copies of any size cost one row per task and no pairs. Null and empty texts
    have fingerprint zero and link like any other; ids may repeat (each row is returned); a null id never names a component unless all
    its rows have none. An empty table gives an empty result; other columns of `docs` are not looked at."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marks = scratch.save(fingerprints(docs, width, id_col, text_col), "marks")
    nodes = scratch.save(marks.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")), "nodes")
    spread = nodes.select(F.lit(0).alias("part"), "fp").repartition(nodes.sparkSession.sparkContext.defaultParallelism)
    links = ball_links(spread, nodes.count(), radius, target)
    parts = components(links.select("a", "b"), scratch).select(F.col("node").alias("fp"), "root")
    # components of linked fingerprints; the others are their own
    tagged = nodes.join(parts, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = tagged.groupBy("root").agg(F.min("first").alias("component"), F.sum("rows").alias("members"))
    named = scratch.save(tagged.join(best, "root").select("fp", "component", "members"), "named")
    return marks.join(named, "fp").select("id", "fp", "component", "members")


TABLES, TABLE_BITS = 12, 40
PARITIES = ["p0", "p1", "p2", "p3"]     # whether a set has an odd number of shingles under each of 256 hashes, as words
WORDS = 8               # 64-bit words of a sketch, of which TABLES * TABLE_BITS bits are dealt to tables
FAR = 0.25              # share of unequal sketch bits beyond which a pair is not compared further; cosine 0.88 has 0.16 on average


def shingle_hashes(data: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included: the whole sequence if it is shorter, none without words."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(text, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - width + 1].tolist()
    return np.array([xxhash.xxh64_intdigest(text[s:e], seed) for s, e in zip(starts, (ends[width - 1:] - 1).tolist())], np.uint64)


def parities(h: np.ndarray) -> np.ndarray:
    """The PARITIES of a set of shingle hashes."""
    odd = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=64 * len(PARITIES)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def sketch(h: np.ndarray) -> np.ndarray:
    """A SimHash of WORDS * 64 bits of a set of shingle hashes: each is mixed anew for every word."""
    out = np.zeros(WORDS, np.uint64)
    for k in range(WORDS if len(h) else 0):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), CHUNK):
            x = h[at:at + CHUNK] ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            counts += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


def table_fingerprints(sketches: np.ndarray) -> np.ndarray:
    """(rows, TABLES) fingerprints of TABLE_BITS bits from (rows, WORDS) sketches."""
    bits = np.unpackbits(sketches.view(np.uint8).reshape(len(sketches), -1), axis=1, bitorder="little")[:, :TABLES * TABLE_BITS].reshape(len(sketches), TABLES, TABLE_BITS)
    wide = np.zeros((len(sketches), TABLES, 64), np.uint8)
    wide[:, :, :TABLE_BITS] = bits
    return np.packbits(wide, axis=2, bitorder="little").view("<u8")[:, :, 0]


def similar_links(docs: DataFrame, scratch: Scratch, similarity: float = 0.8, width: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(marks (id, node) of every row, links (a, b) between nodes whose sets of word shingles have a Jaccard similarity of `similarity` or more).
    The components of the links are those of all such pairs that collide in a table.

    A node is a text, by its 64-bit hash. One fingerprint of 64 bits at 4 bits finds only pairs that are nearly equal, so the ball is cast in
    TABLES tables of TABLE_BITS-bit fingerprints each: a pair at Jaccard 0.8 is within 4 bits in a quarter of them, and missed by all in
    about 1 of 40. Texts collide in a table if their fingerprints are equal or within the radius. The members of each fingerprint are first
    verified against their smallest node; then all colliding pairs that these links do not connect yet are compared where they meet, by
    sizes and parities, which never rule out a pair at the similarity. Pairs that remain are deduplicated, dropped if their sketches
    differ in more than FAR of the bits, and verified by their whole shingle sets."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            sets = (np.unique(shingle_hashes(t, width)) for t in b.column(2).cast(pa.binary()).to_pylist())
            x = np.array([np.concatenate((sketch(h), parities(h), [np.uint64(len(h))])) for h in sets], np.uint64).reshape(b.num_rows, len(marked)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(marked)))], ["id", "node", *marked])

    words = [f"s{k}" for k in range(WORDS)]
    marked = [*words, *PARITIES, "size"]
    marks = scratch.save(src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, node long, " + ", ".join(f"{w} long" for w in marked)), "sketches")
    nodes = scratch.save(marks.groupBy("node").agg(*[F.min(w).alias(w) for w in marked]), "nodes")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(1 + k).to_numpy(zero_copy_only=False) for k in range(WORDS)], 1).view(np.uint64)
            f = table_fingerprints(np.ascontiguousarray(x)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), TABLES)), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), b.num_rows)), pa.array(f.ravel())], ["node", "part", "fp"])

    rows = scratch.save(nodes.select("node", *words).mapInArrow(deal, "node long, part int, fp long"), "rows")
    side = lambda c: nodes.select(F.col("node").alias(c), *[F.col(w).alias(f"{c}_{w}") for w in words])
    unequal = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words[1:]), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Of pairs (a, b), in any order and repeated, those at the similarity."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        pairs = scratch.save(pairs.join(side("a"), "a").join(side("b"), "b").where(unequal <= int(FAR * 64 * WORDS)).select("a", "b"), f"{label}_pairs")
        wanted = scratch.save(pairs.select(F.col("a").alias("node")).distinct().unionAll(pairs.select("b").distinct()).distinct(), f"{label}_wanted")
        sets = src.select("node", "text").join(small_or_shuffled(wanted), "node", "left_semi").mapInArrow(shingles, "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set"))
        sets = scratch.save(sets, f"{label}_sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - shared
        out = scratch.save(both.where((union == 0) | (shared >= union * similarity)).select("a", "b"), f"{label}_links")
        scratch.forget(pairs, wanted, sets)
        return out

    groups = scratch.save(rows.groupBy("part", "fp").agg(F.min("node").alias("low"), F.max("node").alias("high")), "groups")
    stars = verified(rows.join(groups.where("low <> high"), ["part", "fp"]).select(F.col("low").alias("a"), F.col("node").alias("b")), "star")
    rooted = rows.join(components(stars, scratch), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # fingerprints that have another one near, or members that are not connected; only these are compared member by member
    near = scratch.save(ball_links(groups.select("part", "fp"), nodes.count(), radius, TARGET // 4, TABLE_BITS, forest=False, least_bits=5, nearest=True), "near")
    apart = rooted.groupBy("part", "fp").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("part", "fp")
    wanted = scratch.save(near.select("part", F.col("a").alias("fp")).unionByName(near.select("part", F.col("b").alias("fp"))).unionByName(apart).distinct(), "near_fps")
    items = rooted.join(small_or_shuffled(wanted), ["part", "fp"], "left_semi").join(nodes.select("node", "size", *PARITIES), "node")
    others = verified(ball_members(items, nodes.count(), similarity, radius, TARGET // 4, TABLE_BITS, 5), "other")
    scratch.forget(rows, groups, near, wanted)
    return marks.select("id", "node"), stars.unionByName(others)


def near_deduplicated(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns: of texts connected by links at `similarity` or more, the one with the smallest id.

    Null ids come last. Null, empty and white-space texts are alike. Rows that repeat both id and text share their fate. An empty table gives
    an empty result; other columns are only passed on."""
    scratch = Scratch(docs.sparkSession, "similar")
    marks, links = similar_links(docs, scratch, similarity, width, 4, id_col, text_col)
    rooted = marks.join(components(links, scratch), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    gone = rooted.join(first, "root").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node"))))
    gone = scratch.save(gone.select(F.col("id").alias("_id"), F.col("node").alias("_node")).distinct(), "gone")
    keyed = docs.withColumn("_mark", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return keyed.join(small_or_shuffled(gone), (F.col("_mark") == F.col("_node")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_anti").select(*docs.columns)


@query("op10_simhash_ball")
def op10_simhash_ball(spark, sf):
    """One row per document: fingerprint as 16 hexadecimal digits and the smallest doc_id of its component at 4 or fewer bits."""
    found = simhash_components(table(spark, sf, "documents"), radius=4, width=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"), F.col("members"))
