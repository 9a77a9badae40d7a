"""Operators on documents against brute force, over rows of every awkward kind."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slidemesh.llm import bpe, exact_dedup, mixing, quality_qda, sharding, simhash_ball
from slidemesh.llm.common import Scratch, components


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def groups_of(n, near):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 3), (9, 8), (8, 7), (7, 6), (6, 9), (20, None), (30, 29)] + [(100 + i, 99 + i) for i in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    want = {5: 3, 4: 3, 9: 6, 8: 6, 7: 6, 30: 29} | {100 + i: 100 for i in range(1, 60)}
    assert got == want


def test_exact_groups(docs, none):
    rows = docs.select("doc_id", "text").collect()
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(norm(r.text), []).append(r.doc_id)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in by.items()}
    kept = Counter()
    for r in got:
        ids = sha[r.sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        if r.kept:
            kept[r.sha256] += 1
            assert r.id == r.keep_id
    assert all(kept[k] == 1 for k in sha)
    assert exact_dedup.exact_groups(none).count() == 0
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns and Counter(norm(r.text) for r in stay.collect()) == Counter(by.keys())
    assert exact_dedup.deduplicated(none).count() == 0


def test_counting_filters_merge_without_loss(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(-2**63, 2**63, 3000), np.repeat(rng.integers(-2**63, 2**63, 40), rng.integers(2, 90, 40)), [0, 0, -1, -1, 2**63 - 1]])
    rng.shuffle(values)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(7)
    got = {r.fp: r.n for r in exact_dedup.filter_counts(df, len(values), block_rows=20).collect()}
    assert got == {k: v for k, v in Counter(values.tolist()).items() if v > 1}
    one = exact_dedup.CountingQuotientFilter.build(3, np.array([5, 9], np.uint64), np.array([1, 2]))
    both = one.merge([exact_dedup.CountingQuotientFilter.build(3, np.array([9, 11], np.uint64), np.array([4, 1]))])
    assert both.keys().tolist() == [5, 9, 11] and both.counts.tolist() == [1, 6, 1]


def test_shards(spark, docs, none):
    out = sharding.byte_shards(docs, 4, slots=64).collect()
    rows = docs.select("doc_id", "text").collect()
    assert Counter((r.id, r.size, r.text_crc32) for r in out) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    for k in range(4):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    assert sharding.byte_shards(none, 4, slots=64).count() == 0


def test_slot_maps_balance_and_grow(spark, tmp_path):
    sizes = [(i, (i * 7919) % 101 + 1) for i in range(500)]
    stats = spark.createDataFrame([(i, b, 1) for i, b in sizes], "vslot int, bytes long, rows long")
    first = sharding.first_map(stats, 5)
    sharding.write_map(first, str(tmp_path / "map"))
    shard = {r.vslot: r.shard for r in sharding.read_map(spark, str(tmp_path / "map")).collect()}
    loads = Counter()
    for i, b in sizes:
        loads[shard[i]] += b
    assert set(shard) == set(range(500)) and max(loads.values()) - min(loads.values()) <= 8
    sharding.write_map(sharding.edited_map(sharding.read_map(spark, str(tmp_path / "map")), stats, 6, 2), str(tmp_path / "map"))
    grown = {r.vslot: r.shard for r in sharding.read_map(spark, str(tmp_path / "map")).collect()}
    moved = [i for i in shard if shard[i] != grown[i]]
    assert moved and all(grown[i] == 5 for i in moved)
    new = Counter()
    for i, b in sizes:
        new[grown[i]] += b
    assert max(new.values()) <= 1.03 * sum(new.values()) / 6 + 101
    assert {r.vslot: r.shard for r in sharding.read_map(spark, str(tmp_path / "map"), 1).collect()} == shard


def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, none):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    root = groups_of(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    ids = {}
    for k, r in zip(root, rows):
        ids.setdefault(k, []).append(r.doc_id)
    want = Counter((r.doc_id, fps[i] - (1 << 64 if fps[i] >> 63 else 0), min((x for x in ids[root[i]] if x is not None), default=None)) for i, r in enumerate(rows))
    assert Counter((r.id, r.fp, r.component) for r in simhash_ball.simhash_components(docs).collect()) == want
    assert simhash_ball.simhash_components(none).count() == 0


@pytest.mark.parametrize("width,radius,target", [(64, 4, 50_000), (64, 3, 4_000_000), (40, 4, 20_000)])
def test_ball_finds_every_pair(spark, width, radius, target):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 62, 150, dtype=np.uint64)
    fps = [int(b) & (1 << width) - 1 for b in base]
    for b in list(fps):
        for _ in range(3):
            x = b
            for bit in rng.choice(width, rng.integers(1, 8), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash_ball.ball_links(spark.createDataFrame([(0, f) for f in signed], "part int, fp long"), len(fps), radius, target, width, forest=width == 64)
    root = groups_of(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= radius)
    got = {r.node: r.root for r in components(links.select("a", "b"), Scratch(spark, "t")).collect()}
    seen = {}
    for i, f in enumerate(signed):
        assert seen.setdefault(root[i], got.get(f, f)) == got.get(f, f)
    assert len(set(seen.values())) == len(seen)


def test_dense_fingerprints_keep_every_pair():
    """Hundreds of fingerprints around one another: each pair within the radius is returned, once, whatever the memory target."""
    rng = np.random.default_rng(11)
    fps = {0x12_3456_789A}
    while len(fps) < 500:
        x = int(rng.choice(sorted(fps)[:40]))
        for bit in rng.choice(40, rng.integers(1, 4), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1:] if int(a ^ b).bit_count() <= 4}
    assert len(want) > 5 * len(fps)
    for bits, target in ((0, 50_000), (4, 2_000_000), (5, 1_000)):
        got = [tuple(map(int, p)) for k in range(1 << bits) for x in simhash_ball.every_link(bits, 2, 40, k, fps, 4, target) for p in x]
        assert len(got) == len(set(got)) and set(got) == want


def test_pairs_do_not_depend_on_the_number_of_buckets(spark, monkeypatch):
    """A dense group gives the same pairs in 16 and 32 buckets, and in the many of a part whose size is above MOST."""
    monkeypatch.setattr(simhash_ball, "MOST", 20_000)
    rng = np.random.default_rng(12)
    fps = sorted({int(np.bitwise_xor.reduce(1 << rng.choice(40, 3, replace=False))) for _ in range(300)})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 4}
    df = spark.createDataFrame([(3, f) for f in fps], "part int, fp long")
    for n, least in ((len(fps), 4), (len(fps), 5), (20_001, 4)):
        got = [(r.a, r.b) for r in simhash_ball.ball_links(df, n, 4, 50_000, 40, False, least).collect()]
        assert len(got) == len(want) and set(got) == want


def test_slices_do_not_hash_all_fingerprints_again(monkeypatch):
    """Slices grow with the fingerprints, so work per slice must not: each bucket hashes its fingerprints at most twice, for the same links."""
    fps = np.unique(np.random.default_rng(13).integers(0, 1 << 24, 3_000, dtype=np.uint64))
    hashed, own = [], simhash_ball.Ball.home
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1:][np.bitwise_count(fps[i + 1:] ^ a) <= 4]}
    monkeypatch.setattr(simhash_ball.Ball, "home", lambda self, x: hashed.append(len(x)) or own(self, x))
    got = [tuple(map(int, p)) for k in range(4) for x in simhash_ball.every_link(2, 2, 24, k, fps, 4, 2_000) for p in x]
    assert len(got) == len(want) and set(got) == want
    assert sum(hashed) <= 2 * 4 * len(fps)
    forest = np.concatenate([simhash_ball.sliced_links(2, 2, 24, k, fps, 4, 2_000) for k in range(4)])
    assert {(int(a), int(b)) for a, b in forest} <= want and sum(hashed) <= 4 * 4 * len(fps)


def test_nearest_links_name_every_fingerprint_that_has_neighbours():
    """Of a dense group far fewer links than all pairs, all of them true, and with each fingerprint's smallest neighbour among them."""
    rng = np.random.default_rng(14)
    fps = np.array(sorted({int(np.bitwise_xor.reduce(1 << rng.choice(40, 3, replace=False))) for _ in range(400)} | {int(x) for x in rng.integers(0, 1 << 40, 400)}), np.uint64)
    near = {int(a): [int(b) for b in fps[(np.bitwise_count(fps ^ a) <= 4) & (fps != a)]] for a in fps}
    got = {tuple(map(int, p)) for k in range(8) for x in simhash_ball.nearest_links(3, 2, 40, k, fps, 4, 20_000) for p in x}
    assert all(b in near[a] for a, b in got) and {x for p in got for x in p} == {a for a in near if near[a]}
    assert all((min(a, min(n)), max(a, min(n))) in got for a, n in near.items() if n) and 8 * len(got) < sum(map(len, near.values()))


def test_a_group_that_shares_little_is_not_joined_pair_by_pair(spark, monkeypatch):
    """200 variants of one text, of which few reach the similarity, in tables where all collide: only pairs that may reach it leave the buckets."""
    rng = np.random.default_rng(15)
    base = [f"c{x}" for x in range(140)]
    texts = []
    for k in range(100):
        words = [f"u{k}x{i}" if hit else w for i, (w, hit) in enumerate(zip(base, rng.random(140) < 0.05))]
        texts += [" ".join(words), " ".join(words[:-1] + [f"e{k}"])]

    def sets(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    own = [sets(t) for t in texts]
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])}
    root = groups_of(200, lambda i, j: (j, i) in want)
    tables, met, save = simhash_ball.TABLES, {}, Scratch.save
    monkeypatch.setattr(simhash_ball, "table_fingerprints", lambda x: np.repeat(x[:, :1] & np.uint64(3), tables, 1))
    monkeypatch.setattr(Scratch, "save", lambda self, df, label="t": met.update({label: save(self, df, label)}) or met[label])
    monkeypatch.setattr(Scratch, "forget", lambda *a: None)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks, links = simhash_ball.similar_links(df, Scratch(spark, "t"))
    assert met["other_pairs"].count() < 4 * len(want) < 200 * 199 / 2 / 4
    monkeypatch.setattr(Scratch, "save", save)
    assert sorted(r.doc_id for r in simhash_ball.near_deduplicated(df).collect()) == sorted(set(root))


def test_near_deduplicated(spark, docs, none):
    out = simhash_ball.near_deduplicated(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:9]) for r in out.collect())
    assert [k[1] for k in kept if not k[0]] == [1, 4, 8, 10, 11, 12, 13] and [k[2] for k in kept if k[0]] == ["no id her"]
    assert simhash_ball.near_deduplicated(none).count() == 0


def test_similar_links_verify_shingles(spark):
    rng = np.random.default_rng(3)
    texts = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        texts.append(" ".join(words))
        for edits in (1, 3, 8):
            copy = list(words)
            for at in rng.choice(150, edits, replace=False):
                copy[at] = f"e{k}{at}"
            texts.append(" ".join(copy))

    def sets(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    own = [sets(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks, links = simhash_ball.similar_links(df, Scratch(spark, "t"))
    of = {r.node: r.id for r in marks.collect()}
    got = {tuple(sorted((of[r.a], of[r.b]))) for r in links.collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_middle_members_of_a_group_meet(spark, monkeypatch):
    """Twelve tables in which all fingerprints are equal, or all of two linked groups: each planted pair is found, middle members too."""
    rng = np.random.default_rng(8)
    common = [f"c{x}" for x in range(100)]
    texts = []
    for k in range(20):
        words = common + [f"u{k}x{x}" for x in rng.integers(0, 5000, 25)]
        texts += [" ".join(words), " ".join(words[:-2] + [f"e{k}a", f"e{k}b"])]

    def sets(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    own = [sets(t) for t in texts]
    root = groups_of(len(texts), lambda i, j: len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]))
    assert len(set(root)) == 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables = simhash_ball.TABLES
    for fps in (lambda x: np.zeros((len(x), tables), np.uint64), lambda x: np.repeat(x[:, :1] & np.uint64(1), tables, 1)):
        monkeypatch.setattr(simhash_ball, "table_fingerprints", fps)
        assert sorted(r.doc_id for r in simhash_ball.near_deduplicated(df).collect()) == sorted(set(root))


def test_repeated_passage_does_not_hide_a_copy(spark):
    """A text and the same with a passage repeated 50 times have nearly one set of shingles."""
    words = [f"w{k}" for k in range(104)]
    texts = [" ".join(words), " ".join(words[:40] + words[20:40] * 50 + words[40:]), " ".join(f"v{k}" for k in range(104))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_ball.near_deduplicated(df).collect()) == [0, 2]


def test_bpe_equals_the_library(docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.vocabulary()
    ranks = bpe.read_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), r.text or ""] += 1
    assert Counter((r.id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.round_trip(docs, path, pattern).collect()) == want
    assert Counter((r.id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.decoded(bpe.encoded(docs, path, pattern), path).collect()) == want
    assert bpe.round_trip(none, path, pattern).count() == 0


def test_transducer_streams_and_bounds(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.vocabulary()
    ranks = bpe.read_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "MAX_STATES", 300)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 200)
    enc = bpe.Encoder(ranks, pattern)
    rng = np.random.default_rng(5)
    tokens = sorted(ranks)
    for _ in range(1500):
        text = b"".join(tokens[i] for i in rng.integers(0, len(tokens), 6)).decode("utf-8", "ignore") + " ".join(rng.choice(["the", "ab\n", "", " x", "'s", "՘'s", "１２"], 4))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode_ordinary(text)
        word = re.sub(r"[^a-z]", "", text.lower()) or "a"
        assert list(enc.transducer.run(word.encode(), check=5)) == enc.transducer._chain(*(lambda e: (e, len(e)))([t for _, t in enc.transducer.last_tokens(word.encode())]))
    for a, b in rng.integers(0, len(tokens), (3000, 2)):
        a, b = ranks[tokens[a]], ranks[tokens[b]]
        joined = enc.transducer.bytes_of[a] + enc.transducer.bytes_of[b]
        assert enc.transducer.may_follow(a, b) == (bpe.merge_ranks(joined, ranks) == [enc.transducer.bytes_of[a], enc.transducer.bytes_of[b]])
    out = bpe.StreamDecoder(enc.transducer.bytes_of)
    ids = library.encode_ordinary("漢字🙂é")
    assert "".join(out.feed([i]) for i in ids) + out.feed((), True) == "漢字🙂é"


def test_quality(spark, docs, none):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(rng.integers(5, 200))]
        rows.append((i, " ".join(words) + "." if i % 4 else " ".join(w.upper() + "!!" for w in words), int(i % 4 > 0)))
    d = spark.createDataFrame([r[:2] for r in rows] + [(None, "words here", ), (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 0), (3, None), (4, 5)], "doc_id long, quality int")
    out = {r.id: r for r in quality_qda.quality_scores(d, labels).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out == (i in held) for i in truth) and np.mean([out[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values()) and out[1000].score == out[1001].score and len(out) == len(rows) + 3
    kept = quality_qda.accepted(d.withColumn("score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_qda.quality_scores(docs, empty).collect()} == {0.5} and quality_qda.quality_scores(none, empty).count() == 0


def test_quality_model_is_the_shrunk_density():
    rng = np.random.default_rng(2)
    x = [rng.normal(k, 1 + k, (300, quality_qda.DIM)) for k in (0, 1)]
    moments = np.stack([(lambda a: a.T @ a)(np.c_[np.ones(len(v)), v]) for v in x])
    model = quality_qda.from_moments(moments, 0.4, 0.1)
    every = np.concatenate(x)
    z = [(v - every.mean(0)) / every.std(0) for v in x]
    pooled = sum(np.cov(v.T, bias=True) for v in z) / 2
    logs = []
    for k in (0, 1):
        cov = 0.6 * np.cov(z[k].T, bias=True) + 0.4 * pooled
        cov = 0.9 * cov + 0.1 * np.trace(cov) / len(cov) * np.eye(len(cov))
        d = (every - every.mean(0)) / every.std(0) - z[k].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp((logs[0] - logs[1]) / quality_qda.SOFTNESS))
    assert np.allclose(model.scores(every), want, atol=1e-3)


def test_raking(spark, docs, none):
    out = mixing.mixed(docs, 0.5)
    assert out.columns == [*docs.columns, "_mix"] and out.count() == docs.count()
    assert mixing.mixed(none, 0.5).count() == 0 and mixing.sampled(docs, 1.0).count() == docs.count()
    rng = np.random.default_rng(4)
    cells = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(50, 5000))) for a in range(5) for b in range(3) for c in range(4)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    want = {d: np.array(rng.uniform(1, 3, n)) for d, n in (("source", 5), ("lang", 3), ("topic", 4))}
    rows = [(d, f"{d[0]}{k}", float(v / w.sum())) for d, w in want.items() for k, v in enumerate(w)] + [("lang", "absent", 0.5)]
    got = mixing.raked(df, spark.createDataFrame(rows, "dim string, value string, target double"), Scratch(spark, "t"), tolerance=1e-7).collect()
    weight = np.array([c[3] for c in cells], float).reshape(5, 3, 4)
    for _ in range(200):
        for axis, d in enumerate(("source", "lang", "topic")):
            sums = weight.sum(tuple(k for k in range(3) if k != axis), keepdims=True)
            weight *= (want[d] / want[d].sum()).reshape([-1 if k == axis else 1 for k in range(3)]) / sums
    for r in got:
        assert abs(r.weight - weight[int(r.source[1:]), int(r.lang[1:]), int(r.topic[1:])]) < 1e-5
    priced = mixing.rates(spark.createDataFrame(got), 0.3).collect()
    total = sum(r.tokens for r in priced)
    assert abs(sum(r.tokens * r.rate for r in priced) / total - 0.3) < 1e-3 and all(0 < r.rate <= 1 for r in priced)


def test_tables_serve_the_next_task(spark):
    """A worker that has encoded texts still knows their words when the next task comes, unless it is asked not to keep them."""
    path, pattern = bpe.vocabulary()
    docs = spark.createDataFrame([(k, f"keptword{k} again") for k in range(40)], "doc_id long, text string").repartition(16)

    def known(batches):
        for b in batches:
            yield b.assign(id=max([0, *(len(e.words) for e in bpe._MADE.values())]))

    def most():
        return spark.range(16, numPartitions=16).mapInPandas(known, "id long").agg(F.max("id")).first()[0]

    assert bpe.encoded(docs, path, pattern).count() == 40
    assert bpe.encoded(docs, path, pattern).selectExpr("sum(n_tokens)").first()[0] > 80 and most() > 0


def test_an_encoder_that_is_not_kept_leaves_nothing(spark):
    """Its tables are smaller, its ids the same, and after the task its worker holds none of it, not even the vocabulary."""
    path, pattern = bpe.vocabulary()
    pattern += "|never"
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    texts = [f"leftword{k} über {'漢字' * (k % 5)} again, and 's {k * k}" for k in range(600)]
    whole, small = bpe.Encoder(ranks, pattern), bpe.Encoder(ranks, pattern, True)
    assert small.words.most < whole.words.most and small.transducer.most_states < whole.transducer.most_states
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    got = {r.id: (r.ids, r.decoded) for r in bpe.round_trip(docs, path, pattern, keep=False).collect()}
    assert got == {k: (whole.encode(t), t) for k, t in enumerate(texts)} == {k: (small.encode(t), t) for k, t in enumerate(texts)}

    def left(batches):
        import gc
        for b in batches:
            yield b.assign(id=sum(isinstance(x, bpe.Encoder) and x.pattern.pattern == pattern for x in gc.get_objects()))

    assert spark.range(16, numPartitions=16).mapInPandas(left, "id long").agg(F.max("id")).first()[0] == 0
