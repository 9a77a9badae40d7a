"""Repeated passages against brute force."""

import random

import pytest

from slidemesh.llm import substring_dedup
from slidemesh.llm.substring_dedup import without_repeats


def brute(rows, size):
    """{row: (words, removed runs as a set of word numbers, longest repeated level)} from the definition."""
    words = [(t or "").encode().split() for _, t in rows]
    key = [(i is not None, i or 0) for i, _ in rows]

    def windows(length):
        seen = {}
        for r, w in enumerate(words):
            for s in range(len(w) - length + 1):
                seen.setdefault(tuple(w[s:s + length]), []).append((key[r], s, r))
        return seen
    gone, longest, length = [set() for _ in rows], [0] * len(rows), size
    for occ in windows(size).values():
        first = min(o[:2] for o in occ)
        for k, s, r in occ:
            if (k, s) > first:
                gone[r].update(range(s, s + size))
    while True:
        hit = [o for o in windows(length).values() if len(o) > 1]
        if not hit:
            return words, gone, longest
        for occ in hit:
            for _, _, r in occ:
                longest[r] = length
        length *= 2


def check(spark, df, size):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    words, gone, longest = brute(rows, size)
    want = sorted((str(i), len(w), len(g), b" ".join(x for k, x in enumerate(w) if k not in g).decode(), n) for (i, _), w, g, n in zip(rows, words, gone, longest))
    got = without_repeats(df, size).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept, r.longest) for r in got) == want
    for r in got:
        assert sum(x["to"] - x["from"] for x in r.removed) == r.n_removed


def test_awkward_rows(spark, docs, none):
    small = docs.where("doc_id is null or doc_id <> 11")
    check(spark, small, 4)
    check(spark, small, 20)
    assert without_repeats(none).count() == 0
    with pytest.raises(ValueError):
        without_repeats(none, 5)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_planted_passages(spark, monkeypatch, block):
    """Passages at every offset, cut at either end, nested, overlapping themselves, in one block and over many."""
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(60):
        a, b = sorted(rnd.sample(range(91), 2))
        rows.append((rnd.randrange(40) if i % 9 else None, " ".join([f"u{rnd.randrange(9)}" for _ in range(rnd.randrange(30))] + passage[a:b] + [f"u{rnd.randrange(9)}" for _ in range(rnd.randrange(30))])))
    rows += [(100 + k, " \t".join(["again"] * (3 * k))) for k in range(12)] + [(200, None), (201, ""), (202, " ".join(passage) + " x\x1c " + " ".join(passage))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(spark, df, 8)
    check(spark, df, 20)


def test_long_text_repeats_itself(spark):
    text = " ".join(f"w{i % 3000}" for i in range(7000))
    r = without_repeats(spark.createDataFrame([(1, text), (2, "w1 w2 w3")], "doc_id string, text string")).where("id = '1'").first()
    assert (r.n_words, r.n_removed, r.longest) == (7000, 4000, 2560)
    assert [tuple(x) for x in r.removed] == [(3000, 7000)]
