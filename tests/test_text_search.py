"""Containment, medians and what is built on them, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from slidemesh.operators import ocr


@pytest.mark.parametrize("rows", [100_000, 7])
def test_contained(spark, monkeypatch, rows):
    monkeypatch.setattr(ocr, "SLICE_ROWS", rows)
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("ab1") for _ in range(rnd.randrange(n)))
    needles = [(rnd.randrange(3), word(4)) for _ in range(60)] + [(0, None), (5, "a")]
    texts = [(rnd.randrange(4), i, word(30)) for i in range(50)] + [(1, 90, None), (2, 91, "ab" * 20_000)]
    got = ocr.contained(spark.createDataFrame(needles, "page int, n string"), spark.createDataFrame(texts, "page int, text_id int, text string"), ["page"]).collect()
    want = {(p, n, i) for p, n in needles for q, i, t in texts if p == q and n and t and n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_medians(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(5), float(rnd.randrange(9)) if rnd.random() < 0.9 else None, rnd.randrange(1, 4)) for _ in range(80)] + [(9, 4.0, 1), (10, None, 2)]
    counted = spark.createDataFrame(rows, "k int, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    values = {}
    for k, v, n in rows:
        values.setdefault(k, []).extend([v] * n if v is not None else [])
    got = {r.k: (r.median, r.total) for r in ocr.medians(counted, ["k"], "v", "n").collect()}
    assert got == {k: (statistics.median(v), len(v)) for k, v in values.items() if v}


def test_shape_heights(spark):
    shapes = spark.createDataFrame([(1, 0, "Alpha beta"), (1, 1, "x"), (1, 2, "!!")], "page int, shape_id int, text string")
    lines = spark.createDataFrame([(1, 0, "alpha", 10), (1, 1, "BETA", 12), (1, 2, "the alpha-beta gamma", 20), (1, 3, "beta", 0), (1, 4, "ax", 7), (2, 5, "alpha", 99)], "page int, line_id int, text string, h_px int")
    got = {(r.page, r.shape_id): r.h for r in ocr.line_height_of_shape(shapes, lines, ["page"]).collect()}
    assert got == {(1, 0): 12, (1, 1): 7}


def test_words_of_one_height_are_not_ranked(spark, monkeypatch):
    """Only words of several heights on a side reach the running weights; nulls count for nothing and all medians are right."""
    import statistics

    from pyspark.sql import functions as F

    from slidemesh.operators import ocr
    rows = [(1, "same", "orig", 4.0)] * 3 + [(1, "same", "render", 2.0), (1, "none", "orig", None), (1, "half", "orig", 3.0), (1, "half", "render", None)]
    mixed = [(1, "many", "orig", h) for h in (1.0, 5.0, 9.0, 9.0)] + [(1, "many", "render", 7.0)]
    ranked, own = [], ocr.medians
    monkeypatch.setattr(ocr, "medians", lambda c, *a, **k: ranked.append(c.select("word").distinct().count()) or own(c, *a, **k))
    for extra in ([], mixed):
        df = spark.createDataFrame(rows + extra, "page int, word string, side string, hh double")
        got = {r.word: tuple(r)[2:] for r in ocr.word_sides(df, F.col("hh")).select("page", "word", "n_orig", "n_render", "h_orig", "h_render").collect()}
        want = {"same": (3, 1, 4.0, 2.0), "half": (1, 0, 3.0, None)}
        assert got == (want | {"many": (4, 1, statistics.median([1, 5, 9, 9]), 7.0)} if extra else want)
    assert ranked == [1]


def test_similar_pairs_of_few_and_full_pages(spark, monkeypatch):
    """Pages of few long lines are compared without probes, pages of many words through them; both as difflib finds them."""
    import difflib
    import random

    from slidemesh.operators import ocr
    r = random.Random(3)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    long = [word(150, "abcdefgh") for _ in range(4)] + [word(260, "abcdefghij") for _ in range(2)]
    near = [t[:40] + "zz" + t[50:] for t in long]
    few = [(1, t) for t in long], [(1, t) for t in near]
    many = [(2, word(r.randrange(1, 8), "abc")) for _ in range(60)], [(2, word(r.randrange(1, 8), "abc")) for _ in range(60)]

    def found(left, right):
        got = ocr._similar(spark.createDataFrame(left, "page long, a string"), spark.createDataFrame(right, "page long, b string"), 0.8).collect()
        want = {(p, a, b): x for p, a in left for q, b in right if p == q and (x := difflib.SequenceMatcher(None, b, a).ratio()) >= 0.8}
        assert {(x.page, x.a, x.b): x.ratio for x in got} == want and want

    found(few[0] + many[0], few[1] + many[1])
    monkeypatch.setattr(ocr, "_probes", None)
    found(*few)
