"""Fill-in-middle against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from slidemesh.llm.fill_middle import SENTINELS, fill_in_middle


def brute(i, text, unit, seed, rate, spm, sentinels):
    text = text or ""
    units = re.findall(unit, text)
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, s, m = sentinels
    if not text or any(x in text for x in sentinels) or h[2] % 100 >= rate:
        return n, "plain", None, None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", pre, mid, suf, s + suf + p + pre + m + mid
    return n, "psm", pre, mid, suf, p + pre + s + suf + m + mid


def check(df, unit=r"[^\n]*\n|[^\n]+", java=None, seed=7, rate=100, spm=50, sentinels=SENTINELS):
    kw = {"unit": java} if java else {}
    got = fill_in_middle(df, seed=seed, rate=rate, spm=spm, sentinels=sentinels, **kw).collect()
    want = [(r.doc_id, *brute(r.doc_id, r.text, unit, seed, rate, spm, sentinels), r.text or "") for r in df.select("doc_id", "text").collect()]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    return got


def test_awkward_rows(docs, none):
    got = check(docs)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fill_in_middle(none).count() == 0


def test_texts(spark):
    texts = ["\n", "\n\n\n", "a", "a\n", "\na", "a\r\nb\r\nc", "x <P> y\nz", "<S>", "a<M", "<P\n>", "$1 \\ $\n\\n", "🙂\n漢字\n\n🙂🙂", "<" * 9 + "\nP>" * 5, "a b\u0085c\nd", None, ""]
    rows = [(k, t) for k in range(40) for t in texts] + [(None, "one\ntwo\nthree")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    check(df, rate=30, spm=100, seed=11)
    check(df, rate=0)
    check(df, unit=r"(?s).", java=r"(?s:.)", sentinels=("[a$b]", "(\\1)", "{m}*"))
    check(df, sentinels=("⟨p⟩", "⟨s⟩", "⟨m⟩"))


def test_giant_text(spark):
    lines = spark.range(4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("line of text\n"), 400_000).alias("text"))
    got = fill_in_middle(lines).where("restored = repeat('line of text\n', 400000) and n = 400000").count()
    assert got == 4


@pytest.mark.parametrize("bad", [("<P>", "<P>x", "<M>"), ("ab", "bc", "d"), ("", "a", "b"), ("aba", "c", "d")])
def test_ambiguous_sentinels(none, bad):
    with pytest.raises(ValueError):
        fill_in_middle(none, sentinels=bad)
