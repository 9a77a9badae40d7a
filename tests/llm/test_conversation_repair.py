"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from slidemesh.llm import conversation_repair
from slidemesh.llm.conversation_repair import damaged, repair_summary, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, conv string, fault string, known string"


def shape(roles):
    return re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in roles)) is not None


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault): uniform-cost search over edits, with (cost, audit) as the order."""
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in out)
        if i == len(rows) and shape(roles):
            return cost, audit, out
        steps = [(2, "I", i, ((r, ""),)) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((3, "D", i + 1, ()))
            if fault not in ("blank", "duplicate"):
                extra = 1 if fault == "truncated" else 0
                steps += [(extra, "K", i + 1, ((role, text),))] + [(2 + extra, "R", i + 1, ((r, text),)) for r in ("user", "assistant")]
        for c, letter, j, more in steps:
            if re.fullmatch("s?(ua)*u?", roles + "".join(r[:1] if r else "-" for r, _ in more)) and cost + c <= 3 * len(rows):
                heapq.heappush(heap, (cost + c, audit + letter, j, out + more))
    raise AssertionError


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def brute(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha, lines)}"""
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faulty, turns = set(), [], [r[1] for r in own if r[1] is not None]
        for _, _, role, text in own:
            solid = text.strip(" \t\n\r\x0b\x0c")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "fine"
            seen.add((role, text))
            faulty.append((role, text, fault))
        cost, audit, lines = cheapest(faulty)
        count = [sum(f == x for _, _, f in faulty) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, sha, [tuple(x) for x in lines])
    return found


def check(df, rows, all_ids, **kw):
    want = brute(rows)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), [])
    got = {r.conv_id: tuple(r)[1:] for r in repair_summary(df, **kw).collect()}
    assert got == {c: want.get(c, nothing)[:8] for c in all_ids}
    lines = {}
    for r in repaired_turns(df, **kw).orderBy("position").collect():
        assert r.position == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append((r.role, r.text))
    assert lines == {c: want[c][8] for c in want if want[c][8]}


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(3)
    texts = ["Yes.", "No", "ok!\n", " ", "", None, "What?\t ", "Fine\u00a0", "a. b", "\u3000", "x:\ny."]
    rows = []
    for conv in [None, *range(90)]:
        for k in range(rnd.choice([0, 1, 2, 3, 4, 5])):
            rows.append((conv, rnd.choice([None, k, k, k, k, 7]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "Under", "unit"]), rnd.choice(texts)))
    return rows + rows[:9]


def test_damaged_conversations(spark, talk):
    df = spark.createDataFrame([(*r, "c", "f", "k") for r in talk], SCHEMA)
    check(damaged(df), harm(talk), {r[0] for r in talk}, present_col="present")


def test_whole_conversations(spark, talk, monkeypatch):
    """As they are, with back-pointers spilled after every third row and batches of two rows."""
    monkeypatch.setattr(conversation_repair, "SPILL_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        df = spark.createDataFrame([(*r, "c", "f", "k") for r in talk], SCHEMA)
        check(df, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in talk], {r[0] for r in talk})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_summary(empty).count() == 0 and repaired_turns(empty).count() == 0


def test_giant_conversation(spark):
    """A conversation of 60,000 rows of which every tenth lacks its answer."""
    rows = spark.range(60_000).select(F.lit("big").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(".")).alias("text")).where("turn % 20 <> 11")
    r = repair_summary(rows.unionAll(rows.limit(5).withColumn("conv_id", F.lit("small")))).where("conv_id = 'big'").first()
    assert (r.gaps, r.illegal, r.cost, len(r.audit)) == (3000, 3000, 6000, 60_000)
    assert r.audit.count("I") == 3000
