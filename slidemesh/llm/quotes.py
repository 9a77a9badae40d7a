"""Quotation linking: conversations in reply order, without quotes. DataFrame functions only.

Lines are read for their quote level; consecutive lines of one level form a passage. Passages are normalised and hashed, and joined to
the message that first had that text (as a whole, or as a line of it): in the same conversation if there is one before the quoting turn, else
in any conversation at an earlier turn. The outermost linked passage names the message that was replied to. Origins are one row per hash, or
per hash and conversation, so a text that thousands of messages share is joined once and never paired with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.llm.common import Scratch, query, table

LEAST_LINE = 20         # characters of a line that may stand for its message
ATTRIBUTION = r"^.{0,200}\b(wrote|schrieb|a écrit|escribió)\s*:\s*$"
_MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def passages(text: Column) -> Column:
    """Passages of a text in order: array of (level, text); level 0 is what the author wrote. Attribution lines before a deeper quote go."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)
    read = F.transform(lines, lambda x: F.struct(F.char_length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("text")))
    return read


def _runs(read: Column) -> Column:
    """Consecutive lines of one level joined, in one pass over positions."""
    n = F.size(read)
    level = lambda k: F.element_at(read, (k + 1).cast("int"))["level"]
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (level(k) != level(F.greatest(k - 1, F.lit(0)))))
    return F.transform(begins, lambda k, i: F.struct(
        level(k).alias("level"),
        F.array_join(F.transform(F.slice(read, k + 1, F.coalesce(F.get(begins, i + 1), n) - k), lambda x: x["text"]), "\n").alias("text")))


def parsed(messages: DataFrame, text_col: str) -> DataFrame:
    """Adds `_runs`: the passages of every row, without attribution lines."""
    step = messages.withColumn("_read", passages(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    attribution = lambda x, i: x["text"].rlike(ATTRIBUTION) & (F.coalesce(F.get(F.col("_read"), i + 1)["level"], F.lit(-1)) > x["level"])
    step = step.withColumn("_read", F.filter("_read", lambda x, i: ~attribution(x, i)))
    return step.withColumn("_runs", F.when(F.size("_read") > 0, _runs(F.col("_read")))).drop("_read")


def linked(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Every row of `messages` (all columns, without the text) with body, n_quotes, n_linked, parent_conv, parent_turn, root_conv, root_turn, reply_depth.

    body is the text without quotes and attributions, trimmed; a null text is an empty one. Passages that are empty after normalising, or
    have no earlier origin, stay unlinked; a message without a linked outermost passage begins a thread (no parent, depth 0). Rows that share
    conversation and turn are one message for linking, each row is returned. Rows with a null conversation or turn neither link nor are
    linked to. An empty table gives an empty result. Ordering by root, depth and turn gives the conversation."""
    scratch = Scratch(messages.sparkSession, "quotes")
    work = {f.name: f"_in_{i}" for i, f in enumerate(messages.schema.fields) if f.name not in (conv_col, turn_col, text_col)}
    src = parsed(messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("text"), *[F.col(a).alias(b) for a, b in work.items()]), "text")
    own = F.trim(F.array_join(F.transform(F.filter("_runs", lambda r: r["level"] == 0), lambda r: r["text"]), "\n"))
    src = src.withColumn("body", F.coalesce(F.regexp_replace(own, r"^\s+|\s+$", ""), F.lit(""))).withColumn("quotes", F.coalesce(F.filter("_runs", lambda r: (r["level"] > 0) & (_tidy(r["text"]) != "")), F.array().cast("array<struct<level:int,text:string>>")))
    src = scratch.save(src.select("conv", "turn", *work.values(), "body", "quotes"), "parsed")
    known = src.where("conv IS NOT NULL AND turn IS NOT NULL")

    long_lines = lambda c: F.filter(F.transform(F.split(c, "\n"), _tidy), lambda x: F.char_length(x) >= LEAST_LINE)
    units = F.array_distinct(F.array_union(F.array(_tidy(F.col("body"))), long_lines(F.col("body"))))
    origins = known.where("body <> ''").select("conv", "turn", F.explode(F.transform(units, lambda x: F.md5(x))).alias("hash"))
    origins = scratch.save(origins.groupBy("conv", "hash").agg(F.min("turn").alias("first")), "origins")
    anywhere = origins.groupBy("hash").agg(F.min(F.struct("first", "conv")).alias("o"))

    longest = lambda t: F.element_at(F.array_sort(F.transform(long_lines(t), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("t")))), -1)["t"]
    asked = known.select("conv", "turn", F.posexplode("quotes").alias("no", "q")).select("conv", "turn", "no", F.col("q.level").alias("level"), F.md5(_tidy(F.col("q.text"))).alias("whole"),
                                                                                         F.md5(F.when(F.size(long_lines(F.col("q.text"))) > 0, longest(F.col("q.text")))).alias("line")).distinct()
    asked = scratch.save(asked, "asked")
    hashes = asked.select("conv", "turn", F.explode(F.array_compact(F.array("whole", "line"))).alias("hash")).distinct()
    near = hashes.join(origins, ["conv", "hash"], "left").withColumn("near", F.when(F.col("first") < F.col("turn"), F.col("first"))).drop("first")
    found = near.join(anywhere, "hash", "left").select(
        "conv", "turn", "hash", F.when(F.col("near").isNotNull(), F.struct(F.col("conv").alias("conv"), F.col("near").alias("turn")))
        .when(F.col("o.first") < F.col("turn"), F.struct(F.col("o.conv").alias("conv"), F.col("o.first").alias("turn"))).alias("to")).where("to IS NOT NULL")
    found = scratch.save(found, "found")
    by = lambda c: found.select("conv", "turn", F.col("hash").alias(c), F.col("to").alias(f"{c}_to"))
    to = asked.join(by("whole"), ["conv", "turn", "whole"], "left").join(by("line"), ["conv", "turn", "line"], "left").withColumn("to", F.coalesce("whole_to", "line_to"))
    per = to.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("to").alias("n_linked"),
                                         F.min(F.when(F.col("to").isNotNull(), F.struct("level", "no", "to"))).alias("best"))
    per = scratch.save(per.select("conv", "turn", "n_quotes", "n_linked", F.col("best.to").alias("parent")), "links")

    # roots by pointer jumping: turns fall along links, so there is no cycle, and rounds grow with the logarithm of the depth
    active = scratch.save(per.where("parent IS NOT NULL").select(F.struct("conv", "turn").alias("node"), F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "jump")
    done = active.limit(0)
    while True:     # a node leaves when its pointer has reached a root, so later rounds hold the deep threads only
        ahead = active.unionAll(done).select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        new = scratch.save(active.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "jump")
        done = done.unionAll(new.where("NOT moved").drop("moved"))
        active = new.where("moved").drop("moved")
        if active.isEmpty():
            break
    roots = done.select("node.conv", "node.turn", "root", "depth")
    out = src.drop("quotes").join(per, ["conv", "turn"], "left").join(roots, ["conv", "turn"], "left")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), *[F.col(b).alias(a) for a, b in work.items()], "body",
                      F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("parent.conv").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
                      F.coalesce("root.conv", "conv").alias("root_conv"), F.coalesce("root.turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("reply_depth"))


def mails(conversations: DataFrame) -> DataFrame:
    """The conversations as mails: every turn followed by the two turns before it, quoted at levels one and two under attribution lines."""
    turn = conversations.groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("said"))
    one = turn.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("said").alias("one"))
    two = turn.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("said").alias("two"))
    quoted = lambda c, mark: F.regexp_replace(c, "(?m)^", mark)
    joined = conversations.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    head = lambda k, mark: F.concat(F.lit(mark + "On turn "), (F.col("turn") - k).cast("string"), F.lit(" somebody wrote:"))
    first = F.when(F.col("one").isNotNull(), F.concat_ws("\n", head(1, ""), quoted(F.col("one"), "> ")))
    second = F.when(F.col("two").isNotNull() & F.col("one").isNotNull(), F.concat_ws("\n", head(2, "> "), quoted(F.col("two"), "> > ")))
    return joined.select("conv_id", "turn", "role", F.concat_ws("\n", F.coalesce("text", F.lit("")), first, second).alias("text"))


@query("op6_quotation_links", r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS norm FROM conversations),
origin AS (SELECT conv_id, norm, min(turn) AS first FROM m WHERE norm <> '' GROUP BY ALL),
link AS (SELECT m.conv_id, m.turn, count(p.norm) AS n_quotes, min(CASE WHEN p.turn = m.turn - 1 THEN o.first END) AS one, min(CASE WHEN p.turn = m.turn - 2 THEN o.first END) AS two
         FROM m JOIN m p ON p.conv_id = m.conv_id AND p.turn IN (m.turn - 1, m.turn - 2) AND p.norm <> ''
              JOIN m prev ON prev.conv_id = m.conv_id AND prev.turn = m.turn - 1
              JOIN origin o ON o.conv_id = p.conv_id AND o.norm = p.norm GROUP BY ALL),
up AS (SELECT m.conv_id, m.turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(one, two) AS parent FROM m LEFT JOIN link USING (conv_id, turn)),
walk AS (SELECT conv_id, turn, turn AS node, CAST(0 AS BIGINT) AS depth FROM up UNION ALL
         SELECT w.conv_id, w.turn, u.parent, w.depth + 1 FROM walk w JOIN up u ON u.conv_id = w.conv_id AND u.turn = w.node WHERE u.parent IS NOT NULL),
root AS (SELECT conv_id, turn, max(depth) AS depth, min(node) AS root FROM walk GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, regexp_replace(m.text, '^\s+|\s+$', '', 'g') AS body, u.n_quotes AS n_quotes, u.n_quotes AS n_linked,
       CASE WHEN u.parent IS NOT NULL THEN m.conv_id END AS parent_conv, u.parent AS parent_turn, m.conv_id AS root_conv, r.root AS root_turn, r.depth AS reply_depth
FROM m JOIN up u USING (conv_id, turn) JOIN root r USING (conv_id, turn)""")
def op6_quotation_links(spark, sf):
    """Every turn of the mail view of conversations: body without quotes, the turn it replies to, the root of its thread and its depth there."""
    return linked(mails(table(spark, sf, "conversations")))
