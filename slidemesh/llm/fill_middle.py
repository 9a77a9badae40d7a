"""Fill-in-middle transformation by counted quantifiers.

regexp_count gives the number n of units of a text. Two hashed draws give the cuts a <= b, and one pattern made for the row, with the
possessive groups unit{a} and unit{b-a}, captures prefix, middle and suffix in a single match, which also writes them in their new
order. Possessive quantifiers never go back, so the match takes one step per unit and no stack, however long the text is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.llm.common import query, table

LINE = r"[^\n]*+\n|[^\n]++"
SENTINELS = ("<P>", "<S>", "<M>")


def _distinct_when_joined(sentinels: tuple[str, str, str]) -> None:
    """Texts without sentinels put between sentinels must hold no further one: no end of one may begin another, none holds another."""
    for s in sentinels:
        for t in sentinels:
            joined = any(s.endswith(t[:k]) for k in range(1, min(len(s), len(t)) + (s != t)))
            if not s or joined or (s != t and s in t) or len(set(sentinels)) < 3:
                raise ValueError(f"sentinels {s!r} and {t!r} can overlap")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7, rate: int = 100, spm: int = 50,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix, middle, suffix, output, restored) of every row.

    `unit` is a pattern that matches the text piece by piece, n pieces in all, without backing out of any. h1 to h4 are the first four 8-digit groups of the hex
    SHA-256 of `seed:id`. The prefix ends after min(h1 % (n+1), h2 % (n+1)) units, the middle after the larger of them. A row is `plain` if its text is
    empty or holds a sentinel, or if h3 % 100 >= rate; otherwise `spm` if h4 % 100 < spm, else `psm`. Output: plain, the text;
    psm, P prefix S suffix M middle; spm, S suffix P prefix M middle. `restored` is the text rebuilt from output and form alone.
    prefix, middle and suffix are null in plain rows.

    A null text is an empty one, hence plain; a null id counts as the empty string in the hash and stays null. Rows that repeat an id and a text get
    the same output. An empty table gives an empty table. Other columns are not looked at. One scan, no shuffle."""
    _distinct_when_joined(sentinels)
    p, s, m = sentinels
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), digits.alias("digits"))
    h = [F.conv(F.substr("digits", F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4)]
    rows = rows.select("id", "text", F.regexp_count("text", F.lit(unit)).cast("long").alias("n"), *(x.alias(f"h{k + 1}") for k, x in enumerate(h)))
    held = F.lit(False)
    for x in sentinels:
        held = held | F.contains("text", F.lit(x))
    form = F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    cuts = [F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)]
    rows = rows.select("id", "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))

    def group(times: Column) -> Column:
        return F.concat(F.lit(f"((?:{unit}){{"), times.cast("string"), F.lit("}+)"))

    pattern = F.concat(F.lit(r"(?s)\A"), group(F.col("a")), group(F.col("b") - F.col("a")), F.lit(r"(.*+)\z"))
    q = [re.sub(r"([\\$])", r"\\\1", x) for x in sentinels]
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.regexp_replace("text", pattern, F.lit(f"{q[0]}$1{q[1]}$3{q[2]}$2"))) \
        .otherwise(F.regexp_replace("text", pattern, F.lit(f"{q[1]}$3{q[0]}$1{q[2]}$2")))
    rows = rows.select("id", "n", "form", output.alias("output"))
    between = F.split("output", "|".join(_quoted(x) for x in sentinels))
    rows = rows.select("id", "n", "form", "output", F.when(F.col("form") != "plain", between).alias("parts"))
    first, second, third = (F.element_at("parts", k) for k in (2, 3, 4))
    psm = F.col("form") == "psm"
    rows = rows.select("id", "n", "form", F.when(psm, first).otherwise(second).alias("prefix"), third.alias("middle"), F.when(psm, second).otherwise(first).alias("suffix"), "output")
    return rows.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("prefix", "middle", "suffix")))


def _quoted(literal: str) -> str:
    """A pattern of the JVM's expressions for the text itself."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)


@query("op12_fill_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS x FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""")
def op12_fill_middle(spark, sf):
    """Every document cut into prefix, middle and suffix at line ends and put in order for filling in the middle."""
    made = fill_in_middle(table(spark, sf, "documents"))
    return made.select(F.col("id").alias("doc_id"), "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
