"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell of source, language and topic. The cells' weights are raked: scaled to the target share of each value of one
dimension after the other, until all marginals hold. Weights over counts give sampling rates, calibrated so that the sample has the wanted
number of tokens while no rate exceeds one; a document is drawn when the hash of its id falls below its rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemesh.llm.common import Scratch, query, ship, table

NONE = "(none)"
DIMENSIONS = ("source", "lang", "topic")
ROUNDS, TOLERANCE = 40, 1e-3
SEED = 20_011


def tokens_of(text: Column) -> Column:
    """Estimate of a text's tokens: a quarter of its UTF-8 bytes, 1 at least; null counts as empty."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) / 4)).cast("long")


def form_of(text: Column) -> Column:
    """A topic by the form of the whole text, where documents carry no topic of their own."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.char_length(t)
    of = lambda mark: n - F.char_length(F.replace(t, F.lit(mark), F.lit("")))
    return F.when(n == 0, "empty").when(of("|") * 50 > n, "table").when(of("@") > 0, "contact").when(of("\n") * 60 > n, "lines").when(n < 600, "note").when(n < 4000, "article").otherwise("long read")


def tempered_targets(cells: DataFrame, exponents: dict[str, float]) -> DataFrame:
    """(dim, value, target): shares of each dimension's values in the table, raised to an exponent below one and normalised again."""
    out = None
    for dim, power in exponents.items():
        own = cells.groupBy(F.lit(dim).alias("dim"), F.col(dim).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("w"))
        out = own if out is None else out.unionAll(own)
    total = out.groupBy("dim").agg(F.sum("w").alias("all"))
    return out.join(total, "dim").select("dim", "value", (F.col("w") / F.col("all")).alias("target"))


def raked(cells: DataFrame, targets: DataFrame, scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """`cells` (source, lang, topic, tokens) with `weight`, summing to 1, whose sums over each dimension have the target shares.

    Targets of values that do not occur are dropped and the rest normalised; values without a target get weight 0. Cells may be many: each
    step is an aggregate and a join, and one number per round reaches the driver. Ends when no marginal is off by more than
    `tolerance` of itself, or after `rounds` (marginals that contradict each other end as near as the last round leaves them)."""
    wanted = {}
    for dim in DIMENSIONS:
        have = cells.select(F.col(dim).alias("value")).distinct()
        own = targets.where(F.col("dim") == dim).select("value", "target").join(have, "value", "left_semi")
        total = own.agg(F.sum("target")).first()[0] or 1.0
        wanted[dim] = scratch.save(own.select(F.col("value").alias(dim), (F.col("target") / float(total)).alias("target")), dim)
    now = scratch.save(cells.withColumn("weight", F.col("tokens").cast("double")), "weights")
    for _ in range(rounds):
        step, off = now, None
        for dim in DIMENSIONS:
            sums = step.groupBy(dim).agg(F.sum("weight").alias("sum")).join(wanted[dim], dim, "left")
            factor = F.when((F.col("sum") > 0) & F.col("target").isNotNull(), F.col("target") / F.col("sum")).otherwise(0.0)
            step = step.join(sums.select(dim, factor.alias("factor")), dim).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        new = scratch.save(step.select(*now.columns), "weights")
        for dim in DIMENSIONS:
            gap = new.groupBy(dim).agg(F.sum("weight").alias("sum")).join(wanted[dim], dim).agg(F.max(F.abs(F.col("sum") / F.col("target") - 1)).alias("gap"))
            off = gap if off is None else off.unionAll(gap)
        worst = off.agg(F.max("gap")).first()[0]
        scratch.forget(now)
        now = new
        if worst is None or worst <= tolerance:
            break
    return now


def rates(cells: DataFrame, budget: float, steps: int = 64) -> DataFrame:
    """Adds `rate` = min(1, scale * weight / tokens), the scale solved so that the expected sample has `budget` of all tokens."""
    total = cells.agg(F.sum("tokens")).first()[0]
    low, high = -60.0, 60.0         # natural logarithms of the scale over the table's tokens
    per = F.col("weight") * float(total or 1) / F.col("tokens")
    for _ in range(4):              # each round narrows the bracket `steps` times, in one pass over the cells
        grid = [low + (high - low) * k / steps for k in range(steps + 1)]
        sums = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), per * F.exp(F.lit(g)))).alias(f"s{k}") for k, g in enumerate(grid)]).first()
        reach = [k for k in range(steps + 1) if (sums[k] or 0) >= budget * (total or 0)]
        at = max(1, reach[0]) if reach else steps
        low, high = grid[at - 1], grid[at]
    return cells.withColumn("rate", F.least(F.lit(1.0), per * F.exp(F.lit(high))))


def prepared(docs: DataFrame, id_col: str, text_col: str, topic: Column | None) -> list[Column]:
    topic = form_of(F.col(text_col)) if topic is None else topic
    cat = lambda c, name: F.coalesce(c.cast("string"), F.lit(NONE)).alias(name)
    return [F.col(id_col).alias("_id"), cat(F.col("source"), "_source"), cat(F.col("lang"), "_lang"), cat(topic, "_topic"), tokens_of(F.col(text_col)).alias("_tokens")]


def mixed(docs: DataFrame, budget: float = 0.5, exponents: dict[str, float] | None = None, targets: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
          topic: Column | None = None, seed: int = SEED) -> DataFrame:
    """All columns of `docs` and, in the struct `_mix`, source, lang, topic, tokens, rate, draw (0 to 1) and sampled.

    Targets are (dim, value, target), or the table's shares tempered by `exponents`. Null categories are the value "(none)"; null and empty
    texts weigh one token; rows that share an id are drawn together; a null id has a draw of its own. An empty table gives an empty result.
    The rates are one row per cell; Spark broadcasts them while they are small."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mixing")
    parts = prepared(docs, id_col, text_col, topic)
    cells = docs.select(*parts).groupBy(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens"))
    cells = scratch.save(cells, "cells")
    targets = targets if targets is not None else tempered_targets(cells, exponents or {"source": 0.6, "lang": 0.8, "topic": 0.9})
    priced = scratch.save(rates(raked(cells, targets, scratch), budget).select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "rate"), "rates")
    marked = docs.select(F.struct(*docs.columns).alias("_row"), *parts).join(priced, [f"_{d}" for d in DIMENSIONS])
    draw = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit(NONE)), F.lit(seed)), 11) / F.lit(float(1 << 53))).alias("draw")
    mix = F.struct(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), "rate", draw)
    return marked.withColumn("_mix", mix).select("_row.*", F.col("_mix").withField("sampled", F.col("_mix.draw") < F.col("_mix.rate")).alias("_mix"))


def sampled(docs: DataFrame, budget: float = 0.5, **options) -> DataFrame:
    """The drawn rows of `docs`, with their columns."""
    return mixed(docs, budget, **options).where("_mix.sampled").select(*docs.columns)


@query("op4_raking")
def op4_raking(spark, sf):
    """One row per document: its cell, tokens, calibrated rate, draw and whether it is in the sample of half the tokens."""
    return mixed(table(spark, sf, "documents"), 0.5).select("doc_id", "_mix.*")
