"""Model-call log: attribution of calls to the open slide, and cost roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.operators.scan import running


def attribute_to_slides(log: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Adds open_image: the last started slide not yet ended by its own end marker at that line.

    A running last-value gives the start a line belongs to; the first matching end per start comes from an aggregate."""
    src, keys = (log, run) if run else (log.withColumn("_run", F.lit(0)), ["_run"])
    start = F.when(F.col("marker") == "slide_start", F.struct(F.col("line_no").alias("line"), F.col("image").alias("img")))
    r = running(src, keys, ["line_no"], lasts={"_start": start})
    end = (r.where((F.col("marker") == "slide_end") & (F.col("image") == F.col("_start.img")))
           .groupBy(*keys, F.col("_start.line").alias("_line")).agg(F.min("line_no").alias("_closed")))
    out = (r.withColumn("_line", F.col("_start.line")).join(end, [*keys, "_line"], "left")
           .withColumn("open_image", F.when(F.col("_closed").isNull() | (F.col("line_no") < F.col("_closed")), F.col("_start.img"))))
    return out.select(*log.columns, "open_image")


def calls_of(log: DataFrame) -> DataFrame:
    """Rows that are model calls: no marker, and a backend. Audit records have none; a log without that column holds calls only."""
    return log.where("marker IS NULL AND backend IS NOT NULL" if "backend" in log.columns else "marker IS NULL")


def per_agent(log: DataFrame) -> DataFrame:
    calls = calls_of(log)
    return calls.groupBy(F.coalesce("agent", F.lit("unknown")).alias("agent")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("latency_ms").alias("latency_ms"))


def per_slide(attributed: DataFrame, with_agents: bool = True) -> DataFrame:
    """Calls, tokens and latency per started slide (zero rows kept), the wall clock of its last end marker, calls per agent."""
    cache = [c for c in ("cache_creation_input_tokens", "cache_read_input_tokens") if c in attributed.columns]
    calls = calls_of(attributed).where("open_image IS NOT NULL").withColumnRenamed("open_image", "img")
    sums = ["input_tokens", "output_tokens", *cache, "latency_ms"]
    agents = (calls.groupBy("img", F.coalesce("agent", F.lit("unknown")).alias("agent"))
              .agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in sums]))
    agg = agents.groupBy("img").agg(F.sum("calls").alias("calls"), *[F.sum(c).alias(c) for c in sums],
                                    *([F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "calls")))).alias("agents")] if with_agents else []))
    wall = F.col("wall_clock_sec") if "wall_clock_sec" in attributed.columns else F.lit(None).cast("double")
    starts = attributed.where("marker = 'slide_start'").groupBy(F.col("image").alias("img")).agg(F.min("line_no").alias("_first"))
    ends = (attributed.where("marker = 'slide_end'").withColumnRenamed("image", "img").join(starts, "img").where("line_no > _first")
            .groupBy("img").agg(F.max_by(wall, "line_no").alias("wall_clock_sec"), F.max("line_no").alias("end_line")))
    marks = starts.drop("_first").join(ends, "img", "left")
    return (marks.join(agg, "img", "left").fillna(0, ["calls", *sums]).withColumnRenamed("img", "image"))


def totals(slides: DataFrame) -> DataFrame:
    """Means over completed slides only; NULL when none is complete."""
    done = F.col("wall_clock_sec").isNotNull()

    def mean(c, digits):
        return F.bround(F.avg(F.when(done, F.col(c))), digits).alias(f"mean_{c}_per_slide")

    return slides.agg(F.count_if(done).alias("slides_completed"), F.count(F.lit(1)).alias("slides_started"), mean("calls", 2),
                      mean("input_tokens", 1), mean("output_tokens", 1), mean("wall_clock_sec", 1), mean("latency_ms", 1))


def screened(cheap: DataFrame, expensive: DataFrame, keys: list[str], accept: str) -> DataFrame:
    """Screen-then-escalate: the cheap answer where `accept` (SQL over `cheap`) holds, else the expensive one, with a tag."""
    c = cheap.select(*keys, F.struct(*[x for x in cheap.columns if x not in keys]).alias("answer"), F.expr(accept).alias("_ok"))
    e = expensive.select(*keys, F.struct(*[x for x in cheap.columns if x not in keys]).alias("_exp"))
    ok = F.coalesce("_ok", F.lit(False))
    return c.join(e, keys, "left").select(
        *keys, F.when(ok, F.col("answer")).otherwise(F.col("_exp")).alias("answer"),
        F.when(ok, "screen_accepted").when(F.col("_exp").isNotNull(), "escalated").otherwise("error").alias("cascade"))


def audit_rate(audits: DataFrame, path: str, fraction: float) -> DataFrame:
    """Agreement rate per audit kind over a hash sample of paths (the sample is the operator's own feature)."""
    bucket = F.conv(F.substring(F.md5(F.col(path)), 1, 8), 16, 10).cast("long") % 10000
    return audits.where(bucket < fraction * 10000).groupBy("audit").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("agree").cast("double")).alias("agreement"))


def metric_stats(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation and count of each metric, NULLs skipped."""
    aggs = [f(c).alias(f"{c}_{n}") for c in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("n", F.count))]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
