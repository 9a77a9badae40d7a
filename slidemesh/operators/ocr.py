"""Text coverage between an original page and its rendering, OCR line joins, repair candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidemesh.functions import boxes as B
from slidemesh.functions import text as T
from slidemesh.operators.pairs import box_pairs, points_in_boxes
from slidemesh.runtime import cut

FOLD_RATIO = 0.85      # fixed value
COVERED_RATIO = 0.8    # fixed value
MIN_CONFIDENCE = 0.4   # fixed value


def words_of_lines(lines: DataFrame) -> DataFrame:
    """(page, side, word, h) from OCR lines (page, side, text, conf, h_px) read with enough confidence."""
    return lines.where(F.col("conf") >= MIN_CONFIDENCE).select("page", "side", F.explode(T.words(F.col("text"))).alias("word"), F.col("h_px").alias("h"))


def medians(counted: DataFrame, keys: list[str], value: str, n: str, out: str = "median") -> DataFrame:
    """(keys, out, total): the interpolated median per key of values given with their counts (keys, value, n).

    What is sorted are the distinct values of a key, whose running weight tells the middle ones; nothing is gathered. Null values count for nothing."""
    c = counted.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy(value)
    c = c.withColumns({"_to": F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(n).over(Window.partitionBy(*keys))})
    holds = lambda at: (F.col("_to") - F.col(n) <= at) & (at < F.col("_to"))
    mid = [F.max(F.when(holds(F.expr(at)), F.col(value))) for at in ("(_all - 1) div 2", "_all div 2")]
    return c.groupBy(*keys).agg(((mid[0] + mid[1]) / 2).alias(out), F.max("_all").alias("total"))


def word_sides(words: DataFrame, height: Column | None = None) -> DataFrame:
    """One row per (page, word) with its count on both sides and, when given, its median heights.

    The aggregate combines map-side, so that a page holding most of the words is no hot task."""
    def on(side):
        return F.col("side") == side
    if height is None:
        return words.groupBy("page", "word").agg(F.count_if(on("orig")).alias("n_orig"), F.count_if(on("render")).alias("n_render"))
    # where a side has one height it is the median, found without a sort; only words of several heights are ranked
    names = ["page", "word", "n_orig", "n_render", "h_orig", "h_render"]
    rows = words.select("page", "word", "side", height.alias("h"))
    part = lambda s: [F.count_if(on(s) & F.col("h").isNotNull()).alias(f"n_{s}"), F.min(F.when(on(s), F.col("h"))).alias(f"_a_{s}"), F.max(F.when(on(s), F.col("h"))).alias(f"_b_{s}")]
    one = cut(rows.groupBy("page", "word").agg(*part("orig"), *part("render")).where("n_orig + n_render > 0"))
    one = one.withColumns({f"h_{s}": (F.col(f"_a_{s}") + F.col(f"_b_{s}")) / 2 for s in ("orig", "render")})
    even = F.col("_a_orig").eqNullSafe(F.col("_b_orig")) & F.col("_a_render").eqNullSafe(F.col("_b_render"))
    several = one.where(~even).select("page", "word")
    if several.isEmpty():
        return one.select(*names)
    # partitioned by page and word once: both the running weights and the two sides' rows stay there
    counted = rows.join(several, ["page", "word"], "left_semi").groupBy("page", "word", "side", "h").agg(F.count(F.lit(1)).alias("n")).repartition("page", "word")
    sides = medians(counted, ["page", "word", "side"], "h", "n")
    ranked = sides.groupBy("page", "word").agg(
        *[F.coalesce(F.max(F.when(on(s), F.col("total"))), F.lit(0)).cast("long").alias(f"n_{s}") for s in ("orig", "render")],
        *[F.max(F.when(on(s), F.col("median"))).alias(f"h_{s}") for s in ("orig", "render")])
    return one.where(even).select(*names).unionByName(ranked)


def coverage(words: DataFrame, height: Column | None = None) -> DataFrame:
    """Distinct words per side, share of original words found again, and the median of per-word height ratios.

    Words without a height count only where no heights are asked for."""
    w = word_sides(words, height)
    o, r = F.col("n_orig") > 0, F.col("n_render") > 0
    if height is None:
        out = w.groupBy("page").agg(F.count_if(o).alias("orig_words"), F.count_if(r).alias("render_words"), F.count_if(o & ~r).alias("missing"))
    else:
        # words of a page with equal ratios count together, so a page sorts its distinct ratios
        ratio = F.when(o & r, F.col("h_render") / F.col("h_orig"))
        by = w.groupBy("page", ratio.alias("ratio")).agg(F.count(F.lit(1)).alias("n"), F.count_if(o).alias("o"), F.count_if(r).alias("r"), F.count_if(o & ~r).alias("m")).repartition("page")
        of = by.groupBy("page").agg(F.sum("o").alias("orig_words"), F.sum("r").alias("render_words"), F.sum("m").alias("missing"))
        out = of.join(medians(by, ["page"], "ratio", "n"), "page", "left").select("page", "orig_words", "render_words", "missing", F.bround("median", 3).alias("median_height_ratio"))
    return out.withColumn("coverage", 1.0 - F.col("missing") / F.greatest(F.col("orig_words"), F.lit(1)))


def missing_words(words: DataFrame) -> DataFrame:
    """Original words the rendering lacks, one row each (a list per page could be of any length)."""
    return word_sides(words).where("n_orig > 0 AND n_render = 0").select("page", "word")


def shared_words(words: DataFrame) -> DataFrame:
    return word_sides(words).where("n_orig > 0 AND n_render > 0").select("page", "word")


def fold_words(words: DataFrame) -> DataFrame:
    """Render words mapped to the original vocabulary of the page: exact, else the most similar word (ratio >= 0.85).

    Returns (page, word, n_orig, n_folded)."""
    w = word_sides(words)
    exact = w.where("n_orig > 0").select("page", "word", "n_orig", "n_render")
    lost = w.where("n_orig = 0").select("page", F.col("word").alias("rw"), F.col("n_render").alias("rn"))
    cand = _similar(lost.select("page", F.col("rw").alias("a")), exact.select("page", F.col("word").alias("b")), FOLD_RATIO)
    best = cand.groupBy("page", "a").agg(F.max(F.struct("ratio", "b"))["b"].alias("word"))
    extra = best.join(lost.withColumnRenamed("rw", "a"), ["page", "a"]).groupBy("page", "word").agg(F.sum("rn").alias("more"))
    return exact.join(extra, ["page", "word"], "left").select("page", "word", "n_orig", (F.col("n_render") + F.coalesce("more", F.lit(0))).alias("n_folded"))


def _profile(df: DataFrame, c: str, ratio: float) -> DataFrame:
    """Distinct strings with bigrams and how many of the rarest numbered ones (so that repeats count) to probe.

    Similarity r of lengths la, lb means at least M = ceil(r (la + lb) / 2) matched letters in at most la + lb - 2M + 1 blocks,
    hence M - blocks shared bigrams; of all but that many (plus one) bigrams at least one is then shared."""
    s, n = F.col(c), F.length(c)
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    lo, hi = F.ceil(n * ratio / (2 - ratio) - 1e-9), F.floor(n * (2 - ratio) / ratio + 1e-9)

    def shared(m):
        t = n + m
        matched = F.ceil(ratio * t / 2 - 1e-9)
        return matched - (t - 2 * matched + 1)

    return (df.select(c).distinct().withColumn("grams", grams)
            .withColumn("probe", F.size("grams") - F.array_min(F.transform(F.sequence(lo, F.greatest(lo, hi)), shared)) + 1))


def _probes(prof: DataFrame, c: str, freq: DataFrame) -> DataFrame:
    """Blocking keys of each string: its rarest numbered bigrams, and single letters for strings up to three letters."""
    g = prof.select(c, "probe", F.posexplode("grams").alias("_p", "g"))
    w = Window.partitionBy(c, "g").orderBy("_p")
    g = g.withColumn("k", F.row_number().over(w)).join(F.broadcast(freq), "g")
    rank = F.row_number().over(Window.partitionBy(c).orderBy(F.desc("k"), "_f", "g"))
    keys = g.withColumn("_r", rank).where("_r <= probe").select(c, F.concat("g", F.col("k").cast("string")).alias("key"))
    short = prof.where(F.length(c) <= 3).select(c, F.explode(F.array_distinct(F.split(c, ""))).alias("key"))
    return keys.unionByName(short)


def _similar(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """Pairs (page, a, b, ratio) within a page whose difflib ratio reaches `ratio`, strings over [a-z0-9].

    Strings are compared once however many pages share them. Candidates of pages with no more pairs than characters are all pairs of about
    equal length; those of fuller pages come from common rare bigrams. Arrow batches then bound the ratio by common letters, and
    only what is left reaches difflib."""
    la, rb = cut(left.distinct().where("a <> ''")), cut(right.distinct().where("b <> ''"))
    size = lambda d, c: d.groupBy("page").agg(F.count(F.lit(1)).cast("double").alias(f"n{c}"), F.sum(F.length(c)).alias(f"c{c}"))
    pages = cut(size(la, "a").join(size(rb, "b"), "page").select("page", (F.col("na") * F.col("nb") > F.col("ca") + F.col("cb")).alias("full")))
    few, full = pages.where("NOT full").select("page"), pages.where("full").select("page")
    near = la.join(few, "page").join(rb, "page")
    if not full.isEmpty():
        fa, fb = cut(la.join(full, "page")), cut(rb.join(full, "page"))
        pa, pb = _profile(fa, "a", ratio), _profile(fb, "b", ratio)
        # at most 36 * 36 bigrams exist, so this table is small whatever the data
        freq = pa.select(F.explode("grams").alias("g")).unionByName(pb.select(F.explode("grams").alias("g"))).groupBy("g").agg(F.count(F.lit(1)).alias("_f"))
        ka, kb = fa.join(_probes(pa, "a", freq), "a"), fb.join(_probes(pb, "b", freq), "b")
        near = near.select("a", "b").unionByName(ka.join(kb, ["page", "key"]).select("a", "b"))
    cand = near.where(T.length_bound(F.col("a"), F.col("b"), ratio)).select("a", "b").distinct()
    sim = cand.repartition(F.col("a"), F.col("b")).withColumn("ratio", T.fuzzy_ratio_from(ratio)(F.col("b"), F.col("a"))).where(F.col("ratio") >= ratio)
    return la.join(sim, "a").join(rb, ["page", "b"]).select("page", "a", "b", "ratio")


def duplicate_excess(words: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Words rendered more often than in the original, only words the original has: per page the excess."""
    if fuzzy:
        w = fold_words(words)
    else:
        w = word_sides(words).where("n_orig > 0").withColumnRenamed("n_render", "n_folded")
    return w.groupBy("page").agg(F.sum(F.greatest(F.lit(0).cast("long"), F.col("n_folded") - F.col("n_orig"))).alias("excess"))


def component_height_ratio(heights: DataFrame) -> DataFrame:
    """Median over components of (median rendered height / median original height); heights: (stem, side, h).

    Ratios are rounded to three places before the last median, which therefore sorts a few thousand distinct values however many components there are."""
    counted = heights.groupBy("stem", "side", "h").agg(F.count(F.lit(1)).alias("n")).repartition("stem")
    per = medians(counted, ["stem", "side"], "h", "n").groupBy("stem").agg(*[F.max(F.when(F.col("side") == s, F.col("median"))).alias(s) for s in ("orig", "render")])
    r = F.when((F.col("orig") > 0) & F.col("render").isNotNull(), F.bround(F.col("render") / F.col("orig"), 3))
    one = medians(per.groupBy(F.lit(0).alias("k"), r.alias("ratio")).agg(F.count(F.lit(1)).alias("n")), ["k"], "ratio", "n")
    return one.agg(F.bround(F.max("median"), 3).alias("median_ratio"), F.coalesce(F.max("total"), F.lit(0)).cast("long").alias("n"))


def important(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Texts worth checking, whitespace squeezed, first one per normalised form: keys, pos, text, n."""
    t = texts.select(*keys, "pos", T.squeeze(F.col(column)).alias("text")).where(T.is_important(F.col("text"))).withColumn("n", T.norm(F.col("text")))
    return t.groupBy(*keys, "n").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))


SLICE_ROWS = 100_000   # texts of a page, of either kind, that one task compares


def contained(needles: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, text_id) of every needle (keys, n) that occurs in a text (keys, text_id, text) of its key, once each.

    A key's needles become one automaton, through which each of its texts runs once; no text is copied to a needle. Keys with many rows are
    cut into slices of needles and of texts, and each pair of slices is a task of its own. Empty needles occur everywhere and are left out, as null ones are."""
    n = needles.where("n <> ''").select(*keys, "n").distinct()
    size = lambda d, c: d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SLICE_ROWS).select(*keys, F.ceil(F.col("_n") / SLICE_ROWS).alias(c))
    cuts = size(n, "_needles").join(size(texts, "_texts"), keys, "full")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), one(c) - 1))
    own = lambda by, c: F.pmod(F.xxhash64(by), one(c))
    kind = texts.schema["text_id"].dataType
    a = n.join(cuts, keys, "left").select(*keys, own("n", "_needles").alias("_a"), every("_texts").alias("_b"), F.lit(0).alias("_kind"), F.col("n").alias("text"), F.lit(None).cast(kind).alias("text_id"))
    b = texts.where("text is not null").join(cuts, keys, "left").select(*keys, every("_needles").alias("_a"), own("text_id", "_texts").alias("_b"), F.lit(1).alias("_kind"), "text", "text_id")
    group = [*keys, "_a", "_b"]
    both = a.unionByName(b).repartition(*group).sortWithinPartitions(*group, "_kind")
    types = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n string", f"text_id {types['text_id']}"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        here, machine, ready = object(), None, False
        for batch in batches:
            cols = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            rows: list[list] = [[] for _ in range(len(keys) + 2)]
            for key, what, text, ident in zip(zip(*[cols[k] for k in group]), cols["_kind"], cols["text"], cols["text_id"]):
                if key != here:
                    here, machine, ready = key, ahocorasick.Automaton(), False
                if what == 0:
                    machine.add_word(text, text)
                    continue
                if not ready:
                    machine.make_automaton()
                    ready = True
                for hit in {w for _, w in machine.iter(text)} if len(machine) else ():
                    for col, v in zip(rows, (*key[:len(keys)], hit, ident)):
                        col.append(v)
            fields = [batch.schema.field(k).type for k in keys] + [pa.string(), batch.schema.field("text_id").type]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, fields)], [*keys, "n", "text_id"])

    return both.mapInArrow(match, schema)


def _absent(texts: DataFrame, haystack: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `texts` (keys, n ...) whose n does not occur in the page's joined text (keys, hay)."""
    hay = haystack.select(*keys, F.lit(0).alias("text_id"), F.col("hay").alias("text"))
    found = contained(texts, hay, keys).select(*keys, "n").distinct()
    return texts.where("n <> ''").join(found, [*keys, "n"], "left_anti")


def missing_texts(expected: DataFrame, haystack: DataFrame, keys: list[str]) -> DataFrame:
    """Important expected texts whose normal form is not part of the page's joined normal text (keys, hay)."""
    return _absent(important(expected, keys), haystack, keys).select(*keys, "pos", "text")


def missing_lines(lines: DataFrame, got: DataFrame, hay: DataFrame, keys: list[str]) -> DataFrame:
    """OCR lines to inject: important, not contained in the joined text and not similar (>= 0.8) to any single text.

    lines: keys, pos, text; got: keys, text; hay: keys, hay (joined normal text)."""
    left = cut(_absent(lines.where(T.is_important(F.col("text"))).withColumn("n", T.norm(F.col("text"))), hay, keys))
    k = F.struct(*keys)
    sim = _similar(left.select(k.alias("page"), F.col("n").alias("a")), got.select(k.alias("page"), T.norm(F.col("text")).alias("b")), COVERED_RATIO)
    close = sim.select(*[F.col(f"page.{c}").alias(c) for c in keys], F.col("a").alias("n")).distinct()
    return left.join(close, [*keys, "n"], "left_anti").select(*keys, "pos", "text")


def free_lines(lines: DataFrame, text_boxes: DataFrame, keys: list[str], ident: str = "line_id") -> DataFrame:
    """OCR lines whose centre lies in no text component."""
    pts = lines.select(*keys, ident, *[c.alias(n) for c, n in zip(B.centre(B.box()), ("cx", "cy"))])
    owned = points_in_boxes(pts, text_boxes.select(*keys, "x0", "y0", "x1", "y1"), keys).select(*keys, F.col(f"a.{ident}").alias(ident)).distinct()
    return lines.join(owned, [*keys, ident], "left_anti")


def assign_lines(lines: DataFrame, comps: DataFrame, keys: list[str]) -> DataFrame:
    """Lines inside a component's box up to max(12, a quarter of the line height) px: (keys, line_id, pos, h).

    A line may lie next to the box within that tolerance, so lines are paired by their boxes grown by it."""
    tol = F.greatest(F.lit(12.0), 0.25 * (F.col("y1") - F.col("y0")))
    grown = lines.select(*keys, "line_id", tol.alias("tol"), (F.col("y1") - F.col("y0")).alias("h"),
                         *[(F.col(c) - tol - 1).alias(c) for c in ("x0", "y0")], *[(F.col(c) + tol + 1).alias(c) for c in ("x1", "y1")])
    slack = F.col("a.tol") + F.col("a.tol") + 1
    inside = ((F.col("a.x0") >= F.col("b.x0") - slack) & (F.col("a.y0") >= F.col("b.y0") - slack)
              & (F.col("a.x1") <= F.col("b.x1") + slack) & (F.col("a.y1") <= F.col("b.y1") + slack))
    p = box_pairs(grown, keys, lambda a, b: inside, right=comps.select(*keys, "pos", "x0", "y0", "x1", "y1"))
    return p.select(*keys, F.col("a.line_id").alias("line_id"), F.col("b.pos").alias("pos"), F.col("a.h").alias("h"))


def line_height_of_shape(shapes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median height of the OCR lines whose normal text contains, or is contained in, the shape's text.

    Both directions run through `contained`: lines with a shape's text in them, and lines found in a shape's text."""
    s = shapes.select(*keys, "shape_id", T.norm(F.col("text")).alias("sn")).where("sn <> ''")
    l = lines.where("h_px > 0").select(*keys, "line_id", T.norm(F.col("text")).alias("ln"), "h_px").where("ln <> ''")
    inside = contained(s.select(*keys, F.col("sn").alias("n")), l.select(*keys, F.col("line_id").alias("text_id"), F.col("ln").alias("text")), keys)
    fwd = inside.withColumnRenamed("text_id", "line_id").withColumnRenamed("n", "sn").join(s, [*keys, "sn"])
    around = contained(l.select(*keys, F.col("ln").alias("n")), s.select(*keys, F.col("shape_id").alias("text_id"), F.col("sn").alias("text")), keys)
    back = around.withColumnRenamed("text_id", "shape_id").withColumnRenamed("n", "ln").join(l, [*keys, "ln"])
    pairs = fwd.select(*keys, "shape_id", "line_id").union(back.select(*keys, "shape_id", "line_id")).distinct()
    counted = pairs.join(l.select(*keys, "line_id", "h_px"), [*keys, "line_id"]).groupBy(*keys, "shape_id", "h_px").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "shape_id")
    c = counted.withColumns({"_to": F.sum("n").over(w.orderBy("h_px").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(w)})
    return c.where("_to > _all div 2").groupBy(*keys, "shape_id").agg(F.min("h_px").alias("h"))


def pages_to_repair(cov: DataFrame, minimum: float = 0.9) -> DataFrame:
    return cov.where(F.col("coverage") < minimum)
