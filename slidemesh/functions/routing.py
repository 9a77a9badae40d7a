"""Routing of components to reconstruction classes 0-5 as CASE chains over answers and filename hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: hint and role vocabularies
PROTECTED_HINT_WORDS = [
    "logo", "icon", "photo", "photograph", "chart", "plot", "legend", "table", "callout", "annotation", "label", "title", "page",
    "number", "footer", "emoji", "arrow", "diagram", "screenshot", "equation", "formula", "coverage", "missed",
]
PROTECTED_ROLES = [
    "text", "label", "formula", "logo", "icon", "photo", "screenshot", "chart", "legend", "table", "technical_diagram",
    "shape_encoded_chart", "data_diagram", "flow_diagram", "callout", "annotation", "page_number", "other",
]
TEXT_ROLES = ["text", "label", "formula", "page_number"]
TABLE_ROLES = ["table"]
SHAPE_ROLES = [
    "icon", "legend", "technical_diagram", "shape_encoded_chart", "data_diagram", "flow_diagram", "callout", "annotation", "chart",
]
RASTER_ROLES = ["logo", "photo", "screenshot"]
ROLE_BY_HINT = [
    ("photo", ["photo", "photograph"]), ("screenshot", ["screenshot"]), ("logo", ["logo", "wordmark"]), ("chart", ["chart", "plot"]),
    ("table", ["table"]), ("technical_diagram", ["diagram", "flowchart", "architecture"]),
    ("callout", ["callout", "annotation", "speech"]), ("text", ["title", "label", "footer", "text", "number"]), ("icon", ["icon"]),
]
RASTER_HINTS = ["photo", "screenshot", "logo", "wordmark"]
SHAPE_HINTS = ["diagram", "flow", "arrow", "callout", "annotation", "icon", "legend"]
CRITIC_HINTS = ["diagram", "flowchart", "callout", "chart", "plot", "logo", "photo", "screenshot"]
CRITIC_ROLES = ["chart", "shape_encoded_chart", "data_diagram"]
LAYER_OF_CLASS = {5: 0, 4: 1, 3: 2, 2: 3, 1: 4}


def has_any(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def _role(role: Column) -> Column:
    return F.lower(F.coalesce(role, F.lit("")))


def valid_class(c: Column) -> Column:
    v = c.try_cast("int")
    return F.when(v.between(0, 5), v)


def role_from_hint(hint: Column) -> Column:
    out = F
    for role, words in ROLE_BY_HINT:
        out = out.when(has_any(hint, words), role)
    return out.otherwise("other")


def class_from_role(role: Column, hint: Column) -> Column:
    r = _role(role)
    return (F.when(r.isin(TEXT_ROLES) | has_any(hint, ["footer"]), 1).when(r.isin(TABLE_ROLES), 3).when(r.isin(RASTER_ROLES), 5)
            .when((r == "chart") & has_any(hint, ["line", "bar", "plot", "chart"]), 5).when(r.isin(SHAPE_ROLES), 4)
            .when(has_any(hint, RASTER_HINTS), 5).when(has_any(hint, SHAPE_HINTS), 4).otherwise(5))


def class_for_protected(role: Column, hint: Column, shape_ok: Column, raster: Column) -> Column:
    r = _role(role)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (F.when(r.isin(TEXT_ROLES), 1).when(r.isin(TABLE_ROLES), 3).when(r.isin(RASTER_ROLES) | yes(raster), 5)
            .when(r.isin(SHAPE_ROLES) | yes(shape_ok), 4).when(has_any(hint, RASTER_HINTS), 5).when(has_any(hint, SHAPE_HINTS), 4).otherwise(5))


def needs_critic(cls: Column, role: Column, hint: Column, confidence: Column) -> Column:
    return F.coalesce(cls.isin(0, 5), F.lit(False)) | F.coalesce((cls == 4) & _role(role).isin(CRITIC_ROLES), F.lit(False)) \
        | (F.lower(F.coalesce(confidence, F.lit(""))) == "low") | has_any(hint, CRITIC_HINTS)


def guarded_class(raw: Column, hint: Column, role: Column, drop_safe: Column, shape_ok: Column, raster: Column, audited: Column) -> Column:
    """Class 0 is refused for protected content. Returns struct(cls, flags)."""
    cls = valid_class(raw)
    protected = has_any(hint, PROTECTED_HINT_WORDS) | _role(role).isin(PROTECTED_ROLES) | F.coalesce(audited, F.lit(False))
    forced = class_for_protected(role, hint, shape_ok, raster)
    hit = (cls == 0) & (protected | F.coalesce(~drop_safe, F.lit(False)))
    return F.struct(F.when(hit, forced).otherwise(cls).alias("cls"),
                    F.when(hit, F.array(F.concat(F.lit("class0_guard_forced_to_class"), forced.cast("string"))))
                    .otherwise(F.array().cast("array<string>")).alias("flags"))


def recovered(raw: Column, parsed: Column, hint: Column) -> Column:
    """Fill what a broken answer still shows; `parsed` is a struct with the answer fields or NULL."""
    def grab(pattern):
        g = F.regexp_extract(F.coalesce(raw, F.lit("")), pattern, 1)
        return F.when(g != "", g)

    def flag(name):
        return F.coalesce(parsed[name], F.lower(grab(rf'(?i)"?{name}"?\s*:\s*(true|false)')) == "true").alias(name)

    good = valid_class(parsed["class"])
    role = F.when(good.isNotNull(), parsed["semantic_role"]).otherwise(F.coalesce(
        F.nullif(parsed["semantic_role"], F.lit("")),
        F.replace(F.lower(F.trim(grab(r'"?semantic_role"?\s*:\s*"?([A-Za-z0-9_ -]+)"?'))), F.lit(" "), F.lit("_")), role_from_hint(hint)))
    seen = valid_class(grab(r'"?class"?\s*:\s*"?([0-5])"?'))
    reason = F.coalesce(F.nullif(parsed["reason"], F.lit("")), grab(r'"?reason"?\s*:\s*"([^"]+)"'))
    fallback = good.isNull() & seen.isNull()
    return F.struct(F.coalesce(good, seen, class_from_role(role, hint)).alias("cls"), role.alias("semantic_role"),
                    flag("drop_safe"), flag("shape_approximable"), flag("raster_required"), flag("protected_content"),
                    F.coalesce(F.nullif(parsed["route_confidence"], F.lit("")), F.lower(grab(r'"?route_confidence"?\s*:\s*"?([A-Za-z]+)"?'))).alias("route_confidence"),
                    F.coalesce(reason, F.when(fallback, F.lit("classifier JSON parse failed; used safe hint fallback"))).alias("reason"))


def is_protected(role: Column) -> Column:
    return _role(role).isin(PROTECTED_ROLES)


def layer_of(cls: Column) -> Column:
    """Paint layer: rasters first, text last, unknown classes in the middle."""
    out = F
    for k, v in LAYER_OF_CLASS.items():
        out = out.when(cls == k, v)
    return out.otherwise(2)


def table_cells(n_rows: Column, n_cols: Column, header_row: Column, first_col: Column, max_rows: int = 32, max_cols: int = 16) -> Column:
    """Row-major cells with the style anchor each inherits; NULL when the structure is out of bounds."""
    ok = n_rows.between(1, max_rows) & n_cols.between(1, max_cols)
    def cell(r, c):
        anchor = F.when(header_row & (r == 0), "header").when(first_col & (c == 0), "first_col").otherwise("body")
        return F.struct(r.alias("row"), c.alias("col"), anchor.alias("anchor"))
    rows, cols = F.sequence(F.lit(0), n_rows - 1), F.sequence(F.lit(0), n_cols - 1)
    return F.when(ok, F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: cell(r, c)))))


def page_role(index: Column, n: Column) -> Column:
    return F.when(n <= 0, "content").when(index == 0, "opening").when(index == n - 1, "closing").otherwise("content")
