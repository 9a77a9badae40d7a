"""Colours as Columns: hex normalisation, luminance, contrast, palette decisions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_CONTRAST = 4.5   # fixed value
LOCAL_CONTRAST = 3.0  # fixed value


def _digit_table() -> tuple[str, str]:
    """Every non-ASCII character with a digit value, and full-width letters A-F/a-f and '#', with their ASCII form.

    Built from the Unicode database rather than listed."""
    src, dst = [], []
    for cp in range(0x80, 0x1FBFF):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF:
            continue
        n = unicodedata.normalize("NFKC", ch)
        d = unicodedata.digit(n, -1) if len(n) == 1 else -1
        if d >= 0:
            src.append(ch), dst.append(str(d))
        elif len(n) == 1 and n in "ABCDEFabcdef#":
            src.append(ch), dst.append(n)
    return "".join(src), "".join(dst)


_FROM, _TO = _digit_table()


def hex_norm(c: Column) -> Column:
    """Six upper-case hex digits without '#', 3-digit form doubled; NULL for anything else."""
    t = F.upper(F.regexp_replace(F.translate(F.trim(c), _FROM, _TO), "^#+", ""))
    t = F.when(F.length(t) == 3, F.regexp_replace(t, "(.)", "$1$1")).otherwise(t)
    return F.when(t.rlike("^[0-9A-F]{6}$"), t)


def hex_rgb(c: Column) -> Column:
    t = hex_norm(c)
    return F.when(t.isNotNull(), F.struct(*[F.conv(F.substring(t, i, 2), 16, 10).cast("int").alias(n) for i, n in ((1, "r"), (3, "g"), (5, "b"))]))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    def chan(v):
        c = v / 255.0
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * chan(r) + 0.7152 * chan(g) + 0.0722 * chan(b)


def contrast(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    la, lb = luminance(*a), luminance(*b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def rgb(prefix: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in "rgb")


def keep_run_colour(fg: tuple, bg: tuple, known: Column, minimum: float = TEXT_CONTRAST) -> Column:
    """A run keeps its colour only when the colour is known and readable on the background."""
    return F.coalesce(known & (contrast(fg, bg) >= minimum), F.lit(False))


def best_candidate(candidates: list[str], bg: tuple) -> Column:
    """Hex of the candidate with the highest contrast on `bg`; the first wins ties."""
    def one(i, h):
        c = tuple(F.lit(int(h[k:k + 2], 16)) for k in (0, 2, 4))
        return F.struct(contrast(c, bg).alias("ratio"), F.lit(-i).alias("pos"), F.lit(h).alias("hex"))
    return F.array_max(F.array(*[one(i, h) for i, h in enumerate(candidates)]))["hex"]


def background_of(palette: Column, words: tuple[str, ...] = ("background", "base", "ground")) -> Column:
    """First palette entry (array of struct hex, role) with a usable colour and a background-like role, else the first entry, else white."""
    def is_bg(e):
        r = F.lower(F.coalesce(e["role"], F.lit("")))
        return reduce(lambda p, q: p | q, [F.contains(r, F.lit(w)) for w in words]) & hex_norm(e["hex"]).isNotNull()
    hit = F.try_element_at(F.filter(palette, is_bg), F.lit(1))["hex"]
    return F.coalesce(hex_norm(hit), hex_norm(F.try_element_at(palette, F.lit(1))["hex"]), F.lit("FFFFFF"))


def palette_default(palette: Column) -> Column:
    """Backing colour: first role naming a background, else the first entry, else NULL."""
    hit = F.try_element_at(F.filter(palette, lambda e: F.contains(F.lower(F.coalesce(e["role"], F.lit(""))), F.lit("background"))), F.lit(1))["hex"]
    return F.coalesce(hit, F.try_element_at(palette, F.lit(1))["hex"])


def valid_colour_map(raw: Column, seen: Column, theme: Column) -> Column:
    """Keep map entries whose source colour was seen and whose target is in the theme; both normalised."""
    pairs = F.transform(F.map_entries(raw), lambda e: F.struct(hex_norm(e["key"]).alias("key"), hex_norm(e["value"]).alias("value")))
    ok = F.filter(pairs, lambda e: F.coalesce(F.array_contains(seen, e["key"]) & F.array_contains(theme, e["value"]), F.lit(False)))
    # a later spelling of the same source replaces an earlier one
    return F.aggregate(ok, F.create_map().cast("map<string,string>"),
                       lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def recolour(current: Column, mapping: Column) -> Column:
    """Apply a validated map; colours outside it stay."""
    return F.coalesce(F.try_element_at(mapping, hex_norm(current)), hex_norm(current))
