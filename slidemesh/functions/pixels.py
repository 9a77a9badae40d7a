"""Pixel measures as Arrow UDFs over raw image columns (row-major BGR or BGRA bytes, h, w, channels)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from slidemesh.functions import boxes as B


def _image(data, h, w, c) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(int(h), int(w), int(c))


def _images(data: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> Iterator[np.ndarray]:
    """One image at a time, on the bytes where Arrow has them."""
    for d, *shape in zip(data, h.to_pylist(), w.to_pylist(), c.to_pylist()):
        yield _image(d.as_buffer(), *shape)


def _crop(img: np.ndarray, box) -> np.ndarray:
    x0, y0, x1, y1 = (int(v) for v in box)
    return img[max(0, y0):max(0, y1), max(0, x0):max(0, x1)]


_RUNS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("y", "x0", "x1")]))


@F.arrow_udf(_RUNS)
def content_runs(data: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array) -> pa.Array:
    """Rows of pixels whose largest channel distance to the median of a 4 px border exceeds 12."""
    runs, ends = [], [0]
    for img in _images(data, h, w, c):
        img = img[..., :3].astype(np.int16)
        edge = np.concatenate([img[:4].reshape(-1, 3), img[-4:].reshape(-1, 3), img[:, :4].reshape(-1, 3), img[:, -4:].reshape(-1, 3)])
        mask = np.abs(img - np.median(edge, axis=0)).max(axis=2) > 12
        step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        ys, starts = np.nonzero(step == 1)
        runs.append(np.stack([ys, starts, np.nonzero(step == -1)[1]]).astype(np.int32))
        ends.append(ends[-1] + len(ys))
    flat = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in flat], ["y", "x0", "x1"]))


def _box_measure(fn):
    @F.arrow_udf(DoubleType())
    def run(data: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array, box: pa.Array) -> pa.Array:
        return pa.array([fn(img, b.as_py()) for img, b in zip(_images(data, h, w, c), box)], pa.float64(), from_pandas=True)
    return run


def _white(img, box):
    p = _crop(img, box)
    opaque = p[..., 3] > 0 if p.shape[2] == 4 else np.ones(p.shape[:2], dtype=bool)
    n = int(opaque.sum())
    return 1.0 if n == 0 else float(((p[..., :3] >= 250).all(axis=2) & opaque).sum() / n)


def _ink(img, box):
    p = _crop(img, box)
    dy, dx = int(p.shape[0] * 0.06), int(p.shape[1] * 0.06)
    p = p[dy:p.shape[0] - dy, dx:p.shape[1] - dx, :3].astype(float)
    grey = p @ np.array([0.114, 0.587, 0.299]) if p.size else np.zeros(0)
    return float((grey < 230).mean()) if grey.size else 0.0


def _spread(img, box):
    p = _crop(img, box)[..., :3].astype(float)
    return float(p.reshape(-1, 3).std(axis=0).max()) if p.size else None


white_ratio = _box_measure(_white)      # share of opaque pixels that are >= 250 in all channels
ink_fraction = _box_measure(_ink)       # share of grey < 230 pixels inside a 6 % border
channel_spread = _box_measure(_spread)  # largest channel deviation; NULL when nothing can be read


@F.arrow_udf(ArrayType(IntegerType()))
def mean_rgb(data: pa.Array, h: pa.Array, w: pa.Array, c: pa.Array, box: pa.Array, cells: pa.Array) -> pa.Array:
    """Integer mean colour of a box reduced to cells x cells block means (area resampling)."""
    out = []
    for img, b, n in zip(_images(data, h, w, c), box, cells.to_pylist()):
        b, (hh, ww) = b.as_py(), img.shape[:2]
        x0 = max(0, min(int(b[0]), int(ww) - 1)); x1 = max(x0 + 1, min(int(b[2]), int(ww)))  # noqa: E702
        y0 = max(0, min(int(b[1]), int(hh) - 1)); y1 = max(y0 + 1, min(int(b[3]), int(hh)))  # noqa: E702
        p = img[y0:y1, x0:x1, :3].astype(float)
        sums = np.pad(p.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0), (0, 0)))    # whole numbers, so that differences are exact
        (ya, yb), (xa, xb) = (((e := np.linspace(0, size, n + 1).astype(int))[:-1], np.maximum(e[:-1] + 1, e[1:])) for size in p.shape[:2])
        blocks = sums[yb][:, xb] - sums[ya][:, xb] - sums[yb][:, xa] + sums[ya][:, xa]
        means = (blocks / ((yb - ya)[:, None] * (xb - xa))[..., None]).round()
        bgr = means.sum(axis=(0, 1)) // (n * n)
        out.append([int(bgr[2]), int(bgr[1]), int(bgr[0])])
    return pa.array(out, pa.list_(pa.int32()))


@F.pandas_udf(ArrayType(IntegerType()))
def ink_colour(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, box: pd.Series) -> pd.Series:
    """Median colour of pixels far (> 120 summed) from the border median; black or white by background brightness when there is none."""
    out = []
    for d, hh, ww, cc, b in zip(data, h, w, c, box):
        p = _crop(_image(d, hh, ww, cc), b)[..., 2::-1].astype(int)
        if not p.size:
            out.append([0, 0, 0])
            continue
        edge = np.concatenate([p[0], p[-1], p[:, 0], p[:, -1]])
        upper = lambda v: np.sort(v, axis=0)[len(v) // 2]
        bg = upper(edge)
        far = p.reshape(-1, 3)[np.abs(p.reshape(-1, 3) - bg).sum(axis=1) > 120]
        dark = 0.299 * bg[0] + 0.587 * bg[1] + 0.114 * bg[2] < 128
        out.append([int(v) for v in upper(far)] if len(far) else [255] * 3 if dark else [0] * 3)
    return pd.Series(out)


_BOX = ArrayType(DoubleType())


@F.pandas_udf(_BOX)
def ink_box(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, box: pd.Series, search: pd.Series, pad: pd.Series) -> pd.Series:
    """Box of the pixels below 235 within `search` px around the box, grown by `pad`; NULL when the area is white."""
    out = []
    for d, hh, ww, cc, b, s, q in zip(data, h, w, c, box, search, pad):
        x0, y0, x1, y1 = max(0, int(b[0]) - s), max(0, int(b[1]) - s), min(int(ww), int(b[2]) + s), min(int(hh), int(b[3]) + s)
        dark = (_image(d, hh, ww, cc)[y0:y1, x0:x1, :3] < 235).any(axis=2)
        if not dark.any():
            out.append(None)
            continue
        ys, xs = np.nonzero(dark)
        out.append([float(max(x0, x0 + xs.min() - q)), float(max(y0, y0 + ys.min() - q)), float(min(x1, x0 + xs.max() + 1 + q)), float(min(y1, y0 + ys.max() + 1 + q))])
    return pd.Series(out)


_METRICS = StructType([StructField("mse", DoubleType()), StructField("ssim", DoubleType())])


@F.pandas_udf(_METRICS)
def image_difference(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.DataFrame:
    """Mean squared error and structural similarity (7 x 7 uniform windows, sample covariance) of equally sized images."""
    rows = []
    for da, db, hh, ww, cc in zip(a, b, h, w, c):
        x, y = _image(da, hh, ww, cc)[..., :3].astype(float), _image(db, hh, ww, cc)[..., :3].astype(float)
        rows.append((float(((x - y) ** 2).mean()), float(np.mean([_ssim(x[..., k], y[..., k]) for k in range(x.shape[2])]))))
    return pd.DataFrame(rows, columns=["mse", "ssim"])


def _ssim(x: np.ndarray, y: np.ndarray, n: int = 7) -> float:
    def mean(v):
        s = np.cumsum(np.cumsum(np.pad(v, ((1, 0), (1, 0))), axis=0), axis=1)
        return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)
    ux, uy = mean(x), mean(y)
    k = n * n / (n * n - 1)
    vx, vy, vxy = k * (mean(x * x) - ux * ux), k * (mean(y * y) - uy * uy), k * (mean(x * y) - ux * uy)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux**2 + uy**2 + c1) * (vx + vy + c2))).mean())


def psnr(mse: Column) -> Column:
    """Peak signal-to-noise ratio, 99 for equal images."""
    return F.when(mse <= 1e-9, F.lit(99.0)).otherwise(20 * F.log10(255.0 / F.sqrt(mse)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def drop_blank(regions: DataFrame, image: str = "image", minimum: float = 8.0) -> DataFrame:
    """Missed regions on blank ground go (channel deviation < 8); degenerate boxes go, unreadable ones stay."""
    i = F.col(image)
    s = channel_spread(i["data"], i["height"], i["width"], i["nChannels"], B.box().array())
    return regions.where(B.nonempty(B.box())).withColumn("_s", s).where(F.col("_s").isNull() | (F.col("_s") >= minimum)).drop("_s")


def tighten(comps: DataFrame, image: str = "image") -> DataFrame:
    """Text boxes flagged loose take their mask box, else the box of dark pixels plus 2 px. Needs bbox_is_tight, tight_box (array or NULL)."""
    i = F.col(image)
    found = ink_box(i["data"], i["height"], i["width"], i["nChannels"], B.box().array(), F.lit(0), F.lit(2))
    loose = F.col("is_text_only") & ~F.col("bbox_is_tight")
    new = F.when(loose, F.coalesce("tight_box", found))
    return _with_box(comps.withColumn("_n", new), "bbox_was_tightened")


def expand(comps: DataFrame, image: str = "image") -> DataFrame:
    """Text boxes flagged too small grow to the dark pixels within 30 px plus 5 px; never shrink, changes under 1 px are skipped."""
    i = F.col(image)
    found = ink_box(i["data"], i["height"], i["width"], i["nChannels"], B.box().array(), F.lit(30), F.lit(5))
    small = F.col("is_text_only") & F.col("bbox_is_too_small")
    b, f = B.box(), B.box_of_array(F.col("_f"))
    grown = F.array(F.least(b.x0, f.x0), F.least(b.y0, f.y0), F.greatest(b.x1, f.x1), F.greatest(b.y1, f.y1))
    moved = F.greatest(*[F.abs(p - q) for p, q in zip(B.box_of_array(F.col("_g")), b)]) >= 1
    d = comps.withColumn("_f", F.when(small, found)).withColumn("_g", F.when(F.col("_f").isNotNull(), grown))
    return _with_box(d.withColumn("_n", F.when(moved, F.col("_g"))).drop("_f", "_g"), "bbox_was_expanded")


def _with_box(df: DataFrame, flag: str) -> DataFrame:
    n = B.box_of_array(F.col("_n"))
    return df.withColumns({flag: F.col("_n").isNotNull(), **{k: F.coalesce(v, F.col(k).cast("double")) for k, v in zip(("x0", "y0", "x1", "y1"), n)}}).drop("_n")


# box coverage without pixels ---------------------------------------------------------------------------------------
HOT_COVER = 1_000       # boxes of a key beyond which its plane is cut into tiles


def _depth_areas(xs: list, ys: list, ds: list) -> list[tuple]:
    """(area under any box, area under more than one) from the corners of boxes sorted by y, each with the change of depth below and right of it."""
    cols = sorted(set(xs))
    at = {x: k for k, x in enumerate(cols)}
    if len(xs) <= 64:
        change, covered, overlapped, last = [0] * len(cols), 0, 0, None
        for y in sorted(set(ys)):
            if last is not None:
                depth = one = two = 0
                for k in range(len(cols) - 1):
                    depth += change[k]
                    if depth > 0:
                        one += cols[k + 1] - cols[k]
                        if depth > 1:
                            two += cols[k + 1] - cols[k]
                covered, overlapped = covered + one * (y - last), overlapped + two * (y - last)
            for x, v, d in zip(xs, ys, ds):
                if v == y:
                    change[at[x]] += d
            last = y
        return [(covered, overlapped)]
    x, y, d = np.searchsorted(cols, xs), np.asarray(ys), np.asarray(ds)
    wide, starts = np.diff(cols), np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
    change, covered, overlapped = np.zeros(len(cols), np.int64), 0, 0
    for k, a in enumerate(starts):
        if k:
            depth = np.cumsum(change)[:-1]
            high = y[a] - y[a - 1]
            covered, overlapped = covered + (wide[depth > 0].sum() * high).item(), overlapped + (wide[depth > 1].sum() * high).item()
        b = starts[k + 1] if k + 1 < len(starts) else len(y)
        np.add.at(change, x[a:b], d[a:b])
    return [(covered, overlapped)]


def union_area(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Covered area and area covered more than once per key.

    A box changes the depth at its four corners; equal corners of a key add up in one hash aggregate, so a stack of boxes costs no more than
    its corners, and one sweep over the rows of corners gives the areas. Keys of many boxes are cut into tiles of about half a mean box,
    so that all pieces are a few times the boxes; tiles are swept apart and added up. Whole tiles under a box only raise their depth."""
    from slidemesh.operators.assign import per_key

    b = boxes.select(*keys, "x0", "y0", "x1", "y1").where(B.nonempty(B.box()))
    exact = b.schema["x0"].dataType.simpleString() in ("int", "bigint")
    w, h = (F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")
    edge = F.greatest(F.sqrt(F.avg(w * h)), F.avg(w), F.avg(h)) / 2
    hot = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.ceil(edge) if exact else edge).alias("_t")).where(F.col("_n") > HOT_COVER).drop("_n")
    tile = lambda a, z: F.sequence(F.floor(F.col(a) / F.col("_t")), F.greatest(F.floor(F.col(a) / F.col("_t")), F.ceil(F.col(z) / F.col("_t")) - 1))
    none = F.array(F.lit(0).cast("long"))
    t = b.join(hot, keys, "left").withColumn("_tx", F.explode(F.when(F.col("_t").isNull(), none).otherwise(tile("x0", "x1"))))
    t = t.withColumn("_ty", F.explode(F.when(F.col("_t").isNull(), none).otherwise(tile("y0", "y1"))))
    kind = b.schema["x0"].dataType
    clip = lambda c, k: F.when(F.col("_t").isNull(), F.col(c)).otherwise(F.least(F.greatest(F.col(c), F.col(k) * F.col("_t")), (F.col(k) + 1) * F.col("_t"))).cast(kind)
    t = t.select(*keys, "_tx", "_ty", clip("x0", "_tx").alias("x0"), clip("y0", "_ty").alias("y0"), clip("x1", "_tx").alias("x1"), clip("y1", "_ty").alias("y1"))
    four = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(d).alias("d")) for x, y, d in (("x0", "y0", 1), ("x1", "y0", -1), ("x0", "y1", -1), ("x1", "y1", 1))])
    own = [*keys, "_tx", "_ty"]
    net = t.select(*own, F.explode(four).alias("c")).groupBy(*own, F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("c.d").alias("d")).where("d <> 0")
    unit = "long" if exact else "double"
    areas = per_key(net, own, ["y", "x"], ["x", "y", "d"], _depth_areas, f"covered {unit}, overlapped {unit}")
    return areas.groupBy(*keys).agg(F.sum("covered").alias("covered"), F.sum("overlapped").alias("overlapped"))


def scan_scores(area: DataFrame, content: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage of content, share not covered twice, and their 0.9 / 0.1 combination (content_px, covered_px, covered, overlapped)."""
    j = area.join(content, keys)
    cov = F.when(F.col("content_px") > 0, F.col("covered_px") / F.col("content_px")).otherwise(1.0)
    non = F.when(F.col("covered") > 0, 1 - F.col("overlapped") / F.col("covered")).otherwise(1.0)
    return j.select(*keys, cov.alias("coverage"), non.alias("non_overlap"), (0.9 * cov + 0.1 * non).alias("scan"))


def covered_content(content: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Content pixels and those inside some box: content runs (keys, y, x0, x1) against boxes, merged per row."""
    total = content.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("content_px"))
    r, b = content.alias("r"), boxes.alias("b")
    eq = B.all_of(*[F.col(f"r.{k}") == F.col(f"b.{k}") for k in keys], F.col("b.y0") <= F.col("r.y"), F.col("r.y") < F.col("b.y1"), F.col("r.x0") < F.col("b.x1"), F.col("b.x0") < F.col("r.x1"))
    hit = r.join(b, eq).select(*[F.col(f"r.{k}") for k in keys], F.col("r.y").alias("y0"), (F.col("r.y") + 1).alias("y1"), F.greatest("r.x0", "b.x0").alias("x0"), F.least("r.x1", "b.x1").alias("x1"))
    cov = union_area(hit, keys).select(*keys, F.col("covered").alias("covered_px"))
    return total.join(cov, keys, "left").fillna(0, ["covered_px"])
