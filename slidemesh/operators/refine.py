"""Refinement of merge groups by verdicts: absorb a neighbour, cut it out, or schedule a pixel erase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.operators.assign import per_key
from slidemesh.operators.layout import is_text_prone

ROUNDS, MIN_LEFT, PAD = 3, 0.15, 2.0  # fixed values


class _Cells:
    """Rectilinear areas as sets of the cells between the distinct edges of all boxes involved: bits of one integer, row by row."""

    def __init__(self, boxes: list[tuple]):
        self.xs = sorted({v for b in boxes for v in (b[0], b[2])})
        self.ys = sorted({v for b in boxes for v in (b[1], b[3])})
        self.col, self.row = {v: i for i, v in enumerate(self.xs)}, {v: i for i, v in enumerate(self.ys)}
        self.w, self.h = len(self.xs) - 1, len(self.ys) - 1
        self.line = (1 << self.w) - 1
        self.rows = [0]                       # the first cells of the rows before each row
        for r in range(self.h):
            self.rows.append(self.rows[-1] | 1 << r * self.w)
        self.inner = self.rows[-1] * (self.line & ~1)     # cells with one to their left
        self.least = min((b - a for a, b in zip(self.xs, self.xs[1:])), default=0) * min((b - a for a, b in zip(self.ys, self.ys[1:])), default=0)

    def rect(self, b: tuple) -> int:
        x0, x1, y0, y1 = self.col[b[0]], self.col[b[2]], self.row[b[1]], self.row[b[3]]
        return (self.rows[y1] ^ self.rows[y0]) * ((1 << x1) - (1 << x0)) if x0 < x1 and y0 < y1 else 0

    def _width(self, line: int) -> float:
        out = 0.0
        while line:
            low = line & -line
            run = line & ~(line + low)        # the run of cells that begins with the first one
            out += self.xs[run.bit_length()] - self.xs[low.bit_length() - 1]
            line ^= run
        return out

    def area(self, m: int) -> float:
        out, r, at, wide = 0.0, 0, 0, 0.0
        while m:
            if (line := m & self.line) != at:
                at, wide = line, self._width(line)
            out += wide * (self.ys[r + 1] - self.ys[r])
            m >>= self.w
            r += 1
        return out

    def over(self, m: int) -> bool:
        """Whether the area is more than one."""
        return m != 0 and (self.least > 1.0 or self.area(m) > 1.0)

    def bounds(self, m: int) -> tuple:
        top, bottom, cols = ((m & -m).bit_length() - 1) // self.w, (m.bit_length() - 1) // self.w, 0
        rest = m
        while rest:
            cols |= rest & self.line
            rest >>= self.w
        return float(self.xs[(cols & -cols).bit_length() - 1]), float(self.ys[top]), float(self.xs[cols.bit_length()]), float(self.ys[bottom + 1])

    def grown(self, part: int, within: int) -> int:
        """All cells of `within` connected with `part` through cell sides."""
        while True:
            more = (part | part << self.w | part >> self.w | (part << 1) & self.inner | (part & self.inner) >> 1) & within
            if more == part:
                return part
            part = more

    def largest(self, m: int) -> int:
        """The largest part connected through cell sides, the first one on ties."""
        best, size, left = 0, -1.0, m
        while left:
            part = self.grown(left & -left, left)
            if part == m:
                return m
            if (own := self.area(part)) > size:
                best, size = part, own
            left &= ~part
        return best

    def has_hole(self, m: int) -> bool:
        others = self.line * self.rows[-1] & ~m
        border = self.line | self.line << (self.h - 1) * self.w | self.rows[-1] | self.rows[-1] << self.w - 1
        return self.grown(others & border, others) != others

    def boxes(self, m: int) -> list[tuple]:
        """The cells, as runs along the rows."""
        out = []
        for r in range(self.h):
            line = m >> r * self.w & self.line
            while line:
                x0 = (line & -line).bit_length() - 1
                x1 = x0 + (~(line >> x0) & -~(line >> x0)).bit_length() - 1
                out.append((self.xs[x0], self.ys[r], self.xs[x1], self.ys[r + 1]))
                line &= -1 << x1
        return out


def _common(a: tuple, b: tuple) -> tuple:
    return max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])


def _size(b: tuple) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _refine(box: tuple, text: bool, members: dict, cands: list[tuple], absorbed: set) -> tuple:
    """One group: (bounds, members, erases, area, rectangular). cands: (file, text, box, should_merge, visually_overlaps)."""
    if _size(box) > 0 and not any(c[0] not in members and c[0] not in absorbed and _size(_common(box, c[2])) > 1.0 for c in cands):
        # nothing to absorb or cut: the area stays one box, and no cells are needed
        if members:
            u = list(members.values())
            tight = _common(box, (min(b[0] for b in u) - PAD, min(b[1] for b in u) - PAD, max(b[2] for b in u) + PAD, max(b[3] for b in u) + PAD))
            box = tight if _size(tight) > 0 else box
        return tuple(float(v) for v in box), sorted(members), [], float(_size(box)), True
    cands = [c for c in cands if c[0] not in members and c[0] not in absorbed]
    g = _Cells([box, *[c[2] for c in cands]])
    rects = [g.rect(c[2]) for c in cands]
    geom, no, erases = g.rect(box), set(), []
    for _ in range(ROUNDS):
        changed = False
        now = [(c, r) for c, r in zip(cands, rects) if c[0] not in absorbed and c[0] not in no and g.over(geom & r)]
        for (name, c_text, b, merge, visual), r in now:
            if changed and not g.over(geom & r):
                continue
            if merge:
                geom = geom | r
                members[name] = b
                absorbed.add(name)
                changed = True
                continue
            no.add(name)
            if not visual:
                rest = geom & ~r
                if not rest:
                    continue
                rest = g.largest(rest)
                if g.has_hole(rest):
                    continue
                if g.area(rest) / max(1e-6, g.area(geom)) >= MIN_LEFT:
                    geom, changed = rest, True
                    continue
            if not (text or c_text):
                erases.append(name)
        if not changed:
            break
    if not geom:
        return tuple(float(v) for v in box), sorted(members), erases, 0.0, True
    b = g.bounds(geom)
    if members:
        u = list(members.values())
        cut = (min(m[0] for m in u) - PAD, min(m[1] for m in u) - PAD, max(m[2] for m in u) + PAD, max(m[3] for m in u) + PAD)
        if _common(b, cut) != b and _size(_common(b, cut)) > 0:
            # only here edges other than those of the boxes matter
            runs = [x for x in (_common(x, cut) for x in g.boxes(geom)) if _size(x) > 0]
            if runs:
                g = _Cells(runs)
                geom = 0
                for x in runs:
                    geom |= g.rect(x)
                geom = g.largest(geom)
                b = g.bounds(geom)
    return b, sorted(members), erases, g.area(geom), geom == g.rect(b)


def refine_groups(groups: DataFrame, comps: DataFrame, decisions: DataFrame) -> DataFrame:
    """Refined groups: slide_id, group_idx, x0..y1, members, erases, area, rectangular.

    groups: slide_id, group_idx, merged_class, member_filenames, x0..y1; comps: slide_id, pos, filename, label, box; decisions:
    slide_id, group_idx, filename, should_merge, visually_overlaps. Only components with a verdict and members reach the
    walk, which goes through the groups of a slide in order because an absorbed component is lost to later groups."""
    box = ["x0", "y0", "x1", "y1"]
    none = F.lit(None).cast("boolean")
    head = groups.select("slide_id", "group_idx", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("filename"), is_text_prone(F.col("merged_class")).alias("text"),
                         *[F.col(c).cast("double").alias(c) for c in box], none.alias("merge"), none.alias("visual"))
    c = comps.select("slide_id", F.col("pos").cast("long").alias("pos"), "filename", is_text_prone(F.col("label")).alias("text"), *[F.col(k).cast("double").alias(k) for k in box])
    own = groups.select("slide_id", "group_idx", F.explode("member_filenames").alias("filename")).join(c, ["slide_id", "filename"])
    ask = decisions.select("slide_id", "group_idx", "filename", F.col("should_merge").alias("merge"), F.coalesce("visually_overlaps", F.lit(True)).alias("visual")).join(c, ["slide_id", "filename"])
    cols = ["group_idx", "kind", "pos", "filename", "text", *box, "merge", "visual"]
    rows = (head.select("slide_id", *cols).unionByName(own.withColumns({"kind": F.lit(1), "merge": none, "visual": none}).select("slide_id", *cols))
            .unionByName(ask.withColumn("kind", F.lit(2)).select("slide_id", *cols)))

    def walk(*lists: list) -> list[tuple]:
        by: dict = {}
        absorbed: set = set()
        for idx, kind, _, name, text, x0, y0, x1, y1, merge, visual in zip(*lists):
            e = by.setdefault(idx, {"members": {}, "cands": []})
            b = (x0, y0, x1, y1)
            if kind == 0:
                e["box"], e["text"] = b, text
            elif kind == 1:
                e["members"][name] = b
                absorbed.add(name)
            else:
                e["cands"].append((name, text, b, merge, visual))
        out = []
        for idx in sorted(by):
            e = by[idx]
            if "box" in e:
                b, members, erases, area, rect = _refine(e["box"], e["text"], e["members"], e["cands"], absorbed)
                out.append((idx, *b, members, erases, area, rect))
        return out

    return per_key(rows, ["slide_id"], ["group_idx", "kind", "pos"], cols, walk,
                   "group_idx int, x0 double, y0 double, x1 double, y1 double, members array<string>, erases array<string>, area double, rectangular boolean")
