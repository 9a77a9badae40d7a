"""Main text of web pages by wrapper induction.

The pages of a host share templates. One page per host (the smallest hash) gives the wrapper's tree; every page is aligned with it by
simple tree matching, in which runs of equal siblings count as one repeated node. Over all pages of the host, each node gets the amount of
text that varies and the texts that stay constant: the deepest container that holds most of the varying text is the content slot, constant
texts inside it are template. A page's text is what it has in that slot. Menus, headers, footers, forms, adverts and the like are known
by element and name, wherever they stand. Trees are made page by page; only hashes, lengths and tree skeletons are shuffled."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.llm.common import Scratch, query, ship, table

MAX_DEPTH = 120         # deeper elements hang on the last level
SHARE = 0.7             # of the varying text, in the content slot
CONSTANT = 0.5          # of the host's distinct pages, with
LEAST = 5               # pages at least, for a text to be template

# Elements of HTML by their role.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
             "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template iframe object svg math canvas audio video select button textarea title head".split())
RAW = set("script style textarea title iframe noscript xmp".split())
BOILER = set("nav footer aside form menu dialog".split())
CONTAINERS = set("html body main article section div td table center".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NAMES = set("nav navbar navigation menu footer sidebar aside ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
            "gdpr notice alert popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations breadcrumb breadcrumbs "
            "pagination pager comment comments disqus replies widget toolbar login search contentinfo complementary".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class Node:
    """An element: its kids are elements and pieces of text, in order."""

    __slots__ = ("tag", "sig", "kids", "boiler", "depth")

    def __init__(self, tag: str, names: str = "", depth: int = 0, inside: bool = False):
        self.tag, self.kids, self.depth = tag, [], depth
        words = set(_WORD.findall(names.lower())) if names else set()
        self.sig = f"{tag}.{' '.join(sorted(w for w in words if not w.isdigit()))}" if words else tag
        firm = tag in ("html", "body", "article", "main")
        self.boiler = not firm and (tag in BOILER or bool(words & NAMES) or ((tag == "header" or "header" in words) and not inside))


def parse(text: str) -> Node:
    """Tree of a page; unclosed, misnested and cut elements are closed where HTML closes them, or at the end."""
    root = Node("#")
    stack = [root]
    at, low = 0, None
    inside = 0

    def close_to(k: int) -> None:
        nonlocal inside
        inside -= sum(n.tag in ("article", "main") for n in stack[k:])
        del stack[k:]

    while True:
        m = _TOKEN.search(text, at)
        if m is None:
            if at < len(text):
                stack[-1].kids.append(text[at:])
            return root
        if m.start() > at:
            stack[-1].kids.append(text[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            block = tag in BLOCKS
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if not block and stack[k].tag in BLOCKS:    # an inline end does not close blocks
                    break
            continue
        if tag in BLOCKS:
            shut = CLOSES.get(tag, set())
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t == "p" or t in shut:
                    close_to(k)
                    if not shut:
                        break
                elif t in BLOCKS and (not shut or t in SCOPE[tag]):
                    break
        names = " ".join(x[1] or x[2] or x[3] for x in _NAMED.findall(m[3])) if m[3] else ""
        node = Node(tag, names, stack[-1].depth + 1, inside > 0)
        stack[-1].kids.append(node)
        if tag in RAW and not m[3].endswith("/"):
            low = low or text.lower()
            end = low.find(f"</{tag}", at)
            end = len(text) if end < 0 else end
            if tag == "title":
                node.kids.append(text[at:end])
            close = text.find(">", end)
            at = len(text) if close < 0 else close + 1
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS) and node.depth < MAX_DEPTH:
            stack.append(node)
            inside += tag in ("article", "main")


class Run:
    """Consecutive siblings of one signature: merged kids, and the blocks of text that belong to each of them directly."""

    __slots__ = ("sig", "tag", "kids", "blocks", "many", "boiler", "no")

    def __init__(self, sig: str, tag: str, boiler: bool):
        self.sig, self.tag, self.boiler, self.kids, self.blocks, self.many, self.no = sig, tag, boiler, [], [], False, -1


def runs(root: Node) -> tuple[Run, list[tuple[Run, str, bool]]]:
    """(tree of runs, blocks of the page in order as (run, text, inside boilerplate))."""
    top, blocks = Run("#", "#", False), []
    pieces: list[str] = []
    owner: list = [top, False]

    def flush() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            blocks.append((owner[0], text, owner[1]))

    def walk(node: Node, run: Run, off: bool) -> None:
        last = None
        owner[:] = [run, off]
        for kid in node.kids:
            if isinstance(kid, str):
                pieces.append(kid)
            elif kid.tag in SKIPPED:
                continue
            elif kid.tag == "br":
                pieces.append(" ")
            elif kid.tag in BLOCKS:
                flush()
                if last is not None and last.sig == kid.sig:
                    last.many = True
                else:
                    last = Run(kid.sig, kid.tag, kid.boiler)
                    run.kids.append(last)
                fresh = Run(kid.sig, kid.tag, kid.boiler) if last.many else last
                walk(kid, fresh, off or kid.boiler)
                flush()
                if fresh is not last:
                    moved = merge(last, fresh)
                    for k in range(len(blocks) - 1, -1, -1):
                        if id(blocks[k][0]) not in moved:
                            break
                        blocks[k] = (moved[id(blocks[k][0])], *blocks[k][1:])
                owner[:] = [run, off]
            else:
                inline(kid, run, off)

    def inline(node: Node, run: Run, off: bool) -> None:
        if any(not isinstance(k, str) and k.tag in BLOCKS for k in node.kids) or node.boiler:
            flush()
            walk(node, run, off or node.boiler)     # blocks inside an inline element hang on the element around it
            flush()
            owner[:] = [run, off]
            return
        for kid in node.kids:
            if isinstance(kid, str):
                pieces.append(kid)
            elif kid.tag == "br":
                pieces.append(" ")
            elif kid.tag not in SKIPPED:
                inline(kid, run, off)

    walk(root, top, False)
    flush()
    return top, blocks


def matched(a: Run, b: Run) -> tuple[int, list[tuple[Run, Run]]]:
    """Simple tree matching: the largest number of nodes that can be paired in order under paired parents, and the pairs below a and b."""
    m, n = len(a.kids), len(b.kids)
    if not m or not n:
        return 1, []
    best = [[0] * (n + 1) for _ in range(m + 1)]
    below: dict[tuple[int, int], tuple] = {}
    for i, x in enumerate(a.kids):
        row, over = best[i + 1], best[i]
        for j, y in enumerate(b.kids):
            most = over[j + 1] if over[j + 1] >= row[j] else row[j]
            if x.sig == y.sig:
                below[i, j] = got = matched(x, y)
                most = max(most, over[j] + got[0])
            row[j + 1] = most
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += [(a.kids[i], b.kids[j]), *below[i, j][1]]
    return 1 + best[m][n], pairs


def merge(into: Run, more: Run) -> dict[int, Run]:
    """Fold the kids of `more` into `into`; returns where each run of `more` went, by identity."""
    moved = {id(more): into}
    if not more.kids:
        return moved
    if not into.kids:
        into.kids = more.kids
        stay = list(more.kids)
        while stay:
            r = stay.pop()
            moved[id(r)] = r
            stay += r.kids
        return moved
    pairs = matched(more, into)[1]
    for x, y in pairs:
        moved[id(x)] = y
        y.many |= x.many

    def place(x: Run, y: Run) -> None:
        at = 0
        for kid in x.kids:
            to = moved.get(id(kid))
            if to is None:
                y.kids.insert(at, kid)
                at += 1
                stay = [kid]
                while stay:
                    r = stay.pop()
                    moved[id(r)] = r
                    stay += r.kids
            else:
                at = next(k for k, r in enumerate(y.kids) if r is to) + 1
                place(kid, to)
    place(more, into)
    return moved


def skeleton(top: Run) -> str:
    def out(r: Run) -> list:
        return [r.sig, r.tag, int(r.boiler), int(r.many), [out(k) for k in r.kids]]
    return json.dumps(out(top), separators=(",", ":"))


def numbered(text: str) -> tuple[Run, list[Run]]:
    """Tree of a skeleton, and its runs by number."""
    every: list[Run] = []

    def back(x: list) -> Run:
        r = Run(x[0], x[1], bool(x[2]))
        r.many, r.no = bool(x[3]), len(every)
        every.append(r)
        r.kids = [back(k) for k in x[4]]
        return r
    return back(json.loads(text)), every


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def aligned(top: Run, wrapper: Run) -> None:
    """Give the runs of a page the numbers of the wrapper's runs they are paired with; -1 for the others."""
    top.no = 0
    for x, y in matched(top, wrapper)[1]:
        x.no = y.no


def content_slot(every: list[Run], varying: dict[int, int]) -> int:
    """Number of the deepest container, not repeated and not boilerplate, with most of the varying text; article and main end the descent."""
    mass = {}

    def total(r: Run) -> int:
        mass[r.no] = 0 if r.boiler else varying.get(r.no, 0) + sum(map(total, r.kids))
        return mass[r.no]

    def widest(r: Run) -> Run | None:
        fit = [k for k in r.kids if k.tag in CONTAINERS and not k.many and not k.boiler and mass[k.no] >= SHARE * mass[r.no] > 0]
        return max(fit, key=lambda k: mass[k.no], default=None)

    total(every[0])
    at = every[0]
    while at.tag not in ("article", "main") and (deeper := widest(at)) is not None:
        at = deeper
    return at.no


def extract(text: str, wrapper: tuple | None) -> str:
    """Main text of one page; `wrapper` is (tree, content slot, {(slot, hash) of template texts}, whether the slot is
    the whole page) or None."""
    top, blocks = runs(parse(text))
    kept = [b for b in blocks if not b[2]]
    inside: set[int] = set()

    def mark(r: Run) -> None:
        inside.add(id(r))
        for k in r.kids:
            mark(k)

    def seek(r: Run, test) -> None:
        if test(r):
            mark(r)
        else:
            for k in r.kids:
                seek(k, test)

    if wrapper is not None:
        tree, slot, template, wide = wrapper
        aligned(top, tree)
        seek(top, lambda r: r.no == slot)
        found = [b for b in kept if id(b[0]) in inside]
        if wide:        # no container holds most of the host's text: a page's own article, if it marks one
            inside.clear()
            seek(top, lambda r: r.tag in ("article", "main") and not r.boiler)
            found = [b for b in kept if id(b[0]) in inside] or found
        varying = [b for b in found if (b[0].no, text_hash(b[1])) not in template]
        # where most of a page seems constant its host repeats pages rather than frames: leave it whole
        if sum(len(b[1]) for b in varying) * 2 >= sum(len(b[1]) for b in found):
            found = varying
        if found:
            return "\n\n".join(b[1] for b in found)
        inside.clear()
    seek(top, lambda r: r.tag in ("article", "main") and not r.boiler)
    found = [b for b in kept if id(b[0]) in inside]
    return "\n\n".join(b[1] for b in found or kept)


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row: the main text, blocks joined by an empty line, "" if there is none.

    A null or empty html has no text; a null url, or one without host, belongs to the host "". Equal pages are counted once in the wrapper's
    statistics, so groups of copies do not turn their article into template. Ids may repeat or be null; other columns are not looked at; an
    empty table gives an empty result. The wrappers (about a kilobyte per host) are joined to the pages by host: Spark broadcasts
    them while they are small, else it shuffles, and splits a host that holds a large share of the pages."""
    ship(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "wrapper")
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
                       F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), _HOST, 1), F.lit(""))).alias("host"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[int, str]] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if page:
                    h = text_hash(page)
                    if host not in best or h < best[host][0]:
                        best[host] = (h, page)
            if len(best) > 2000:
                yield out(best)
                best = {}
        yield out(best)

    def out(best: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array([v[0] for v in best.values()], pa.int64()),
                                           pa.array([skeleton(runs(parse(v[1]))[0]) for v in best.values()], pa.string())], ["host", "hash", "tree"])

    trees = src.select("host", "html").mapInArrow(seeds, "host string, hash long, tree string").groupBy("host").agg(F.min_by("tree", "hash").alias("tree"))
    trees = scratch.save(trees, "trees")

    block = pa.list_(pa.struct([("no", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())]))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Run] = {}
        for b in batches:
            marks, lists = [], []
            for page, tree in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if tree not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[tree] = numbered(tree)[0]
                top, blocks = runs(parse(page))
                aligned(top, known[tree])
                own = [(r.no, text_hash(t), len(t)) for r, t, off in blocks if not off and r.no >= 0]
                marks.append(text_hash(" ".join(f"{no} {h}" for no, h, _ in own)))
                lists.append([{"no": no, "hash": h, "size": n} for no, h, n in dict.fromkeys(own)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.int64()), pa.array(lists, block)], ["host", "mark", "blocks"])

    looked = src.select("host", "html").join(trees, "host").select("host", "html", "tree").mapInArrow(align, "host string, mark long, blocks array<struct<no int, hash long, size int>>")
    single = looked.dropDuplicates(["host", "mark"])
    single = scratch.save(single, "blocks")
    pages_of = single.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    texts = single.select("host", F.inline("blocks")).groupBy("host", "no", "hash").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).join(pages_of, "host")
    constant = (F.col("n") >= F.greatest(F.lit(LEAST), F.col("pages") * CONSTANT))
    slots = texts.groupBy("host", "no").agg(F.sum(F.when(~constant, F.col("n") * F.col("size")).otherwise(0)).alias("varying"),
                                            F.collect_list(F.when(constant, F.col("hash"))).alias("template"))   # two per slot at most
    packed = slots.groupBy("host").agg(F.collect_list(F.struct("no", "varying", "template")).alias("slots"))     # as many as the wrapper has nodes
    wrappers = scratch.save(trees.join(packed, "host", "left"), "wrappers")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for b in batches:
            ids, urls, pages_, hosts, trees_ = (c for c in b.columns[:5])
            texts_ = []
            for k, (page, host, tree) in enumerate(zip(pages_.to_pylist(), hosts.to_pylist(), trees_.to_pylist())):
                wrapper = None
                if tree is not None:
                    if (host, tree) not in known:
                        if len(known) > 1000:
                            known.clear()
                        top, every = numbered(tree)
                        slots_ = b.column(5)[k].as_py() or []
                        slot = content_slot(every, {s["no"]: s["varying"] for s in slots_})
                        known[host, tree] = (top, slot, {(s["no"], h) for s in slots_ for h in s["template"]}, every[slot].tag in ("#", "html", "body"))
                    wrapper = known[host, tree]
                texts_.append(extract(page, wrapper) if page else "")
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts_, pa.string())], ["id", "url", "text"])

    kind = src.schema["id"].dataType.simpleString()
    return src.join(wrappers, "host", "left").select("id", "url", "html", "host", "tree", "slots").mapInArrow(read, f"id {kind}, url string, text string")


@query("op5_wrapper_induction")
def op5_wrapper_induction(spark, sf):
    """One row per page: its main text and the number of its code points."""
    out = extracted(table(spark, sf, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
