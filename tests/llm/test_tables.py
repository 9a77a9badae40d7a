"""Operators on embeddings, pages and conversations against brute force."""

import base64
import hashlib
import io
import struct
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from slidemesh.llm import embedding_neardup, html_wrapper, quotes, warc_zip


@pytest.mark.parametrize("kind,tile", [("float", None), ("double", 40)])
def test_embedding_groups(spark, kind, tile):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    vectors = [c + rng.normal(scale=s, size=16) for c in centers for s in (0.01, 0.15, 0.25, 0.35)] + [centers[0]] * 25 + [3 * centers[0], -centers[1]]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [float("inf")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, []), (906, rows[0][1][:8]), (None, rows[0][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], f"vec_id long, embedding array<{kind}>, id string, node long")
    every = rows + [odd[6], odd[7], odd[8]]
    n = len(every)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = np.array(every[i][1]), np.array(every[j][1])
            near[i, j] = i != j and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(1))
        if (new == label).all():
            break
        label = new
    ids = {}
    for k, (i, _) in zip(label, every):
        ids.setdefault(k, []).append(i)
    comp = [min((x for x in ids[k] if x is not None), default=None) for k in label]
    want = Counter((every[i][0], int(near[i].sum()), comp[i], every[i][0] is not None and every[i][0] == comp[i]) for i in range(n)) + Counter((i, 0, i, True) for i in range(900, 906))
    assert Counter((r.id, r.n_links, r.component_id, r.kept) for r in embedding_neardup.embedding_groups(df, 0.9, tile_rows=tile).collect()) == want
    assert embedding_neardup.embedding_groups(df.limit(0)).count() == 0


def page(title, paras, nav="Home", note="Alle Rechte", extra=""):
    body = "".join(f"<p>{p}" for p in paras)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='<p>no</p>';</script><style>p{{}}</style></head><body class='x'><header>Site</header>"
            f"<nav><ul><li><a href=/>{nav}</a></ul></nav><div id=wrap><div class=lead>Welcome to the site</div><div class='text'><h1>{title}</h1>{body}</div>{extra}</div><footer>{note}</footer>")


def test_wrapper_induction(spark):
    rows, want = [], {}
    for k in range(12):
        paras = [f"First &amp; <b>bold</b><br>line {k}", f"Second {k * 7} é &eacute;"]
        rows.append((k, f"https://user@host.example:80/{k}", page(f"Title {k}", paras, extra="<div class='comments'><p>nice</p></div><aside>more</aside><form><p>join</p></form><div class=ad>buy</div>")))
        want[k] = f"Title {k}\n\nFirst & bold line {k}\n\nSecond {k * 7} é é"
    same = page("Same", ["One text"])
    rows += [(100 + k, "http://copies.example/a", same) for k in range(9)]
    want |= {100 + k: "Welcome to the site\n\nSame\n\nOne text" for k in range(9)}
    rows += [(200, None, "<article>a<p>b</article>c"), (201, "not a url", None), (202, "", ""), (203, "http://solo.example", "plain < text &am"), (204, "http://deep.example", "<div>" * 5000 + "deep" + "</div>" * 5000),
             (205, "http://cut.example", "<p>good<!-- never closed <p>x"), (206, "http://big.example", "<body>" + "<p>row</p>" * 20_000), (None, "http://solo.example", "<p>x"), (200, None, "<main><p>q</main>")]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, tree string")
    out = html_wrapper.extracted(df).collect()
    assert len(out) == len(rows) and Counter((r.id, r.url) for r in out) == Counter((i, u) for i, u, _ in rows)
    got = {r.id: r.text for r in out}
    assert {k: got[k] for k in want} == want
    assert got[201] == got[202] == "" and got[203] == "plain < text &am" and got[204] == "deep" and got[205] == "good" and got[206].count("row") == 20_000 and got[None] == "x"
    assert sorted(r.text for r in out if r.id == 200) == ["a\n\nb", "q"]
    assert html_wrapper.extracted(df.limit(0)).count() == 0


def test_simple_tree_matching_counts_pairs():
    a, b = (html_wrapper.runs(html_wrapper.parse(x))[0] for x in ("<div><h1>a</h1><p>b</p><ul><li>c</ul></div>", "<div><p>b</p><table></table><ul><li>c<li>d</ul></div>"))
    score, pairs = html_wrapper.matched(a, b)
    assert score == 5 and [x.tag for x, _ in pairs] == ["div", "ul", "li", "p"] or sorted(x.tag for x, _ in pairs) == ["div", "li", "p", "ul"]


def test_quotes(spark):
    first, second = "Where shall we meet tomorrow, all of us together?", "At the station, at nine in the morning sharp.\nBring the maps and the long rope."
    rows = [(1, 0, "u", first), (1, 1, "a", f"{second}\n\nOn Monday somebody wrote:\n> {first}"),
            (1, 2, "u", "Fine.\n> At the station, at nine in the morning sharp.\n> Bring the maps and the long rope.\n>> " + first + "\n\nSee you."),
            (1, 3, "a", "> Bring the maps and the long rope.\nWhich maps?"), (1, 4, "u", "> nobody ever said this sentence before\nwhat?"), (2, 5, "u", f"> {first}\nseen elsewhere"), (2, 0, "u", f"> {first}\ntoo early"),
            (3, 0, "u", None), (3, 1, "a", ""), (3, 2, "u", ">\n> \nblank quote"), (None, 1, "u", f"> {first}\nno conversation"), (4, None, "u", "no turn"), (5, 1, "u", "twice\r\n> x"), (5, 1, "u", "twice\r\n> x"),
            (6, 0, "u", "\n".join(f"line {k} of a very long message" for k in range(3000)))]
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], "conv_id long, turn long, role string, text string, conv string, body int")
    out = quotes.linked(df).collect()
    assert len(out) == len(rows) and quotes.linked(df).columns[:5] == ["conv_id", "turn", "role", "conv", "body"]
    raw = [r.asDict() if False else tuple(r) for r in out]
    by = {(r[0], r[1]): r[5:] for r in raw}
    assert by[1, 0] == (first, 0, 0, None, None, 1, 0, 0)
    assert by[1, 1] == (second, 1, 1, 1, 0, 1, 0, 1)
    assert by[1, 2] == ("Fine.\n\nSee you.", 2, 2, 1, 1, 1, 0, 2)
    assert by[1, 3] == ("Which maps?", 1, 1, 1, 1, 1, 0, 2)
    assert by[1, 4] == ("what?", 1, 0, None, None, 1, 4, 0)
    assert by[2, 5] == ("seen elsewhere", 1, 1, 1, 0, 1, 0, 1) and by[2, 0][1:5] == (1, 0, None, None)
    assert by[3, 0][0] == by[3, 1][0] == "" and by[3, 2] == ("blank quote", 0, 0, None, None, 3, 2, 0)
    assert by[None, 1] == ("no conversation", 0, 0, None, None, None, 1, 0) and by[4, None][0] == "no turn" and by[5, 1][0] == "twice"
    assert by[6, 0][0].count("\n") == 2999
    assert quotes.linked(df.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    rows = [(3, "http://a/1", "same ü"), (1, "http://a/2", "same ü"), (2, None, "same ü"), (4, "http://a/\r\n3", None), (5, "u", ""), (6, "u", "x" * 200_000), (None, "u", "same ü"), (7, "u", "a\r\n\r\nb"), (7, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*r, "m") for r in rows], "page_id long, url string, html string, mark string").repartition(3)
    out = warc_zip.archived(df, str(tmp_path / "a")).collect()
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    want = Counter()
    for payload, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            again = i != first
            want[i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    assert Counter(tuple(r) for r in out) == want
    assert warc_zip.archived(df.limit(0), str(tmp_path / "b")).count() == 0
    small = warc_zip.archived(df, str(tmp_path / "c"), min_bytes=7).collect()
    assert {r.record_type for r in small if r.payload_bytes < 7} == {"response"} and sum(r.record_type == "revisit" for r in small) == 3


def test_zip_directory_with_zip64():
    """A package whose directory needs ZIP64 fields, against the library's reader."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for k in range(3):
            with z.open(zipfile.ZipInfo(f"m{k}"), "w", force_zip64=True) as f:
                f.write(bytes([k]) * (k + 5))
    data = raw.getvalue()
    end = data.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack_from("<HII", data, end + 10)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    data = data[:end] + wide + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"
    f = pa.PythonFile(io.BytesIO(data), "r")
    found = warc_zip.members(f, len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name, (method, offset, size) in found.items():
            assert method == 0 and f.read_at(size, warc_zip.data_start(f, offset)) == z.read(name)
    with pytest.raises(ValueError):
        warc_zip.members(pa.PythonFile(io.BytesIO(b"no archive"), "r"), 10)
