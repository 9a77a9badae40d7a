"""Readers, writers, text and colour functions, streams against their batch twins."""

import json
import re
import struct
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from slidemesh.functions import color, masks, pixels, routing, text
from slidemesh.operators import graph, layout, ocr, usage
from slidemesh.sources import coco, runs
from slidemesh.streaming import rounds
from slidemesh.streaming import usage as usage_stream


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def write_run(tmp, slide, comps):
    d = tmp / slide / "final"
    d.mkdir(parents=True)
    (d / "metadata.json").write_text(json.dumps({"image": f"{slide}.png", "num_components": len(comps), "final_components": comps}))


def test_run_directory_to_graph(spark, tmp_path):
    write_run(tmp_path, "s1", [
        {"filename": "a.png", "text_type": "photo", "bbox_xyxy": [0, 0, 100, 100], "z_index": 1, "merged_from": ["b.png", "c.png"]},
        {"filename": "b.png", "text_type": "label", "bbox_xyxy": [10, 10, 30, 30], "z_index": 0},
        {"filename": "c.png", "bbox_xyxy": [200, 0, 240, 20]}])
    (tmp_path / "notes").mkdir()
    nodes = runs.component_nodes(runs.read_manifests(spark, str(tmp_path)))
    assert [r.node_id for r in nodes.orderBy("pos").collect()] == ["s1/c000", "s1/c001", "s1/c002"]
    edges = graph.derive_edges(nodes)
    got = sorted((r.kind, r.src[-4:], r.dst[-4:]) for r in edges.collect())
    assert got == [("above", "c000", "c001"), ("contains", "c000", "c001"), ("merged_with", "c000", "c001"), ("merged_with", "c000", "c002"),
                   ("reads_before", "c000", "c002"), ("reads_before", "c002", "c001")]
    runs.write_graph(nodes, edges, str(tmp_path / "out"))
    n2, e2 = runs.read_graph(spark, str(tmp_path / "out"))
    assert n2.count() == 3 and e2.count() == len(got)
    back, _ = runs.unnest_graph(runs.nested_graph(nodes, edges))
    assert back.count() == 3


def test_empty_run_is_an_error(spark, tmp_path):
    (tmp_path / "x" / "final").mkdir(parents=True)
    with pytest.raises(Exception):
        runs.read_manifests(spark, str(tmp_path))


def test_native_shapes_understand_pixel_positions(spark, tmp_path):
    (tmp_path / "s1_components.json").write_text(json.dumps({
        "slide_info": {"dimensions_pixels": {"width": 200, "height": 100}},
        "components": [{"type": "AUTO", "text": "t", "position_pixels": {"left": 20, "top": 10, "width": 40, "height": 20, "right": 60, "bottom": 30}}, {"shape_type": "pic", "bbox": [1, 2, 3, 4]}]}))
    raw = spark.read.schema(runs.SHAPES).option("multiLine", True).json(str(tmp_path)).withColumn("slide_id", F.lit("s1"))
    size = spark.createDataFrame([("s1", 100, 50)], "slide_id string, width int, height int")
    r = runs.object_nodes(raw, size).orderBy("pos").collect()
    assert (r[0].x0, r[0].y0, r[0].x1, r[0].y1, r[0].shape_type) == (10, 5, 30, 15, "AUTO")
    assert (r[1].object_id, r[1].x1) == ("s1/o001", 1.5)


def test_group_flattening(spark):
    rows = [("s", 1, None, True, 0., 0., 9., 9., 0.), ("s", 2, 1, True, 0., 0., 9., 9., 0.), ("s", 3, 2, False, 10., 10., 40., 2., 0.), ("s", 4, None, False, 0., 0., 0., 0., 0.)]
    df = spark.createDataFrame(rows, "slide_id string, shape_id int, parent_id int, is_group boolean, x double, y double, w double, h double, angle double")
    r = runs.flatten_groups(df).collect()
    assert [(x.shape_id, x.root_id, x.y1) for x in r] == [(3, 1, 18.0)]


def test_deep_groups_and_cycles(spark):
    rows = [("s", k, k - 1 if k > 1 else None, True, 0., 0., 9., 9., 0.) for k in range(1, 12)] + [("s", 50, 11, False, 1., 1., 9., 9., 0.), ("s", 51, 77, False, 1., 1., 9., 9., 0.), ("s", 52, None, False, 1., 1., 9., 9., 0.)]
    schema = "slide_id string, shape_id int, parent_id int, is_group boolean, x double, y double, w double, h double, angle double"
    assert {r.shape_id: r.root_id for r in runs.flatten_groups(spark.createDataFrame(rows, schema)).collect()} == {50: 1, 51: 77, 52: None}
    ring = [("s", 1, 2, True, 0., 0., 9., 9., 0.), ("s", 2, 3, True, 0., 0., 9., 9., 0.), ("s", 3, 1, True, 0., 0., 9., 9., 0.)]
    with pytest.raises(ValueError):
        runs.flatten_groups(spark.createDataFrame(ring, schema))


def test_pending_reads_or_raises(spark, tmp_path):
    work = spark.createDataFrame([(1,), (2,)], "k int")
    assert runs.pending(work, spark, str(tmp_path / "none"), ["k"]).count() == 2
    spark.createDataFrame([(1,)], "k int").write.parquet(str(tmp_path / "some"))
    assert [r.k for r in runs.pending(work, spark, str(tmp_path / "some"), ["k"]).collect()] == [2]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        runs.pending(work, spark, str(tmp_path / "bad"), ["k"]).collect()


LOG = [{"marker": "slide_start", "image": "a", "ts": 1.0}, {"backend": "b", "agent": "x", "input_tokens": 3, "output_tokens": 1, "latency_sec": 0.5, "ts": 2.0},
       {"marker": "slide_start", "image": "c", "ts": 3.0}, {"marker": "slide_end", "image": "a", "wall_clock_sec": 9.0, "ts": 4.0},
       {"backend": "b", "agent": "x", "input_tokens": 5, "output_tokens": 1, "latency_sec": 0.5, "ts": 5.0}, {"marker": "slide_end", "image": "c", "wall_clock_sec": 2.0, "ts": 6.0},
       {"backend": "b", "input_tokens": 7, "output_tokens": 1, "latency_sec": 0.5, "ts": 7.0}]


def test_usage_log(spark, tmp_path):
    f = tmp_path / "log.jsonl"
    f.write_text("\n".join([*map(json.dumps, LOG), "not json", ""]))
    log = runs.read_usage(spark, str(f)).withColumn("ts", F.col("event_time"))
    att = usage.attribute_to_slides(log, ["run"])
    assert [r.open_image for r in att.where("marker is null").orderBy("line_no").collect()] == ["a", "c", None]
    per = {r.image: r for r in usage.per_slide(att).collect()}
    assert (per["a"].calls, per["a"].input_tokens, per["a"].wall_clock_sec, per["a"].agents) == (1, 3, 9.0, {"x": 1})
    assert per["c"].input_tokens == 5
    t = usage.totals(usage.per_slide(att)).first()
    assert (t.slides_completed, t.mean_wall_clock_sec_per_slide) == (2, 5.5)
    assert {r.agent: r.calls for r in usage.per_agent(log).collect()} == {"x": 2, "unknown": 1}
    assert runs.write_usage(log.drop("event_time"), str(tmp_path / "copy"))


def stream(df, path):
    df.coalesce(1).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def run_stream(out, name, tmp_path):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out.sparkSession.table(name).collect()


def test_usage_stream_equals_batch(spark, tmp_path):
    rows = [("r", i, x.get("marker"), x.get("image"), x.get("agent"), x.get("input_tokens", 0), 0, 0) for i, x in enumerate(LOG)]
    log = spark.createDataFrame(rows, "run string, line_no long, marker string, image string, agent string, input_tokens long, output_tokens long, latency_ms long")
    got = run_stream(usage_stream.attribute_stream(stream(log, str(tmp_path / "in"))), "att", tmp_path)
    want = usage.attribute_to_slides(log, ["run"]).where("marker is null").collect()
    assert sorted((r.line_no, str(r.open_image)) for r in got) == sorted((r.line_no, str(r.open_image)) for r in want)


def test_windows_stream(spark, tmp_path):
    log = spark.createDataFrame([("x", 1, 60 * i, None) for i in range(30)], "agent string, input_tokens long, s long, marker string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows = run_stream(usage_stream.windowed(stream(log, str(tmp_path / "in")), "5 minutes", late="0 seconds"), "win", tmp_path)
    assert sum(r.calls for r in rows) >= 20 and all(r.calls == 5 for r in rows)


def test_ingest_replaces_slides(spark, tmp_path):
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "slide_id string, pos int")
    src = stream(first, str(tmp_path / "in"))
    for k, more in enumerate([None, [("a", 9), ("c", 1)]]):
        if more:
            spark.createDataFrame(more, first.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        usage_stream.ingest_slides(src, spark, str(tmp_path / "table"), str(tmp_path / "ck"), 3).awaitTermination()
    assert sorted((r.slide_id, r.pos) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [("a", 9), ("b", 1), ("c", 1)]


def test_rounds(spark):
    slides = spark.createDataFrame([("a",), ("b",), ("c",)], "slide_id string")
    detect = lambda live, k: live.where("slide_id <> 'c' or 0 = 1") if k else live
    review = lambda comps, k: comps.select("slide_id", (F.col("slide_id") != "b").alias("needs_rerun"))
    out = rounds.run_rounds(slides, detect, review).collect()
    assert sorted((r.slide_id, r.iter_idx) for r in out) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)]


def test_coco_set(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"images": [{"id": 0, "width": 10, "height": 20}, {"id": 1, "width": 10, "height": 10}],
                                                 "annotations": [{"id": 0, "image_id": 0, "category_id": 0, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 0}], "categories": [{"id": 0, "name": "x"}]}))
    im, an, ca = coco.read_set(spark, str(tmp_path / "s.json"))
    assert sorted((r.id, len(r.annotations)) for r in coco.group_by_image(im, an).collect()) == [(0, 1), (1, 0)]
    i2, c2, a2 = coco.shift_to_one_based(im, ca, an)
    assert (a2.first().image_id, a2.first().category_id, c2.first().id, sorted(r.id for r in i2.collect())) == (1, 1, 1, [1, 2])
    preds = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0, 4.0], 0.5)], coco.PREDICTIONS)
    p = coco.load_results(preds, im).first()
    assert (p.x1, p.y1, p.area) == (4.0, 6.0, 12.0)
    with pytest.raises(ValueError):
        coco.load_results(preds.withColumn("image_id", F.lit(9)), im)
    assert coco.class_chunks(im, an, ca, 2).count() == 2
    assert coco.class_chunks(im, an, ca, 2, include_negatives=False).count() == 1


def test_video_frames(spark):
    t = spark.createDataFrame([(1, 7, [[0.0, 0.0, 2.0, 3.0], None, [0.0, 0.0, 0.0, 0.0]])], "video_id long, track_id long, bboxes array<array<double>>")
    assert coco.track_frames(t).count() == 1
    d = coco.dense_boxes(t).first()
    assert d.area == 6.0 and d.bboxes[1] == [0.0] * 4
    im = coco.frame_images(spark.createDataFrame([(1, ["f0", "f1", "f2"])], "id long, file_names array<string>"))
    assert [r.image_id for r in im.orderBy("image_id").collect()] == [1, 2, 3]
    assert coco.to_frame_annotations(t, im).first().image_id == 1
    with pytest.raises(ValueError):
        coco.to_frame_annotations(t, im.where("frame_idx > 0"))


def test_tracking_text_valid_filter(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1,a,0.5\n2,b,0.7\n3,c,0.9\n")
    conv = spark.createDataFrame([("cls", "a", "A")], "`column` string, source string, target string")
    df = coco.read_tracking_text(spark, str(tmp_path / "t.txt"), ["frame", "cls", "score"], valid={"cls": ["a", "b"]}, ignore={"frame": [2]}, convert=conv)
    assert [tuple(r) for r in df.collect()] == [("1", "A", "0.5")]


def latex_twin(s):
    for a, b in [("\\\\", "\n"), ("\\left", ""), ("\\right", ""), ("\\cdot", "*"), ("\\times", "*"), ("\\leq", "<="), ("\\infty", "infinity")]:
        s = s.replace(a, b)
    return s


def test_text_functions(spark):
    v = lambda c: one(spark, c)
    assert v(text.latex_to_text(F.lit(r"\textbf{Hi} $\frac{\frac{a}{b}}{c} \leq x^{2}_{i}$ \\ \begin{itemize}\item one \item[-] two\end{itemize} \foo{z}"))) == \
        "Hi ((a)/(b))/(c) <= x^(2)_i\n• one\n- two"
    assert latex_twin(r"a \times b") == v(text.latex_to_text(F.lit(r"a \times b")))
    assert v(text.filename_hint(F.lit("x/iter00_component_0001_logo_icon.png"))) == "logo icon"
    assert v(text.class_from_filename(F.lit("component_12_line_chart.png"))) == "line chart"
    assert v(text.safe_name(F.lit(" a/b c "))) == "a_b_c" and v(text.safe_name(F.lit("??"))) == "component"
    assert v(text.loose_json(F.lit('```json\n{"a": 1}\n```'), "a int")).a == 1
    assert v(text.loose_json(F.lit('so {"a": 2} ok'), "a int")).a == 2
    for raw, want in (('x {"a": 1} y {"b": 2}', {"a": 1}), ('{"a": "}{", "b": {"c": 3}} {"d"', {"a": "}{", "b": {"c": 3}}), (r'{"a": "q\"}"} }', {"a": 'q"}'}), (r'{"a": "\\"} {', {"a": "\\"}),
                      ('no {answer', None), ('{not json} {"a": 1}', None), ("", None), ('🙂 {"ü": "漢"} 🙂', {"ü": "漢"})):
        got = v(text.loose_object(F.lit(raw)))
        assert (got and json.loads(got)) == want, raw
    assert v(text.fuzzy_ratio(F.lit("controller"), F.lit("contraller"))) == pytest.approx(0.9)
    assert v(text.merged_params(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"), F.lit("b"), F.lit("8")), ["a"])) == {"a": "9", "b": "2"}
    assert v(text.scaled_font(F.lit(1200), F.lit(0.5))) == 1200 and v(text.scaled_font(F.lit(1200), F.lit(0.7))) == 1000
    assert v(text.ink_prior_pt(F.lit(119.0))) == pytest.approx(75.0)
    regs = F.from_json(F.lit('[{"text":"a","x":-1,"y":0.5,"w":9,"h":0.1},{"text":"b","x":0.2,"y":0.2,"w":0.1,"h":0.1},{"text":" "}]'), "array<struct<text:string,x:double,y:double,w:double,h:double>>")
    assert [r.w for r in v(text.split_regions(regs))] == [1.0, 0.1]


def test_colours(spark):
    for raw in ("#aBc", " #A1B2C3 ", "१२३४५६", "＃ＡＢＣＤＥＦ", "12345", "xyzxyz", None):
        t = None
        if raw is not None:
            t = "".join(str(d) if (d := unicodedata.digit(c, -1)) >= 0 else c for c in unicodedata.normalize("NFKC", raw).strip()).lstrip("#").upper()
            t = "".join(c * 2 for c in t) if len(t) == 3 else t
            t = t if re.fullmatch("[0-9A-F]{6}", t) else None
        assert one(spark, color.hex_norm(F.lit(raw).cast("string"))) == t, raw
    pal = F.from_json(F.lit('[{"hex":"111111","role":"accent"},{"hex":"#eee","role":"Base tone"}]'), "array<struct<hex:string,role:string>>")
    assert one(spark, color.background_of(pal)) == "EEEEEE" and one(spark, color.palette_default(pal)) == "111111"


def test_routing(spark):
    p = F.from_json(F.lit("{}"), "class string, semantic_role string, drop_safe boolean, shape_approximable boolean, raster_required boolean, protected_content boolean, route_confidence string, reason string")
    r = one(spark, routing.recovered(F.lit('"class": 4, "semantic_role": "Flow Diagram", "drop_safe": False, "route_confidence": "High", "reason": "x"'), p, F.lit("icon")))
    assert (r.cls, r.semantic_role, r.drop_safe, r.route_confidence, r.reason) == (4, "flow_diagram", False, "high", "x")
    r = one(spark, routing.recovered(F.lit("junk"), p, F.lit("slide title")))
    assert (r.cls, r.semantic_role) == (1, "text") and r.reason.startswith("classifier JSON")
    g = one(spark, routing.guarded_class(F.lit(0), F.lit("bar"), F.lit("safe_drop_decoration"), F.lit(True), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(False)))
    assert (g.cls, g.flags) == (0, [])


def test_fuzzy_lines(spark):
    import difflib
    lines = spark.createDataFrame([(1, 0, "Contraller unit"), (1, 1, "Totally different words"), (1, 2, "12345"), (1, 3, "abc"), (2, 0, "Controller unit")], "page long, pos long, text string")
    got = spark.createDataFrame([(1, "Controller unit"), (1, "abd"), (2, "nothing here")], "page long, text string")
    hay = spark.createDataFrame([(1, "controllerunitabd"), (2, "nothinghere")], "page long, hay string")
    want = []
    for p, i, t in ((r.page, r.pos, r.text) for r in lines.collect()):
        n = re.sub("[^a-z0-9]", "", t.lower())
        g = [re.sub("[^a-z0-9]", "", r.text.lower()) for r in got.where(f"page = {p}").collect()]
        if len(n) >= 3 and not n.isdigit() and n not in "".join(g) and not any(difflib.SequenceMatcher(None, n, x).ratio() >= 0.8 for x in g):
            want.append((p, i))
    assert sorted((r.page, r.pos) for r in ocr.missing_lines(lines, got, hay, ["page"]).collect()) == sorted(want)


def test_fuzzy_fold_matches_difflib(spark):
    import difflib
    import random
    r = random.Random(6)
    vocab = list({"".join(r.choice("abcde") for _ in range(r.randrange(2, 9))) for _ in range(60)})
    other = list({w[:-1] + r.choice("abcde") for w in vocab} - set(vocab))
    df = spark.createDataFrame([(1, w, "orig") for w in vocab] + [(1, w, "render") for w in other], "page long, word string, side string")
    want = 0
    for w in other:
        best = difflib.get_close_matches(w, vocab, n=1, cutoff=0.85)
        want += bool(best)
    assert sum(x.n_folded for x in ocr.fold_words(df).collect()) == want


def test_masks(spark):
    import numpy as np
    m = np.zeros((6, 8), bool)
    m[1:4, 2:5] = True
    m[2, 6] = True
    flat = m.T.reshape(-1)
    counts, cur, n = [], False, 0
    for v in flat:
        if v != cur:
            counts.append(n)
            cur, n = v, 0
        n += 1
    counts.append(n)
    c = F.array(*[F.lit(int(x)) for x in counts])
    assert one(spark, masks.rle_area(c)) == 10
    assert tuple(one(spark, masks.rle_box(c, F.lit(6)))) == (2, 1, 7, 4)
    assert one(spark, masks.boundary_f(c, c, F.lit(6), F.lit(8))) == 1.0
    assert (masks.boundary(m).sum(), masks.dilate(m, 1)[0, 2]) == (9, True)


def png(path, img):
    h, w, c = img.shape
    raw = b"".join(b"\0" + img[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pixels(spark, tmp_path):
    import numpy as np
    img = np.full((40, 60, 3), 255, np.uint8)
    img[10:20, 20:40] = (200, 10, 10)
    png(tmp_path / "a.png", img)
    df = spark.read.format("image").load(str(tmp_path)).select("image.*")
    a = [F.col(k) for k in ("data", "height", "width", "nChannels")]
    whole = F.array(*[F.lit(v) for v in (0.0, 0.0, 60.0, 40.0)])
    r = df.select(pixels.content_runs(*a).alias("runs"), pixels.white_ratio(*a, whole).alias("white"), pixels.ink_colour(*a, F.array(*[F.lit(v) for v in (10.0, 5.0, 50.0, 30.0)])).alias("ink"),
                  pixels.ink_box(*a, F.array(*[F.lit(v) for v in (18.0, 8.0, 44.0, 24.0)]), F.lit(0), F.lit(2)).alias("box"),
                  pixels.mean_rgb(*a, F.array(*[F.lit(v) for v in (20.0, 10.0, 40.0, 20.0)]), F.lit(6)).alias("mean"),
                  pixels.image_difference("data", "data", "height", "width", "nChannels").alias("d")).first()
    assert len(r.runs) == 10 and tuple(r.runs[0]) == (10, 20, 40)
    assert r.white == pytest.approx(1 - 200 / 2400) and r.ink == [200, 10, 10] and r.mean == [200, 10, 10]
    assert r.box == [18.0, 8.0, 42.0, 22.0] and r.d.mse == 0 and r.d.ssim == pytest.approx(1.0)
    assert one(spark, pixels.psnr(F.lit(0.0))) == 99.0


def test_merge_proposals(spark):
    p = spark.createDataFrame([(["a", "b"], "chart", ["0", "0", "5", "5"]), (["a"], "x", ["0", "0", "1", "1"]), (["a", "b"], " ", ["0", "0", "1", "1"]), (["a", "b"], "x", ["0", "z", "1", "1"])],
                              "member_filenames array<string>, merged_class string, merged_bbox array<string>")
    assert layout.valid_proposals(p).count() == 1
    assert one(spark, layout.chart_exempt(F.lit("Line Chart"))) and not one(spark, layout.chart_exempt(F.lit("flow chart")))
    assert one(spark, layout.is_text_prone(F.lit(" Bullet List "))) and not one(spark, layout.is_text_prone(F.lit("photo")))


def test_written_sets_split_into_bounded_files(spark, monkeypatch, tmp_path):
    """Files of a set hold a bounded number of boxes however many there are, also those of one large image."""
    import glob
    import json
    import os

    from slidemesh.plans import source_queries as Q
    monkeypatch.setattr(Q, "FILE_ROWS", 50, raising=False)
    monkeypatch.setattr(Q, "_folder", lambda spark, name: str(tmp_path / name))
    li = spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) AS l_orderkey", "id % 50 AS l_partkey", "id % 9 AS l_suppkey", "int(id) AS l_linenumber", "double(id) AS l_quantity",
                                      "1.0D AS l_extendedprice", "'A' AS l_returnflag", "'F' AS l_linestatus")
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.image_id: r.n for r in Q.coco_set_read(spark, str(tmp_path)).collect()}
    assert len(got) == 2000 and got[7] == 2001 and sum(got.values()) == 4000
    sets = [json.load(open(p)) for p in glob.glob(str(tmp_path / "coco" / "part-*")) if os.path.getsize(p)]
    assert max(len(s.get("annotations", [])) for s in sets) <= 250
    assert sum(r.n for r in Q.coco_predictions_read(spark, str(tmp_path)).collect()) == 3200
    sizes = [len(json.load(open(p))) for p in glob.glob(str(tmp_path / "predictions" / "part-*")) if os.path.getsize(p)]
    assert max(sizes) <= 250 and sum(sizes) == 3200
