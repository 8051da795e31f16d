"""Operators against brute force, literal cases and round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import senses, text
from lexiloom.operators import boxes, images, joins, lexicon, stats
from lexiloom.sources import projects


@given(st.text(max_size=60))
def test_normaliser_places_rise(s):
    norm, places = text.normalise_with_map(s)
    assert len(norm) == len(places) and places == sorted(places) and all(0 <= p < len(s) for p in places)


@given(st.text(alphabet="<>abc ", max_size=40))
def test_strip_with_map_agrees(s):
    plain, places = text.strip_tags_with_map(s)
    assert [s[p] for p in places] == list(plain)


def test_text_literals(spark):
    df = spark.createDataFrame([("Pĕraccommŏdātus", "ab-\n  cd e\nf", "Opaßſig ỳ")], "a string, b string, c string")
    row = df.select(text.fold(F.col("a")), text.clean_ocr_text(F.col("b")), text.legacy_orthography(F.col("c"))).first()
    assert tuple(row) == ("peraccommodatus", "abcd e f", "Opassig y̆")
    assert text.normalise_with_map("æſß")[0] == "aesss"


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(["1", "2", "3", "a", "b", "c", "I", "II", "α", "β", "A", "B", "aa", "bb", "i", "iv"]), max_size=6))
def test_marker_kinds_agree_on_lists(markers):
    kinds = [lexicon.marker_kind(m) for m in markers]
    assert all(k[0] in senses.LEVELS for k in kinds)


def test_sequences_equal_the_plain_stack(spark):
    rng = np.random.default_rng(3)
    pool = ["1.", "2.", "3.", "a.", "b.", "c.", "I.", "II.", "α", "β", "A.", "B.", "aa.", "bb.", "ii", "x?"]
    rows = [(i, [pool[j] for j in rng.integers(0, len(pool), rng.integers(0, 6))]) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, m array<string>").select("i", senses.sequence_valid(F.col("m")).alias("ok")).collect()
    want = {i: lexicon._marker_valid([lexicon.marker_kind(m) for m in ms]) for i, ms in rows}
    assert {r.i: r.ok for r in got} == want


def test_reference_scores(spark):
    cases = [("<orth>Abdo</orth> <span>se</span> Do.", 65), ("<orth>Foo…</orth> x", 75), ("<orth><u>Adeo</u></orth> se Eo.", 30), ("<orth><b>Accessio</b></orth>, <span>tillökning i allmänhet</span> C.", -15)]
    got = lexicon.score_references(spark.createDataFrame([(c,) for c, _ in cases], "content string")).collect()
    assert {r.content: r.score for r in got} == dict(cases)


def test_paragraph_split():
    assert lexicon.split_paragraph("<orth>A</orth> x<br/>\n1. y<br/>\n2. z<br/>\n<orth>B</orth> w<br/>\n1. v") == ["<orth>A</orth> x<br/>\n1. y<br/>\n2. z", "<orth>B</orth> w<br/>\n1. v"]
    assert lexicon.split_paragraph("<orth>A</orth><br/>\n2. y") == ["!!!<orth>A</orth><br/>\n2. y"]


def test_breaks(spark):
    rows = [("och", True), ("x:", True), ("(a)", True), ("(a).", False), ("hus", False), ("=", True), ("pl.", True), ("4.", True)]
    df = spark.createDataFrame([(w,) for w, _ in rows], "w string")
    assert [r[0] for r in df.select(lexicon.joins_next(F.col("w"), F.lit(""))).collect()] == [x for _, x in rows]


def test_asof_equals_search(spark):
    rng = np.random.default_rng(5)
    marks, spots = np.unique(rng.integers(0, 1000, 60)), rng.integers(0, 1100, 300)
    left = spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(spots)], "i int, g int, x long")
    right = spark.createDataFrame([(1, int(x), f"m{x}") for x in marks], "g int, x long, name string")
    for forward in (False, True):
        got = {r.i: r.x_found for r in joins.asof(left, right, "g", "x", ["name"], forward).collect()}
        for i, x in enumerate(spots):
            k = np.searchsorted(marks, x, "left" if forward else "right") - (not forward)
            assert got[i] == (int(marks[k]) if 0 <= k < len(marks) else None)


def test_alias_roots_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "src string, dst string")
    assert {r.src: r.root for r in joins.alias_roots(edges).collect()} == {"a": "c", "b": "c", "d": "c", "x": None, "y": None, "z": None}


def test_dbscan_1d_literals(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (0, 9, 18, 40)], "g int, v double")
    assert [r.cluster for r in boxes.dbscan_1d(df, ["g"], "v", 10).orderBy("v").collect()] == [1, 1, 1, 0]
    apart = spark.createDataFrame([(1, 0.0), (1, 10.0)], "g int, v double")
    assert {r.cluster for r in boxes.dbscan_1d(apart, ["g"], "v", 10).collect()} == {0}


def test_quantiles(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "g int, v double")
    assert stats.quantile_upper(df, ["g"], "v", 0.5).first().q == 3 and stats.quantile_lower(df, ["g"], "v", 0.5).first().q == 2


def test_split_and_merge(spark):
    df = spark.createDataFrame([(1, "fi", 10, 30, 0, 5), (2, "x", 40, 50, 0, 5)], "box_no long, chr string, l long, r long, t long, b long")
    parts = boxes.split_boxes(df).orderBy("box_no", "part").collect()
    assert [(p.chr, p.l, p.r) for p in parts] == [("f", 10, 20), ("i", 20, 30), ("x", 40, 45), ("??", 45, 50)]


def test_style_path_is_least(spark):
    import itertools

    rng = np.random.default_rng(2)
    rows = [(g, i, [int(x) for x in rng.integers(0, 16, 3)]) for g in range(8) for i in range(5)]
    got = {r.g: r.cost for r in boxes.style_paths(spark.createDataFrame(rows, "g int, i int, o array<int>"), "g", "i", "o").collect()}
    for g in range(8):
        options = [r[2] for r in rows if r[0] == g]
        assert got[g] == min(sum((a ^ b).bit_count() for a, b in zip(p, p[1:])) for p in itertools.product(*options))


def test_segments_equal_flood():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = (rng.random((9, 11)) < 0.4).astype(float)
        labels, seen = images.label_components(a, 0.5), np.zeros(a.shape, int)
        n = 0
        for y, x in zip(*np.nonzero(a), strict=True):
            if not seen[y, x]:
                n += 1
                stack = [(y, x)]
                while stack:
                    v, u = stack.pop()
                    if 0 <= v < 9 and 0 <= u < 11 and a[v, u] and not seen[v, u]:
                        seen[v, u] = n
                        stack += [(v + i, u + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (labels == seen).all()


def test_correlation_equals_sum():
    rng = np.random.default_rng(1)
    page, glyph = rng.random((12, 10)), rng.random((3, 4))
    c = images.correlate(page, glyph)
    for y in range(c.shape[0]):
        for x in range(c.shape[1]):
            want = ((2 * glyph - 1) * page[y : y + 3, x : x + 4]).sum() / np.maximum(0, 2 * glyph - 1).sum()
            assert c[y, x] == pytest.approx(want)
    assert images.correlate(np.array([[0.0, 1.0]]), np.array([[1.0]])).argmax() == 1


def test_least_squares(spark):
    rows = spark.createDataFrame([("e1", "a", 1.0, 3.0, 1.0), ("e1", "b", 1.0, 3.0, 1.0), ("e2", "a", 1.0, 1.0, 2.0)], "eq string, u string, v double, t double, w double")
    got = {r.u: r.x for r in stats.least_squares(rows, "eq", "u", "v", "t", "w").collect()}
    assert got["a"] == pytest.approx(1) and got["b"] == pytest.approx(2)


def test_project_round_trip(spark, tmp_path):
    xml = '<project><page path="p1.png" active="1">\n<rtml>Ab &lt;</rtml>\n<box c="A" s="1" l="1" r="2" t="3" b="4"/>\n<box char="&lt;" style="0" var="2" deg="1" corr="50" left="5" right="6" top="7" bot="8"/>\n</page></project>'
    (tmp_path / "a.xml").write_text(xml)
    pages, found = projects.read_project(spark, str(tmp_path / "a.xml"))
    rows = found.orderBy("box_no").drop("path").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "A", 1, 0, False, 0, 1, 2, 3, 4), (0, 1, "<", 0, 2, True, 50, 5, 6, 7, 8)]
    out = projects.page_xml(pages, found).first().value
    (tmp_path / "b.xml").write_text(out)
    again = projects.read_project(spark, str(tmp_path / "b.xml"))[1]
    assert [tuple(r) for r in again.orderBy("box_no").drop("path").collect()] == [tuple(r) for r in rows]


def test_box_file_round_trip(spark, tmp_path):
    (tmp_path / "a.box").write_text("A 10 80 20 90 0\nB 50 80 60 90 0\nbroken\nC 5 60 15 70 0\n")
    rows, bad = projects.read_box_file(spark, str(tmp_path / "a.box"), 100)
    got = rows.orderBy("box_no").collect()
    assert [r.chr for r in got] == ["A", "B", "\\n", "C"] and (got[0].t, got[0].b) == (10, 20) and bad.count() == 1
    lines = [r.value for r in projects.box_file_lines(rows, 100).orderBy("box_no").collect()]
    assert lines == ["A 10 80 20 90", "B 50 80 60 90", "C 5 60 15 70"]


def test_office(spark, tmp_path):
    ns = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in (("office", "office"), ("text", "text"), ("style", "style"), ("fo", "xsl-fo-compatible")))
    xml = f'<office:document {ns}><office:automatic-styles><style:style style:name="T1"><style:text-properties fo:font-weight="bold"/></style:style></office:automatic-styles><office:body><office:text><text:p><text:span text:style-name="T1">Ab</text:span>, x<text:line-break/>y<text:s text:c="2"/>z</text:p></office:text></office:body></office:document>'
    (tmp_path / "a.fodt").write_text(xml)
    assert projects.read_office(spark, str(tmp_path / "*.fodt")).first().html == "<b>Ab</b>, x<br/>\ny  z"
    assert projects.stitch("ab-", "cd") == (["abcd"], 6) and projects.stitch("ab", "<b>C</b>") == (["ab", "<b>C</b>"], 4)


def test_images(spark, tmp_path):
    ink = np.array([[0.0, 1.0], [1.0, 0.0]])
    (tmp_path / "a.pgm").write_bytes(projects.encode_pgm(ink))
    row = projects.read_images(spark, str(tmp_path / "a.pgm")).first()
    assert (row.width, row.height) == (2, 2) and row.px == [0.0, 1.0, 1.0, 0.0]
    assert projects.encode_png(ink)[:8] == b"\x89PNG\r\n\x1a\n"
    assert images.shelf_pack([("a", 900, 20), ("b", 600, 30), ("c", 100, 5)]) == [("a", 0, 0), ("b", 0, 30), ("c", 610, 30)]


def test_streaming_equals_batch(spark, tmp_path):
    from lexiloom.session import table
    from lexiloom.streaming import pages

    batch = table(spark, "/root/testdata/sf0.001", "pages")
    batch.write.parquet(str(tmp_path / "in"))
    stream = pages.stream_paragraphs(pages.read_stream(spark, str(tmp_path / "in"), batch.schema))
    q = stream.writeStream.format("memory").queryName("paras").start()
    q.processAllAvailable()
    q.stop()
    want = pages.stream_paragraphs(batch)
    assert spark.table("paras").exceptAll(want).count() == 0 and spark.table("paras").count() == want.count()
