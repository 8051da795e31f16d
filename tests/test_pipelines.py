"""End-to-end plans on small made pages."""

import numpy as np
from pyspark.sql import functions as F

from lexiloom.functions import legacy, text
from lexiloom.operators import boxes, fonts, images
from lexiloom.plans import pipelines

A = np.array([[0, 1, 0], [1, 1, 1], [1, 0, 1]], float)
B = np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], float)
GLYPHS = [("a", A), ("b", B)]


def page(lines):
    out = np.zeros((6 * len(lines) + 2, 40))
    for y, line in enumerate(lines):
        for x, c in enumerate(line):
            if c != " ":
                out[6 * y + 1 : 6 * y + 4, 4 * x + 1 : 4 * x + 4] = dict(GLYPHS)[c]
    return out


def test_recognise_and_segment(spark):
    lines = ["ab ba", "bb a"]
    p = page(lines)
    df = spark.createDataFrame([(1, p.ravel().tolist())], "page_no long, px array<double>")
    got = pipelines.recognise(df, "page_no", "px", 40, GLYPHS, 0.99).orderBy("line_no", "l", F.desc("inserted")).collect()
    found = {n: "".join(r["chr"] for r in got if r["line_no"] == n) for n in (1, 2)}
    assert found == {1: "ab ba", 2: "bb a"}
    seg = pipelines.segment_page(df, "page_no", "px", 40).orderBy("box_no").collect()
    assert [s["line_no"] for s in seg] == [1] * 4 + [2] * 3 and (seg[0]["l"], seg[0]["r"], seg[0]["t"]) == (1, 3, 1)


def test_font_recovers_bearings(spark):
    rng = np.random.default_rng(0)
    right, left, width = {"a": 10, "b": 14, "c": 8}, {"a": 0, "b": 2, "c": 1}, {"a": 8, "b": 11, "c": 6}
    rows, no = [], 0
    for _ in range(40):
        x, last = 0, None
        for c in rng.choice(list("abc"), 8):
            x += right[last] + left[c] if last else 0
            no += 1
            rows.append((1, no, c, 0, 0, False, int(x), int(x + width[c])))
            last = c
        no += 1
        rows.append((1, no, boxes.NEWLINE, 0, 0, False, 0, 0))
    df = spark.createDataFrame(rows, "page_no int, box_no long, chr string, style int, var int, degenerate boolean, l int, r int")
    table, spaces = fonts.build_font(df)
    got = {r["class"].split("|")[1]: r for r in table.collect()}
    for x in "abc":
        assert abs(got[x]["lb"] - left[x]) < 1e-6 and abs(got[x]["rb"] - right[x]) < 1e-6 and got[x]["rdev"] < 1e-6
    assert spaces == (None, None, None)


def test_styles_nest():
    tags = {1: "b", 2: "i"}
    assert boxes.unnest_styles([("a", 1), ("b", 3), ("c", 2), ("d", 0)], tags) == "<b>a<i>b</i></b><i>c</i>d"


def test_edits(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0, 4, 0, 4), (1, 2, "b", 5, 9, 0, 4)], "page_no int, box_no long, chr string, l long, r long, t long, b long")
    new = spark.createDataFrame([(1, "x", 1, 2, 3, 4)], "page_no int, chr string, l long, r long, t long, b long")
    got = boxes.paste_after(rows, new, ["page_no"], "box_no", F.col("chr") == "a").orderBy("box_no").collect()
    assert "".join(r["chr"] for r in got) == "axb"
    glyphs = spark.createDataFrame([("a", 6, 2)], "chr string, w long, h long")
    moved = boxes.relocate(rows, glyphs, F.col("box_no") == 1, 100, 50, ["chr"]).where("helped").first()
    assert (moved["l"], moved["r"], moved["t"], moved["b"]) == (97, 103, 49, 51)
    other = rows.withColumn("chr", F.when(F.col("box_no") == 2, "z").otherwise(F.col("chr")))
    assert boxes.agreement(rows, other, ["page_no"], "box_no", "chr").first()["n"] == 1
    assert {r["box_no"]: r["old_no"] for r in boxes.resync(rows, other, "box_no", ["chr", "l"]).collect()} == {1: 1, 2: None}
    assert boxes.export_lines(rows).first()["text"] == "ab"


def test_displacement_and_features():
    p = page(["a b"])
    corr, x, y = fonts.displacement(p, B)
    assert (round(corr, 6), x, y) == (1.0, 9, 1)
    assert len(fonts.appearance(A, (3, 3))) == 3 + 19 * 19
    assert images.shelf_pack([("a", 5, 5)]) == [("a", 0, 0)]


def test_lexicon(spark):
    rows = [(0, 0, "<b>Abdo</b>, <span>gömma</span>,bort<br/>\n1. x<br/>\n2. y"), (0, 1, "Foo <span>se</span> Do.")]
    kept, scored = pipelines.build_lexicon(spark.createDataFrame(rows, "file_no int, para_no int, html string"), ["file_no", "para_no"])
    assert scored.count() == 2 and [r["para_no"] for r in kept.collect()] == [0]
    made = spark.createDataFrame([("Opaßſig ab-\ncd — e",)], "t string").select(legacy.compile_text(F.col("t")), legacy.positions_of(F.col("t"), " ")).first()
    assert made[0] == "<p>Opassig\nabcd<br/>e</p>" and made[1] == [7, 14, 16]


def test_nested_lists(spark):
    rows = spark.createDataFrame([(1, 1, "1.", "x"), (1, 2, "a.", "y"), (1, 3, "2.", "z")], "para long, no int, m string, body string")
    html = pipelines.nested_markup(rows.withColumnRenamed("m", "marker"), "para", "no", "marker", "body").first()["html"]
    assert html == '\n<ol class="sense-decimal"><li>1. x\n<ol class="sense-alpha"><li>a. y</li></ol></li>\n<li>2. z</li></ol>'


def test_alignment_is_kept(spark, tmp_path):
    a = spark.createDataFrame([("v", i, k) for i, k in enumerate("abcde")], "g string, no long, k string")
    b = spark.createDataFrame([("v", i, k) for i, k in enumerate("bxde")], "g string, no long, k string")
    for _ in range(2):
        got = pipelines.aligned_once(a, b, "g", "no", "k", f"file://{tmp_path}")
        assert sorted((r["left_no"], r["right_no"]) for r in got.collect()) == [(1, 0), (3, 2), (4, 3)]
    assert len(list(tmp_path.iterdir())) == 1


def test_legacy_rules(spark):
    """Each rule on a literal of its own; expected texts written from the rules' definition."""
    cases = [
        ("feet", "⏑ — ⏑ x", "⏑—⏑ x"), ("styles", "a -<sp>b c</sp>de- f", "a <sp>-b cde-</sp> f"), ("styles", "<i><b>a</b></i>\n<i><b>b</b></i>-\n<i><b>c</b></i>", "<i><b>a\nb-\nc</b></i>"),
        ("styles", "<s>a</s>, <s>b</s>", "<s>a, b</s>"), ("styles", "(<s>a</s>) b", "<s>(a)</s> b"), ("styles", "<s><b>a</b></s>, <s><b>b</b></s>", "<s><b>a, b</b></s>"),
        ("hyphens", "x ab-\ncd", "x\nabcd"), ("structure", "a\n\nb", "<p>a</p>\n\n<p>b</p>"), ("structure", "x I. y — II. z", "<p>x<br/>I. y<br/>II. z</p>"), ("structure", "<s>x</s> <sp>y</sp>", "<p><span>x</span><br/><u>y</u></p>"),
    ]
    parts = {"feet": text.metrical_join, "styles": legacy.repair_styles, "hyphens": legacy.dehyphenate, "structure": legacy.structure}
    for name, given, want in cases:
        got = spark.createDataFrame([(given,)], "t string").select(parts[name](F.col("t"))).first()[0]
        assert got == want, (name, given, got)


def test_headword_rules(spark):
    cases = [("x<br/>\nFoo y", "x<br/>\n<orth>Foo</orth> y"), ("x<br/>\nIV. y", "x<br/>\nIV. y"), ("x<br/>\nA. y", "x<br/>\nA. y"), ("x<br/>\nĀb. y", "x<br/>\n<orth>Āb.</orth> y"), ("x<br/>\nfoo", "x<br/>\nfoo"), ("x<br/>\nIV.<br/>\nFoo y", "x<br/>\nIV.<br/>\nFoo y")]
    got = spark.createDataFrame(cases, "t string, want string").select("want", text.mark_headwords(F.col("t")).alias("m")).collect()
    assert all(r["m"] == r["want"] for r in got), got
    row = spark.createDataFrame([("<orth>A<br/></orth> …", "IX", "B.", "Ab")], "t string, a string, b string, c string").select(text.tidy_headwords(F.col("t")), *[text.is_sense_number(F.col(c)) for c in "abc"]).first()
    assert tuple(row) == ("<orth>A</orth><br/> …", True, True, False)
