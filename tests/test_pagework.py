"""Page work on made pages, and the small tables of a project, against definitions and literals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import boxes, pagework, registry
from lexiloom.sources import projects

RNG = np.random.default_rng(7)
SHAPES = {c: (RNG.random((9, 7)) < 0.55).astype(float) for c in "abc"}
FONT = {(0, c, 0): pagework.Glyph((0, c, 0), px, 0.0, 9.0, 1.0, 1.0) for c, px in SHAPES.items()}
STEP = 9


def page(lines, dx=0, dy=0):
    ink, rows = np.zeros((30 * len(lines) + 20, 200)), []
    for k, line in enumerate(lines):
        for j, c in enumerate(line):
            x, y = 12 + STEP * j, 10 + 30 * k
            if c != " ":
                ink[y : y + 9, x : x + 7] = SHAPES[c]
            rows.append({"chr": c, "style": 0, "var": 0, "corr": 90, "degenerate": False, "l": x + dx, "r": x + dx + 7, "t": y + dy, "b": y + dy + 9})
        rows.append({"chr": boxes.NEWLINE, "style": 0, "var": 0, "corr": 0, "degenerate": False, "l": 0, "r": 0, "t": 0, "b": 0})
    return ink, rows


def test_sampling_and_rendering():
    ink = RNG.random((6, 8))
    for y in range(6):
        for x in range(8):
            assert pagework.sample(ink, x, y) == pytest.approx(ink[y, x])
    ramp = np.tile(np.arange(8) / 10, (8, 1))
    assert pagework.sample(ramp, 3.5, 4.25) == pytest.approx(0.35)
    assert pagework.crop_bottom(ink, 2).shape == (2, 8) and pagework.crop_bottom(ink, 99).shape == (6, 8)
    a, m = np.array([[0.0, 1.0, 1.0, 0.0]]), np.array([[0.0, 1.0, 0.0, 2.0]])
    assert pagework.render(a)[0].tolist() == [[255] * 3, [0] * 3, [0] * 3, [255] * 3]
    over = pagework.render(a, m)[0].tolist()
    assert over[0] == [255, 255, 255] and over[1] == [255, 255, 255] and over[2] == [0, 76, 0] and over[3] == [255, 0, 0]
    assert pagework.render(np.ones((4, 6)), zoom=2).shape == (2, 3, 3)


def test_fit_finds_shifts():
    for dx, dy in ((0, 0), (2, -1), (-3, 2)):
        area = np.zeros((30, 30))
        area[10 + dy : 19 + dy, 10 + dx : 17 + dx] = SHAPES["a"]
        corr, x, y = pagework.fit(SHAPES["a"], area, (0, 30, 0, 30))
        assert corr == pytest.approx(1) and (round(x), round(y)) == (10 + dx, 10 + dy)
    two = np.zeros((9, 40))
    two[:, 3:10], two[:, 25:32] = 0.8 * SHAPES["b"], SHAPES["b"]
    assert round(pagework.fit(SHAPES["b"], two, (0, 40, -2, 3))[1]) == 25 and round(pagework.fit(SHAPES["b"], two, (0, 40, -2, 3), 0.7)[1]) == 3


def test_readjust_and_reconsider():
    ink, rows = page(["ab ca", "bb"], dx=2, dy=-1)
    got = pagework.readjust(rows, ink, FONT)
    want = page(["ab ca", "bb"])[1]
    for g, w in zip(got, want, strict=True):
        if g["chr"] not in (boxes.SPACE, boxes.NEWLINE):
            assert (g["l"], g["t"], g["r"], g["b"]) == (w["l"], w["t"], w["r"], w["b"]) and g["corr"] >= 99
    space = got[2]
    assert (space["l"], space["r"]) == (got[1]["r"], got[3]["l"])
    wrong = [b | {"chr": "c"} if i == 1 else b for i, b in enumerate(got)]
    back = pagework.reconsider([b for b in wrong if b["chr"] != boxes.SPACE], ink, FONT, {(0, "c", 0): [(0, "b", 0)]})
    assert "".join("\n" if b["chr"] == boxes.NEWLINE else b["chr"] for b in back) == "abca\nbb\n"
    ink2, rows2 = page(["ab   ca"])
    spaced = pagework.reconsider([b for b in rows2 if b["chr"] != " "], ink2, FONT, {})
    assert "".join(b["chr"] for b in spaced[:-1]) == "ab ca"


def test_dropping():
    box = lambda c, l, corr: {"chr": c, "style": 0, "var": 0, "corr": corr, "l": l, "r": l + 7, "t": 0, "b": 9, "degenerate": False}  # noqa: E731, E741
    said = lambda rows: "".join(b["chr"] for b in rows)
    assert said(pagework.drop_overlapping([box("a", 0, 90), box("b", -6, 50), box("c", 20, 90)], FONT)) == "ac"
    assert said(pagework.drop_overlapping([box("a", 0, 40), box("b", -6, 50), box("c", 20, 90)], FONT)) == "bc"
    assert said(pagework.drop_overlapping([box("a", 0, 70), box("b", 1, 90)], FONT)) == "b"
    assert said(pagework.drop_overlapping([box("a", 0, 90), box("b", 9, 40)], FONT)) == "ab"
    assert said(pagework.drop_weak([box("a", 0, 10), box(",", 0, 30), box("b", 0, 30), box(" ", 0, 0)], 20, 40)) == "b "


def test_styles_resolve_to_the_least_changes():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(30):
        rows = [{"chr": "x", "style": int(s), "var": 0} for s in rng.integers(0, 8, 5)]
        classes = {(s, "x", 0): [(int(o), "x", 0) for o in rng.integers(0, 8, 2)] for s in range(8)}
        got = pagework.resolve_styles(rows, classes)
        cost = lambda p: sum((a ^ b).bit_count() for a, b in zip(p, p[1:]))
        options = [{r["style"], *(o[0] for o in classes[(r["style"], "x", 0)])} for r in rows]
        assert cost([g["style"] for g in got]) == min(cost(p) for p in itertools.product(*options))
    filled = pagework.fill_styles([{"chr": "a", "style": 3}, {"chr": " ", "style": 3}, {"chr": "b", "style": 1}, {"chr": " ", "style": 1}])
    assert [r["style"] for r in filled] == [3, 1, 1, 0]


def test_map_text():
    ink, rows = page(["abca", "bca"])
    chars = [(c, 0) for c in "abca\nbca"]
    start = {"spaces": (5.0, 15.0), "line": 30.0}
    kept = pagework.map_text(chars, rows[:-1], ink, FONT, **start)
    assert kept == rows[:-1]  # nothing changed, nothing sought
    changed = [dict(b) for b in rows[:-1]]
    del changed[2]
    got = pagework.map_text(chars, changed, ink, FONT, **start)
    assert "".join("\n" if b["chr"] == boxes.NEWLINE else b["chr"] for b in got) == "abca\nbca"
    assert [(b["l"], b["t"]) for b in got[:4]] == [(b["l"], b["t"]) for b in rows[:4]]
    gone = pagework.map_text([("a", 0), ("b", 0)], [], np.zeros((50, 200)), FONT, **start)
    assert len(gone) == 1 and gone[0]["corr"] < pagework.STOP


def test_batch_on_pages(spark):
    ink, rows = page(["ab ca", "bb"], dx=1)
    noise = rows[0] | {"l": rows[0]["l"] - 4, "r": rows[0]["r"] - 4, "chr": "c", "corr": 10}
    table = [{"page_no": p, "box_no": i, **b} for p in (1, 2) for i, b in enumerate([rows[0], noise, *rows[1:]] if p == 2 else rows, 1)]
    kinds = "page_no int, box_no long, chr string, style int, var int, corr int, degenerate boolean, l int, r int, t int, b int"
    given = spark.createDataFrame([tuple(b[n.split()[0]] for n in kinds.split(", ")) for b in table], kinds)
    pages = spark.createDataFrame([(p, 200, ink.ravel().tolist()) for p in (1, 2)], "page_no int, width int, px array<double>")
    got = pagework.page_map(pages, given, "page_no", lambda b, i: pagework.batch(b, i, FONT, {}, {})).orderBy("page_no", "box_no").collect()
    for p in (1, 2):
        assert "".join("\n" if r["chr"] == boxes.NEWLINE else r["chr"] for r in got if r["page_no"] == p).replace(" ", "") == "abca\nbb\n"


def test_unknown_boxes_cluster():
    ink, rows = page(["aba", "bca"])
    got = pagework.cluster_unknown([b | {"chr": boxes.UNKNOWN} if b["chr"] != boxes.NEWLINE else b for b in rows], ink)
    numbers = [b["var"] for b in got if b["chr"] == boxes.UNKNOWN]
    assert numbers[0] == numbers[2] == numbers[5] != 0 and numbers[1] == numbers[3] != 0 and numbers[4] == 0 and numbers[0] != numbers[1]


def test_registry(spark):
    pages = spark.createDataFrame([(0, "a.png", True)], "page_no int, path string, active boolean")
    more = registry.append_pages(pages, spark.createDataFrame([("c.png",), ("b.png",)], "path string"))
    assert [tuple(r) for r in more.orderBy("page_no").collect()] == [(0, "a.png", True), (1, "b.png", False), (2, "c.png", False)]
    assert [r.page_no for r in registry.set_active(more, 2).where("active").collect()] == [2] and registry.remove_pages(more, F.col("page_no") == 1).count() == 2
    styles = spark.createDataFrame([(1, "b"), (2, "i")], "id int, htmltag string")
    assert registry.append_style(styles, id=4, htmltag="u").count() == 3
    with pytest.raises(ValueError):
        registry.append_style(styles, id=2, htmltag="x")
    tags = spark.createDataFrame([(1, "b"), (1, "i"), (2, "x")], "at int, htmltag string")
    assert {r["at"]: r["style"] for r in registry.styles_of_tags(tags, styles, ["at"]).collect()} == {1: 3, 2: 0}
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "page_no int, box_no long, chr string")
    assert "".join(r["chr"] for r in registry.append_boxes(rows, rows.where("chr = 'a'"), ["page_no"]).orderBy("box_no").collect()) == "aba"


def test_aliases(spark):
    classes = spark.createDataFrame([(0, "a", 0), (1, "b", 0), (0, "abc", 4)], "style int, chr string, var int")
    aliases = spark.createDataFrame([(0, "a", 0, 2, "a", 0), (9, "z", 1, 9, "y", 1)], "style int, chr string, var int, target_style int, target_chr string, target_var int")
    listed = registry.alias_list(classes, aliases)
    assert listed.count() == 4 and listed.where("target_style is null").count() == 2
    assert {tuple(r) for r in registry.alias_map(listed).collect()} == {tuple(r) for r in aliases.collect()}
    restyled = registry.restyle_aliases(listed, F.col("chr") == "b", 5)
    assert (1, "b", 0, 5, "b", 0) in {tuple(r) for r in registry.alias_map(restyled).collect()}
    assert registry.alias_map(registry.reset_aliases(listed, F.lit(True))).count() == 0
    assert tuple(registry.key_bounds(classes, aliases).first()) == (4, 3)
    pair = spark.createDataFrame([((0, "a"), (0, "a")), ((0, "a"), None), (None, None)], "a struct<s int, c string>, b struct<s int, c string>")
    assert [r[0] for r in pair.select(registry.same_key("a", "b")).collect()] == [True, False, True]


def test_lines_and_parts(spark):
    scored = spark.createDataFrame([(1, 0, 0.5, "a"), (1, 1, 0.5, "b"), (1, 2, 0.4, "c"), (2, 0, -1.0, "d")], "box int, cand_no int, corr double, chr string")
    assert [tuple(r) for r in registry.best_candidate(scored, ["box"]).collect()] == [(1, 0, 0.5, "a")]
    heads = spark.createDataFrame([("a", "x"), ("b", None)], "h string, img string")
    assert tuple(registry.attribution_coverage(heads, "img").first()) == (2, 1, 1)
    parts = registry.blank_line_parts(spark.createDataFrame([(1, "ab\n\n\ncd\nef\n\n \n\ng"), (2, "")], "k int, t string"), "k", "t").orderBy("k", "part_no").collect()
    assert [tuple(r) for r in parts] == [(1, 1, "ab", 0), (1, 2, "cd\nef", 5), (1, 3, "g", 15)]
    rows = spark.createDataFrame([(1, 1, " ", 3), (1, 2, "a", 3), (1, 3, " ", 3), (1, 4, "b", 1), (1, 5, " ", 1)], "p int, box_no int, chr string, style int")
    assert [r["style"] for r in registry.white_space_styles(rows, ["p"], "box_no").orderBy("box_no").collect()] == [3, 3, 1, 1, 0]
    line = spark.createDataFrame([(1, 0, "a", 10, 90), (1, 0, "b", 12, 95), (1, 0, "c", 30, 5), (1, 0, " ", 99, 0)], "p int, line_no int, chr string, t int, corr int")
    assert {r["t"] for r in registry.straighten(line, ["p"]).collect()} == {10}


def test_page_sources(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<x><page a="1"><rtml>one \n</rtml></page>\n<page a="2"><rtml>two</rtml></page></x>')
    assert [r["rtml"] for r in projects.read_rtml(spark, str(tmp_path / "p.xml")).orderBy("page_no").collect()] == ["one", "two"]
    (tmp_path / "q.xml").write_text('<x><page a="1"><rtml>a</rtml><rtml>b</rtml></page></x>')
    with pytest.raises(Exception, match="not one text"):
        projects.read_rtml(spark, str(tmp_path / "q.xml")).collect()
    for folder, name, body in (("i", "a.pgm", "P5"), ("i", "b.pgm", "P5"), ("i", "c.pgm", "P5"), ("t", "a.rtml", "<b>x</b>"), ("t", "a.txt", "no"), ("t", "b.txt", "plain\n"), ("b", "a.box", "A 10 80 20 90 0\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(body)
    pages, found = projects.add_pages(spark, str(tmp_path / "i"), str(tmp_path / "t"), str(tmp_path / "b"), 100)
    assert [r["rtml"] for r in pages.orderBy("page_no").collect()] == ["<b>x</b>\n", "plain\n", None]
    assert [(r["page_no"], r["chr"], r["t"]) for r in found.collect()] == [(0, "A", 10)]
