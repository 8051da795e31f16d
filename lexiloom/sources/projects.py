"""Sources and sinks: office files, page projects in XML, box files, confusable pairs, images, HTML."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.boxes import NEWLINE, SPACE

BOXES = "page_no int, box_no long, chr string, style int, var int, degenerate boolean, corr int, l int, r int, t int, b int"
#: Long and short names of box attributes.
SYNONYMS = {"chr": ("char", "c"), "style": ("style", "s"), "var": ("variant", "var", "v"), "degenerate": ("degenerate", "deg", "d"), "corr": ("correlation", "corr", "cr"), "l": ("left", "l"), "r": ("right", "r"), "t": ("top", "t"), "b": ("bot", "b")}


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path and value, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_project(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, boxes) of project files: pages with path and marked-up text, boxes in order with all attribute synonyms."""
    files = whole_files(spark, path)
    pages = files.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)(<page\b.*?</page>)"), F.lit(1))).alias("page_no", "page"))
    pages = pages.select("path", "page_no", F.regexp_extract("page", r'<page\b[^>]*\bpath="([^"]*)"', 1).alias("image"), F.regexp_extract("page", r"(?s)<rtml>(.*?)</rtml>", 1).alias("rtml"), "page")
    raw = pages.select("path", "page_no", F.posexplode(F.regexp_extract_all("page", F.lit(r"<box\b([^>]*)/>"), F.lit(1))).alias("box_no", "a"))
    any_of = lambda names: F.regexp_extract("a", rf'(?:^|\s)(?:{"|".join(names)})="([^"]*)"', 1)
    kinds = {"style": "int", "var": "int", "corr": "int", "l": "int", "r": "int", "t": "int", "b": "int"}
    number = lambda c: F.coalesce(F.nullif(any_of(SYNONYMS[c]), F.lit("")), F.lit("0")).cast(kinds[c])
    boxes = raw.select(
        "path", F.col("page_no").cast("int"), F.col("box_no").cast("long"), text.decode_entities(any_of(SYNONYMS["chr"])).alias("chr"), number("style").alias("style"), number("var").alias("var"),
        any_of(SYNONYMS["degenerate"]).isin("1", "true").alias("degenerate"), *[number(c).alias(c) for c in ("corr", "l", "r", "t", "b")],
    )
    return pages.drop("page"), boxes


def page_xml(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """page_no and the page's XML; attributes at their defaults are left out."""
    attribute = lambda n, c, default: F.when(F.col(c) == default, "").otherwise(F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"')))
    one = F.concat(
        F.lit('<box c="'), text.encode_entities(F.col("chr")), F.lit('"'), F.lit(' s="'), F.col("style").cast("string"), F.lit('"'),
        attribute("v", "var", 0), F.when(F.col("degenerate"), ' d="1"').otherwise(""), attribute("cr", "corr", 0),
        *[F.concat(F.lit(f' {c}="'), F.col(c).cast("string"), F.lit('"')) for c in "lrtb"], F.lit("/>"),
    )
    items = F.array_sort(F.collect_list(F.struct("box_no", one.alias("x"))))
    body = boxes.groupBy("page_no").agg(F.array_join(F.transform(items, lambda i: i["x"]), "\n").alias("body"))
    head = F.concat(F.lit('<page path="'), F.col("image"), F.lit('">\n<rtml>'), F.col("rtml"), F.lit("</rtml>\n"))
    return pages.join(body, "page_no", "left").select("page_no", F.concat(head, F.coalesce("body", F.lit("")), F.lit("\n</page>")).alias("value"))


def read_box_file(spark: SparkSession, path: str, height: int, back: int = 30) -> tuple[DataFrame, DataFrame]:
    """(boxes, bad lines) of a box file (chr l b r t [page], origin at the bottom): y turns over, and a line end stands before a box
    that begins more than back pixels left of the one before."""
    lines = whole_files(spark, path).select("path", F.posexplode(F.split("value", "\r?\n")).alias("no", "line")).where("line <> ''")
    part = F.split("line", " ")
    whole = F.col("line").rlike(r"^\S+( -?[0-9]+){4,5}\s*$")
    bad = lines.where(~whole)
    rows = lines.where(whole).select("path", "no", part[0].alias("chr"), part[1].cast("int").alias("l"), part[3].cast("int").alias("r"), (height - part[4].cast("int")).alias("t"), (height - part[2].cast("int")).alias("b"))
    w = Window.partitionBy("path").orderBy("no")
    rows = rows.withColumn("_new", F.coalesce(F.col("l") < F.lag("l").over(w) - back, F.lit(False)))
    rows = rows.withColumn("_p", F.explode(F.when(F.col("_new"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    rows = rows.withColumn("chr", F.when(F.col("_p") == 0, NEWLINE).otherwise(F.col("chr")))
    order = Window.partitionBy("path").orderBy("no", "_p")
    return rows.withColumn("box_no", F.row_number().over(order).cast("long")).drop("_new", "_p", "no"), bad


def box_file_lines(boxes: DataFrame, height: int) -> DataFrame:
    """Lines of a box file: no degenerate boxes, spaces or line ends."""
    rows = boxes.where(~F.col("chr").isin(SPACE, NEWLINE))
    if "degenerate" in boxes.columns:
        rows = rows.where("not degenerate")
    return rows.select("box_no", F.concat_ws(" ", "chr", F.col("l").cast("string"), (height - F.col("b")).cast("string"), F.col("r").cast("string"), (height - F.col("t")).cast("string")).alias("value"))


def read_confusables(spark: SparkSession, path: str, glyphs: DataFrame) -> DataFrame:
    """Pairs of glyph classes (style, chr, var twice), with each glyph paired with itself first (cand_no 0)."""
    part = F.split("value", r"\s+")
    own = glyphs.select("style", "chr", "var").select("*", F.col("style").alias("style2"), F.col("chr").alias("chr2"), F.col("var").alias("var2"), F.lit(0).alias("cand_no"))
    read = spark.read.text(path).where(F.size(part) >= 6).select(part[0].cast("int").alias("style"), part[1].alias("chr"), part[2].cast("int").alias("var"), part[3].cast("int").alias("style2"), part[4].alias("chr2"), part[5].cast("int").alias("var2"), F.lit(1).alias("cand_no"))
    return own.unionByName(read)


_OFFICE, _TEXT, _STYLE, _FO = ("{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % x for x in ("office", "text", "style", "xsl-fo-compatible"))


def office_paragraphs(xml: str) -> list[str]:
    """Paragraphs of an office file as marked-up text. Bold, underlined and italic come from the file's own automatic styles, a
    yellow background counts as the gloss style; other styles leave no mark, both kinds of break are line breaks."""
    root = ElementTree.fromstring(xml)
    marks: dict[str, list[str]] = {"Fraktur": ["span"]}
    for style in root.iter(f"{_STYLE}style"):
        p = style.find(f"{_STYLE}text-properties")
        if p is not None:
            found = [t for t, on in (("span", p.get(f"{_FO}background-color") == "#ffff00"), ("b", p.get(f"{_FO}font-weight") == "bold"), ("u", p.get(f"{_STYLE}text-underline-style", "none") != "none"), ("i", p.get(f"{_FO}font-style") == "italic")) if on]
            if found:
                marks.setdefault(style.get(f"{_STYLE}name"), found)

    def inline(e: ElementTree.Element) -> str:
        tag = e.tag.removeprefix(_TEXT)
        inner = (e.text or "") + "".join(inline(c) + (c.tail or "") for c in e)
        if tag in ("line-break", "soft-page-break"):
            return "<br/>\n"
        if tag == "s":
            return " " * int(e.get(f"{_TEXT}c", "1"))
        if tag == "span":
            own = marks.get(e.get(f"{_TEXT}style-name", ""), [])
            return "".join(f"<{t}>" for t in own) + inner + "".join(f"</{t}>" for t in reversed(own)) if inner else ""
        return inner if tag == "p" else ""

    body = root.find(f"{_OFFICE}body/{_OFFICE}text")
    return [inline(p) for p in body.iter(f"{_TEXT}p")] if body is not None else []


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """file_no (in order of path), para_no and html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, v in zip(batch["path"], batch["value"], strict=True):
                found = office_paragraphs(v)
                yield pd.DataFrame({"path": [p] * len(found), "para_no": range(len(found)), "html": found})

    rows = whole_files(spark, path).mapInPandas(run, "path string, para_no int, html string")
    numbers = rows.select("path").distinct().withColumn("file_no", (F.row_number().over(Window.orderBy("path")) - 1))
    return rows.join(F.broadcast(numbers), "path").select("file_no", "para_no", "html")


#: How a file's last paragraph and the next file's first meet: (end of the last, start of the first, what stands
#: between, whether they stay two paragraphs), in this order.
STITCHES = (
    (r"-</span>\z", r"^<span>", "", False), (r"</b></span>\z", r"^<span><b>", " ", False), (r"</span>\z", r"^<span>", " ", False),
    (r"\z", r"^<br/>\n", "", True), (r"\z", r"^(?=(I\. )?<b>)", "", True), (r" —\z", "^", "<br/>\n", False), (r"-\z", "^", "", False), (r"\z", "^", " ", False),
)


def stitch(a: str, b: str) -> tuple[list[str], int]:
    """The one or two paragraphs that the end of a file and the start of the next become, and the number of the rule."""
    for i, (end, start, between, two) in enumerate(STITCHES):
        m, n = re.search(end.replace(r"\z", r"\Z"), a), re.search(start, b)
        if m and n:
            left, right = a[: m.start()], b[n.end() :]
            return ([left, right] if two else [left + between + right]), i
    return [a, b], -1


def decode_pgm(raw: bytes) -> np.ndarray:
    """A binary PGM or PPM (8 bits) as ink, 0 paper to 1 ink."""
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
    kind, w, h, top = m[1], int(m[2]), int(m[3]), int(m[4])
    n = 3 if kind == b"6" else 1
    a = np.frombuffer(raw, np.uint8, w * h * n, m.end()).reshape(h, w, n).astype(float)
    return 1 - a.mean(axis=2) / top


def encode_pgm(ink: np.ndarray) -> bytes:
    a = np.rint(255 * (1 - np.clip(ink, 0, 1))).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def encode_png(ink: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    a = np.rint(255 * (1 - np.clip(ink, 0, 1))).astype(np.uint8)
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    rows = b"".join(b"\0" + r.tobytes() for r in a)
    head = a.shape[1].to_bytes(4, "big") + a.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height and px (ink, row-major) of PGM and PPM files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [decode_pgm(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "width": [a.shape[1] for a in got], "height": [a.shape[0] for a in got], "px": [a.ravel().astype(np.float32) for a in got]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, width int, height int, px array<float>")


def html_document(paras: DataFrame, order: list[str], html: str = "html", title: str = "Lexicon") -> DataFrame:
    """Lines of an HTML file (no, value): a shell around the paragraphs in order, without review flags."""
    body = paras.select(F.struct(F.lit(1).alias("part"), *order).alias("no"), F.concat(F.lit("<p>"), F.regexp_replace(html, "!!!", ""), F.lit("</p>")).alias("value"))
    spark = paras.sparkSession
    kind = body.schema["no"].dataType
    shell = spark.createDataFrame([({"part": 0}, f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body>'), ({"part": 2}, "</body></html>")], body.schema.__class__([body.schema["no"].__class__("no", kind), body.schema["value"]]))
    return body.unionByName(shell).orderBy("no")


def read_rtml(spark: SparkSession, path: str) -> DataFrame:
    """file, page_no and rtml of project files in order of path; a page that doesn't hold exactly one text is an error."""
    pages = whole_files(spark, path).select("path", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)(<page .*?</page>)"), F.lit(1))).alias("page_no", "page"))
    texts = F.regexp_extract_all("page", F.lit(r"(?s)<rtml>(.*?)\s*</rtml>"), F.lit(1))
    one = F.when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not one text in a page of "), F.col("path"))))
    return pages.select("path", "page_no", one.alias("rtml"))


#: Suffixes of marked-up texts beside an image, in order.
TEXT_SUFFIXES = (".rtml", ".txt")


def import_texts(spark: SparkSession, images: DataFrame, folder: str) -> DataFrame:
    """path and rtml for every image path: the text file of its base name in folder, by the first of TEXT_SUFFIXES; null without one. Every
    line ends with a line end."""
    base = lambda c: F.regexp_extract(c, r"([^/]*?)(\.[^./]*)?\z", 1)
    files = whole_files(spark, folder).select(base("path").alias("_base"), F.regexp_extract("path", r"(\.[^./]*)\z", 1).alias("_suffix"), "value")
    rank = F.array_position(F.array(*map(F.lit, TEXT_SUFFIXES)), F.col("_suffix"))
    first = files.where(F.col("_suffix").isin(*TEXT_SUFFIXES)).groupBy("_base").agg(F.min_by("value", rank).alias("value"))
    ended = F.when(F.col("value").endswith("\n"), F.col("value")).otherwise(F.concat("value", F.lit("\n")))
    return images.select("path", base("path").alias("_base")).join(first, "_base", "left").select("path", ended.alias("rtml"))


def add_pages(spark: SparkSession, images: str, texts: str, box_files: str, height: int) -> tuple[DataFrame, DataFrame]:
    """(pages, boxes): a page for each image file in order of path, with the text and the boxes that stand beside it under its base name."""
    found = spark.read.format("binaryFile").load(images).select("path")
    pages = import_texts(spark, found, texts).withColumn("page_no", F.row_number().over(Window.orderBy("path")) - 1)
    base = lambda c: F.regexp_extract(c, r"([^/]*?)(\.[^./]*)?\z", 1)
    boxes, _ = read_box_file(spark, box_files, height)
    numbered = boxes.withColumn("_base", base("path")).drop("path").join(pages.select("page_no", base("path").alias("_base")), "_base").drop("_base")
    return pages.select("page_no", "path", "rtml"), numbered
