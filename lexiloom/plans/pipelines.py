"""End-to-end plans: the lexicon from paragraphs, recognition and segmentation of pages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import senses, text
from ..operators import boxes, fonts, images, joins, lexicon


def build_lexicon(paras: DataFrame, keys: list[str], sources: DataFrame | None = None, keep_words: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(kept paragraphs, all scored ones): cleaning rules, headwords, splitting at headwords, scores and pruning; with sources (by, pos,
    img, top) the scan of each paragraph by its place (column pos of paras, group column by)."""
    rows = paras.withColumn("content", text.mark_headwords(text.apply_rules(F.concat(F.lit("<p>"), F.col("html")))))
    rows = rows.withColumn("content", F.regexp_replace("content", "^<p>", ""))
    carried = [c for c in ("by", "pos") if c in paras.columns]
    parts = lexicon.split_paragraphs(rows.select(*keys, *carried, "content"), [*keys, *carried])
    if sources is not None:
        parts = joins.asof(parts, sources, "by", "pos", ["img", "top"]).withColumn("pct", text.percent_of_height(F.col("top")))
    scored = lexicon.score_references(parts)
    kept = lexicon.prune_references(scored, keep_words=keep_words)
    return kept.withColumn("content", F.regexp_replace("content", "!!!", "")), scored


def recognise(pages: DataFrame, key: str, px: str, width: int, glyphs: list[tuple[str, np.ndarray]], threshold: float = 0.7) -> DataFrame:
    """Boxes in reading order with text: correlation of every glyph, suppression of peaks and overlaps, lines, spaces.

    A page is one row and stays in one task up to its boxes; from there on rows are boxes, grouped by page.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, p in zip(batch[key], batch[px], strict=True):
                page = np.asarray(p, float).reshape(-1, width)
                for name, g in glyphs:
                    if g.shape[0] <= page.shape[0] and g.shape[1] <= page.shape[1]:
                        c = np.round(images.correlate(page, g), 9)
                        out += [(k, name, float(c[y, x]), int(x), int(x + g.shape[1]), int(y), int(y + g.shape[0])) for y, x in np.argwhere(c >= threshold)]
            yield pd.DataFrame(out, columns=[key, "chr", "corr", "l", "r", "t", "b"])

    found = pages.select(key, px).mapInPandas(run, f"{key} long, chr string, corr double, l long, r long, t long, b long")
    peaks = boxes.peak_suppress(found.withColumns({"x": F.col("l"), "y": F.col("t")}), [key, "chr"], "corr", "l", reach=2).drop("x", "y")
    kept = boxes.nms(peaks, [key], "corr", "chr")
    lined = fonts.cluster_lines(kept, key)
    w = Window.partitionBy(key).orderBy("line_no", "l", "chr")
    ordered = lined.withColumn("box_no", F.row_number().over(w))
    line = Window.partitionBy(key, "line_no").orderBy("l", "chr")
    gap = F.col("l") - F.lag("r").over(line)
    return boxes.insert_gaps(ordered.withColumn("_gap0", gap), key, ["box_no"], F.col("_gap0") > (F.col("r") - F.col("l")) / 2, "chr", boxes.SPACE).drop("_gap0")


def segment_page(pages: DataFrame, key: str, px: str, width: int, least: int = 2, threshold: float = 0.5) -> DataFrame:
    """Segments of a page as unknown boxes in reading order: components, sizes, lines, horizontal merging of what overlaps."""
    seg = images.segment(pages, key, px, width, threshold).where(F.col("n") >= least)
    lined = fonts.cluster_lines(seg.select(key, "l", "r", "t", "b"), key)
    merged = boxes.merge_intervals(lined.select(key, "line_no", "l", "r"), [key, "line_no"], "l", "r")
    ends = merged.withColumnsRenamed({"l": "ml", "r": "mr"})
    boxed = lined.join(ends, [key, "line_no"]).where("l >= ml and r <= mr").groupBy(key, "line_no", "island").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.min("t").alias("t"), F.max("b").alias("b"))
    w = Window.partitionBy(key).orderBy("line_no", "island")
    return boxed.select(key, F.row_number().over(w).alias("box_no"), F.lit(boxes.UNKNOWN).alias("chr"), "l", "r", "t", "b", "line_no")


def nested_markup(markers: DataFrame, key: str, order: str, marker: str, body: str) -> DataFrame:
    """key and html: the texts between markers as nested lists."""
    nest = lexicon.sense_nesting(markers, key, order, marker)
    rows = nest.join(markers.select(key, order, body), [key, order])
    cls = senses.list_class(senses.classify(F.col("m"))["mtype"])
    opening: Column = F.when(F.col("opens"), F.concat(F.lit('\n<ol class="'), cls, F.lit('"><li>'))).otherwise("</li>\n<li>")
    piece = F.concat(F.repeat(F.lit("</li></ol>"), F.col("closes")), opening, F.col("m"), F.lit(" "), F.col(body))
    items = F.array_sort(F.collect_list(F.struct(order, piece.alias("x"), "depth")))
    joined = F.array_join(F.transform(items, lambda i: i["x"]), "")
    return rows.groupBy(key).agg(F.concat(joined, F.repeat(F.lit("</li></ol>"), F.element_at(items, -1)["depth"])).alias("html"))


def aligned_once(left: DataFrame, right: DataFrame, group: str, order: str, key: str, folder: str) -> DataFrame:
    """The greedy alignment, kept as Parquet under a fingerprint of both sides; a later call with equal input reads it."""
    spark = left.sparkSession
    mark = lambda d: d.agg(F.sum(F.xxhash64(group, order, key).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    name = f"{folder}/aligned-{hashlib.sha256(repr((mark(left), mark(right), group, order, key)).encode()).hexdigest()[:24]}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(name + "/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        lexicon.align_greedy(left, right, group, order, key).write.mode("overwrite").parquet(name)
    return spark.read.parquet(name)
