"""Pages, styles, aliases and classes of a project as small tables, and joins with them. A key is (style, chr, var)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boxes

KEY = ("style", "chr", "var")
TARGET = ("target_style", "target_chr", "target_var")


def append_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """pages (page_no, path, active) and, after them, one inactive page for each path of files, in order of path."""
    last = pages.agg(F.coalesce(F.max("page_no"), F.lit(-1)).alias("last"))
    new = files.select("path").withColumn("k", F.row_number().over(Window.orderBy("path"))).join(F.broadcast(last))
    return pages.unionByName(new.select((F.col("last") + F.col("k")).cast(pages.schema["page_no"].dataType).alias("page_no"), "path", F.lit(False).alias("active")))


def remove_pages(pages: DataFrame, gone: Column) -> DataFrame:
    return pages.where(~gone)


def set_active(pages: DataFrame, page_no: int) -> DataFrame:
    """One page is active; none if there is no such page."""
    return pages.withColumn("active", F.col("page_no") == page_no)


def append_style(styles: DataFrame, **fields: object) -> DataFrame:
    """styles and one more, after a check that its id is a new single bit; fields that are left out are empty."""
    bit = int(fields["id"])
    if bit.bit_count() > 1 or not styles.where(F.col("id") == bit).isEmpty():
        raise ValueError(f"style {bit} exists or is no single bit")
    row = styles.sparkSession.createDataFrame([tuple(fields.get(c, "") for c in styles.columns)], styles.schema)
    return styles.unionByName(row)


def append_boxes(rows: DataFrame, new: DataFrame, by: list[str], order: str = "box_no") -> DataFrame:
    """New rows after the last one of their group, in their own order; columns that they lack are null."""
    last = rows.groupBy(*by).agg(F.max(order).alias("_last"))
    kind = rows.schema[order].dataType
    placed = new.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).join(last, by, "left")
    placed = placed.withColumn(order, (F.coalesce("_last", F.lit(0)) + F.col("_k")).cast(kind)).drop("_k", "_last")
    return rows.unionByName(placed, allowMissingColumns=True)


def styles_of_tags(tags: DataFrame, styles: DataFrame, by: list[str]) -> DataFrame:
    """by and style: the or of the bits of all tags there (column htmltag); tags without a style count 0."""
    known = tags.join(F.broadcast(styles.select("htmltag", "id")), "htmltag", "left")
    return known.groupBy(*by).agg(F.bit_or(F.coalesce("id", F.lit(0))).alias("style"))


def alias_list(classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """All classes and alias sources once, each with its target; null where it is no alias."""
    keys = classes.select(*KEY).union(aliases.select(*KEY)).distinct()
    return keys.join(aliases, list(KEY), "left").select(*KEY, *TARGET)


def restyle_aliases(listed: DataFrame, selected: Column, style: int) -> DataFrame:
    """Selected rows lead to their own character and variant, or to those set before, in the given style."""
    new = {"target_style": F.lit(style), "target_chr": F.coalesce(F.nullif(F.col("target_chr"), F.lit("")), F.col("chr")), "target_var": F.coalesce("target_var", "var")}
    return listed.withColumns({c: F.when(selected, v).otherwise(F.col(c)) for c, v in new.items()})


def reset_aliases(listed: DataFrame, selected: Column) -> DataFrame:
    return listed.withColumns({c: F.when(~selected, F.col(c)) for c in TARGET})


def alias_map(listed: DataFrame) -> DataFrame:
    """The rows that lead elsewhere, missing parts of a target being the source's own."""
    full = listed.select(*KEY, *[F.coalesce(F.nullif(F.col(t), F.lit("")) if t == "target_chr" else F.col(t), F.col(k)).alias(t) for t, k in zip(TARGET, KEY, strict=True)])
    return full.where(~(F.struct(*KEY).eqNullSafe(F.struct(*[F.col(t).alias(k) for t, k in zip(TARGET, KEY, strict=True)]))))


def same_key(a: str, b: str) -> Column:
    """Whether two key structs are equal; an absent key (null) equals an absent one."""
    return F.col(a).eqNullSafe(F.col(b))


def key_bounds(classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: the largest variant and the longest character of classes and alias sources, 0 without any."""
    keys = classes.select("chr", "var").union(aliases.select("chr", "var"))
    return keys.agg(F.coalesce(F.max("var"), F.lit(0)).alias("max_var"), F.coalesce(F.max(F.length("chr")), F.lit(0)).alias("max_length"))


def best_candidate(scored: DataFrame, box: list[str], corr: str = "corr", order: str = "cand_no") -> DataFrame:
    """Of each box's candidates the one of the highest corr above -1; of equal ones the first listed."""
    rest = [c for c in scored.columns if c not in box]
    best = F.max_by(F.struct(*rest), F.struct(F.col(corr), -F.col(order)))
    return scored.where(F.col(corr) > -1).groupBy(*box).agg(best.alias("_b")).select(*box, *[F.col(f"_b.{c}").alias(c) for c in rest])


def attribution_coverage(heads: DataFrame, source: str) -> DataFrame:
    """One row: headwords, those with a source, and those without."""
    return heads.agg(F.count(F.lit(1)).alias("total"), F.count(source).alias("attributed"), F.count_if(F.col(source).isNull()).alias("missing"))


def blank_line_parts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, part_no (from 1), part and its start (from 0) for the parts between blank lines that hold more than white space."""
    piece = F.regexp_extract_all(text, F.lit(r"(?s)(.*?)(\n\n+|\z)"), F.lit(1))
    gap = F.regexp_extract_all(text, F.lit(r"(?s)(.*?)(\n\n+|\z)"), F.lit(2))
    cut = rows.select(key, F.posexplode(F.arrays_zip(piece.alias("p"), gap.alias("g"))).alias("_at", "_z")).select(key, "_at", F.col("_z.p").alias("part"), F.col("_z.g").alias("_gap"))
    w = Window.partitionBy(key).orderBy("_at")
    placed = cut.withColumn("start", F.coalesce(F.sum(F.length("part") + F.length("_gap")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return placed.where(F.col("part").rlike(r"\S")).withColumn("part_no", F.row_number().over(w)).select(key, "part_no", "part", "start")


def white_space_styles(rows: DataFrame, by: list[str], order: str, style: str = "style", chr_: str = "chr") -> DataFrame:
    """White space keeps the style bits that it shares with the next glyph (none after the last); a group's first row stays."""
    blank = F.col(chr_).isin(boxes.SPACE, boxes.NEWLINE)
    w = Window.partitionBy(*by).orderBy(order)
    after = F.first(F.when(~blank, F.col(style)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    shared = F.col(style).bitwiseAND(F.coalesce(after, F.lit(0)))
    return rows.withColumn(style, F.when(blank & (F.row_number().over(w) > 1), shared).otherwise(F.col(style)))


def straighten(rows: DataFrame, by: list[str], top: str = "t", corr: str = "corr", chr_: str = "chr", line: str = "line_no") -> DataFrame:
    """Every box of a line has the line's top: the median top of the better half of its glyphs; line ends stay as they are."""
    glyphs = rows.where(~F.col(chr_).isin(boxes.SPACE, boxes.NEWLINE))
    tops = boxes.line_top(glyphs, [*by, line], top, corr).withColumnRenamed("q", "_q")
    joined = rows.join(tops, [*by, line], "left")
    return joined.withColumn(top, F.when(F.col(chr_) != boxes.NEWLINE, F.coalesce("_q", top)).otherwise(F.col(top))).drop("_q")
