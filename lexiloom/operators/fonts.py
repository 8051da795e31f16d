"""An average font from boxes: pair distances, bearings by least squares, deviations, spaces, mean images, and typesetting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import images, stats
from .boxes import NEWLINE, SPACE, line_ids

ANCHOR = 1000.0


def neighbours(boxes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Pairs of neighbours in a line, without degenerate boxes: left and right class, distance of their left edges, gap, and whether
    a space lies between."""
    key = key or ["style", "chr", "var"]
    lined = line_ids(boxes.where("not degenerate"), ["page_no"], "box_no", F.col("chr") == NEWLINE)
    w = Window.partitionBy("page_no", "line_no").orderBy("box_no")
    spaced = lined.where(F.col("chr") != NEWLINE).withColumn("spaced", F.coalesce(F.lead("chr").over(w) == SPACE, F.lit(False)))
    glyphs = spaced.where(F.col("chr") != SPACE)
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    rows = glyphs.withColumns({"a": name, "b": F.lead(name).over(w), "next_l": F.lead("l").over(w)}).where("b is not null")
    return rows.select("page_no", "line_no", "a", "b", "spaced", (F.col("next_l") - F.col("l")).cast("double").alias("distance"), (F.col("next_l") - F.col("r")).cast("double").alias("gap"))


def pair_distances(pairs: DataFrame) -> DataFrame:
    return pairs.where("not spaced").groupBy("a", "b").agg(F.avg("distance").alias("mean"), stats.sample_variance("distance").alias("var"), F.count(F.lit(1)).alias("n"))


def bearings(distances: DataFrame) -> DataFrame:
    """unknown and x: the right bearing R|a and left bearing L|b with mean distance R + L, weighted by n / variance (1 if that is 0).

    Within each set of classes that occur together one left bearing is anchored at 0; the number of classes of a font is bounded.
    """
    weight = F.when(F.col("var") == 0, 1.0).otherwise(F.col("n") / F.col("var"))
    rows = distances.select(F.concat_ws(">", "a", "b").alias("eq"), F.explode(F.array(F.concat(F.lit("R|"), "a"), F.concat(F.lit("L|"), "b"))).alias("u"), F.lit(1.0).alias("v"), F.col("mean").alias("t"), weight.alias("w"))
    sets = stats.components(distances.select(F.concat(F.lit("R|"), "a").alias("a"), F.concat(F.lit("L|"), "b").alias("b")))
    anchors = sets.where(F.col("node").startswith("L|")).groupBy("comp").agg(F.min("node").alias("u"))
    fixed = anchors.select(F.concat(F.lit("anchor "), "u").alias("eq"), "u", F.lit(1.0).alias("v"), F.lit(0.0).alias("t"), F.lit(ANCHOR).alias("w"))
    return stats.least_squares(rows.unionByName(fixed), "eq", "u", "v", "t", "w")


def deviations(pairs: DataFrame, solved: DataFrame) -> DataFrame:
    """class, ldev and rdev: root mean squares of distances around the predicted ones, as right and as left neighbour; 0 without any."""
    r = solved.where(F.col("u").startswith("R|")).select(F.substring("u", 3, 1 << 20).alias("a"), F.col("x").alias("rx"))
    s = solved.where(F.col("u").startswith("L|")).select(F.substring("u", 3, 1 << 20).alias("b"), F.col("x").alias("lx"))
    off = pairs.where("not spaced").join(F.broadcast(r), "a").join(F.broadcast(s), "b").withColumn("sq", F.pow(F.col("distance") - F.col("rx") - F.col("lx"), 2))
    right = off.groupBy(F.col("a").alias("class")).agg(F.sqrt(F.avg("sq")).alias("rdev"))
    left = off.groupBy(F.col("b").alias("class")).agg(F.sqrt(F.avg("sq")).alias("ldev"))
    return right.join(left, "class", "full").select("class", F.coalesce("ldev", F.lit(0.0)).alias("ldev"), F.coalesce("rdev", F.lit(0.0)).alias("rdev"))


def space_quantiles(pairs: DataFrame) -> tuple[float | None, ...]:
    """The gaps over spaces at 1, 50 and 95 percent, by the upper rule, from the histogram of gaps: at most a page's width of rows."""
    counts = pairs.where("spaced and gap is not null").groupBy("gap").agg(F.count(F.lit(1)).alias("n")).orderBy("gap").collect()
    ends = np.cumsum([c.n for c in counts])
    if not len(ends):
        return None, None, None
    return tuple(counts[int(np.searchsorted(ends, min(int(ends[-1] * at), ends[-1] - 1), "right"))].gap for at in (0.01, 0.5, 0.95))


def mean_images(crops: DataFrame, key: str) -> DataFrame:
    """key, x, y and mean ink of aligned crops (key, dx, dy, w, px): order-free, pixel by pixel, summed before the shuffle."""
    cells = crops.select(key, "dx", "dy", "w", F.posexplode("px").alias("i", "ink"))
    at = cells.select(key, (F.col("i") % F.col("w") - F.col("dx")).alias("x"), (F.floor(F.col("i") / F.col("w")) - F.col("dy")).alias("y"), "ink")
    n = crops.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return at.groupBy(key, "x", "y").agg(F.sum("ink").alias("s")).join(n, key).select(key, "x", "y", (F.col("s") / F.col("n")).alias("ink"))


def typeset(lines: DataFrame, glyphs: DataFrame, by: list[str], order: str, space: float) -> DataFrame:
    """Places of glyphs: each stands its left neighbour's right bearing and its own left bearing after it. lines: by, order, class (null
    is a space); glyphs: class, lb, rb, a font of bounded size."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = lines.join(F.broadcast(glyphs), "class", "left")
    step = F.coalesce("lb", F.lit(0.0)) + F.coalesce(F.lag("rb").over(w), F.lit(0.0)) + F.when(F.lag("class").over(w).isNull() & F.lag(order).over(w).isNotNull(), F.lit(space)).otherwise(0.0)
    return rows.withColumn("_s", step).withColumn("x", F.sum("_s").over(w)).drop("_s", "lb", "rb")


def build_font(boxes: DataFrame) -> tuple[DataFrame, tuple]:
    """(class, lb, rb, ldev, rdev and the number of pairs) of a font, and its space quantiles."""
    pairs = neighbours(boxes)
    solved = bearings(pair_distances(pairs))
    side = lambda p, name: solved.where(F.col("u").startswith(p)).select(F.substring("u", 3, 1 << 20).alias("class"), F.col("x").alias(name))
    counts = pairs.groupBy(F.col("a").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    table = side("L|", "lb").join(side("R|", "rb"), "class", "full").join(deviations(pairs, solved), "class", "left").join(counts, "class", "left")
    return table, space_quantiles(pairs)


def displacement(image: np.ndarray, glyph: np.ndarray, window: tuple[slice, slice] | None = None, good: float | None = None) -> tuple[float, int, int]:
    """corr, dx, dy of the best shift in a window of shifts; with good, the leftmost shift that reaches it."""
    c = images.correlate(image, glyph)
    ys, xs = window or (slice(None), slice(None))
    part = c[ys, xs]
    y, x = np.unravel_index(part.argmax(), part.shape)
    if good is not None and (hit := np.argwhere(part.T >= good)).size:
        x, y = hit[0]
    return float(part[y, x]), int(x + (xs.start or 0)), int(y + (ys.start or 0))


def cluster_lines(rows: DataFrame, by: str, margin: float = 1.5) -> DataFrame:
    """line_no for boxes (by, t, b): rows of the page that no median-high core covers separate lines. Cores are the middle of a box, at most
    a median height over margin high, so that tall letters do not join lines."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        t, b = group["t"].to_numpy(), group["b"].to_numpy()
        high = max(1.0, float(np.sort(b - t)[(len(t) - 1) // 2]))
        mid, half = (t + b) / 2, np.minimum(b - t, high / margin) / 2
        cover = np.zeros(int(b.max(initial=0)) + 2, int)
        np.add.at(cover, np.maximum(0, np.floor(mid - half)).astype(int), 1)
        np.add.at(cover, np.minimum(len(cover) - 1, np.ceil(mid + half).astype(int) + 1), -1)
        on = np.cumsum(cover) > 0
        number = np.cumsum(np.concatenate([[on[0]], on[1:] & ~on[:-1]]))
        return group.assign(line_no=number[np.clip(mid, 0, len(on) - 1).astype(int)])

    from pyspark.sql import types as T

    return rows.groupBy(by).applyInPandas(run, T.StructType([*rows.schema.fields, T.StructField("line_no", T.LongType())]))


def appearance(px: np.ndarray, size: tuple[float, float], side: int = 19) -> np.ndarray:
    """Features of a box: its size over ten, the ink at its centre of mass, and the neighbourhood of that centre."""
    ink = px.sum()
    y, x = ((np.indices(px.shape) * px).sum(axis=(1, 2)) / ink).round().astype(int) if ink else (px.shape[0] // 2, px.shape[1] // 2)
    wide = np.pad(px, side)
    near = wide[y + side - side // 2 : y + side + side // 2 + 1, x + side - side // 2 : x + side + side // 2 + 1]
    return np.concatenate([[size[0] / 10, size[1] / 10, px[y, x]], near.ravel()])
