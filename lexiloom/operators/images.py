"""Ink images as arrays: scaling, segmentation, template matching and composition. An image is width, height, px (row-major, 0 paper to 1 ink)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ink(red: Column, green: Column, blue: Column) -> Column:
    return 1 - (red + green + blue) / 765.0


def cells(images: DataFrame, key: str, px: str, width: int) -> DataFrame:
    """key, x, y and ink of every pixel."""
    return images.select(key, F.posexplode(px).alias("i", "ink")).select(key, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), "ink")


def center_of_mass(images: DataFrame, key: str, px: str, width: int) -> DataFrame:
    """Mass and centre of each image, by folds inside its row."""
    total = F.aggregate(px, F.lit(0.0), lambda s, v: s + v)
    along = lambda f: F.aggregate(F.transform(px, lambda v, i: v.cast("double") * f(i)), F.lit(0.0), lambda s, v: s + v)
    return images.select(key, total.alias("mass"), (along(lambda i: i % width) / total).alias("cx"), (along(lambda i: F.floor(i / width)) / total).alias("cy"))


def label_components(a: np.ndarray, threshold: float) -> np.ndarray:
    """Labels (from 1) of 8-connected ink above the threshold, in reading order of their first cell; two passes with union-find."""
    high, wide = a.shape
    labels = np.zeros(a.shape, int)
    parent = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    on = a > threshold
    for y in range(high):
        for x in np.flatnonzero(on[y]):
            near = {root(labels[v, u]) for v, u in ((y - 1, x - 1), (y - 1, x), (y - 1, x + 1), (y, x - 1)) if 0 <= v and 0 <= u < wide and labels[v, u]}
            if not near:
                parent.append(len(parent))
                labels[y, x] = len(parent) - 1
            else:
                first = min(near)
                labels[y, x] = first
                for n in near:
                    parent[n] = first
    roots = np.array([root(i) for i in range(len(parent))])[labels]
    names = {r: k for k, r in enumerate(dict.fromkeys(roots[roots > 0].tolist()), 1)}
    return np.vectorize(lambda r: names.get(r, 0), otypes=[int])(roots)


def segment(images: DataFrame, key: str, px: str, width: int, threshold: float = 0.5) -> DataFrame:
    """key, seg and the bounding box (inclusive) and size of each 8-connected component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, p in zip(batch[key], batch[px], strict=True):
                labels = label_components(np.asarray(p, float).reshape(-1, width), threshold)
                for s in range(1, labels.max(initial=0) + 1):
                    y, x = np.nonzero(labels == s)
                    rows.append((k, s, x.min(), x.max(), y.min(), y.max(), len(x)))
            yield pd.DataFrame(rows, columns=[key, "seg", "l", "r", "t", "b", "n"])

    return images.select(key, px).mapInPandas(run, f"{key} long, seg int, l int, r int, t int, b int, n long")


def correlate(page: np.ndarray, glyph: np.ndarray) -> np.ndarray:
    """Normalised correlation at every shift that keeps the glyph inside: sum (2t-1)*o over sum max(0, 2t-1), by FFT."""
    signed = 2 * glyph - 1
    full = (page.shape[0] + glyph.shape[0] - 1, page.shape[1] + glyph.shape[1] - 1)
    both = np.fft.irfft2(np.fft.rfft2(page, full) * np.fft.rfft2(signed[::-1, ::-1], full), full)
    norm = np.maximum(0, signed).sum() or 1.0
    return both[glyph.shape[0] - 1 : page.shape[0], glyph.shape[1] - 1 : page.shape[1]] / norm


def template_match(pages: DataFrame, key: str, px: str, width: int, glyphs: list[tuple[str, np.ndarray]], threshold: float = 0.7) -> DataFrame:
    """key, glyph, corr, dx, dy of the best shift of each glyph, if it reaches the threshold. glyphs: a font, of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, p in zip(batch[key], batch[px], strict=True):
                page = np.asarray(p, float).reshape(-1, width)
                for name, g in glyphs:
                    c = np.round(correlate(page, g), 9)
                    y, x = np.unravel_index(c.argmax(), c.shape)
                    if c[y, x] >= threshold:
                        rows.append((k, name, float(c[y, x]), int(x), int(y)))
            yield pd.DataFrame(rows, columns=[key, "glyph", "corr", "dx", "dy"])

    return pages.select(key, px).mapInPandas(run, f"{key} long, glyph string, corr double, dx int, dy int")


def composite(placed: DataFrame, by: list[str], x: Column, y: Column, ink_: Column) -> DataFrame:
    """Sum of ink by place."""
    return placed.select(*by, x.alias("x"), y.alias("y"), ink_.alias("ink")).groupBy(*by, "x", "y").agg(F.sum("ink").alias("ink"))


def normalise_ink(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Minimum to 0 and maximum to 1 in each group; 0 where they are equal."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("norm", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0)))


def shelf_pack(sizes: list[tuple[str, int, int]], width: int = 1400, gutter: int = 10) -> list[tuple[str, int, int]]:
    """Places glyphs (key, width, height) on shelves from left to right; a full shelf starts the next below its tallest."""
    out, x, y, tall = [], 0, 0, 0
    for key, w, h in sizes:
        if x and x + w > width:
            x, y, tall = 0, y + tall + gutter, 0
        out.append((key, x, y))
        x, tall = x + w + gutter, max(tall, h)
    return out
