"""Counts, weighted statistics, quantiles, least squares and components over ordered rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unigrams(rows: DataFrame, by: list[str], symbol: str) -> DataFrame:
    return rows.groupBy(*by, symbol).agg(F.count(F.lit(1)).alias("n"))


def characters(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row for each character, with its place from 0."""
    return docs.select(*keep, F.posexplode(F.split(text, "")).alias("i", "ch"))


#: Characters whose pairs are counted together.
CHUNK = 1 << 20


def bigrams_of_text(docs: DataFrame, text: str = "text", skip: str = " ", line_end: str = "\n", cross_lines: bool = True) -> DataFrame:
    """l, r and n: neighbouring characters, counted inside the task before anything is shuffled. skip breaks a pair; a line end
    doesn't, so a line's last character and the next line's first are a pair, unless cross_lines is False."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = skip.join(t or "" for t in batch.column(0).to_pylist())
            whole = whole.replace(line_end, "" if cross_lines else skip)
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            for low in range(0, max(0, len(codes) - 1), CHUNK):
                part = codes[low : low + CHUNK + 1].astype(np.uint64)
                a, b = part[:-1], part[1:]
                on = (a != ord(skip)) & (b != ord(skip))
                pairs, n = np.unique(a[on] << np.uint64(32) | b[on], return_counts=True)
                sides = [[chr(x) for x in half.tolist()] for half in (pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF))]
                yield pa.RecordBatch.from_arrays([pa.array(sides[0], pa.string()), pa.array(sides[1], pa.string()), pa.array(n, pa.int64())], ["l", "r", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "l string, r string, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))


def sample_variance(x: str) -> Column:
    """Sample variance; 1 for a single value."""
    return F.when(F.count(x) == 1, 1.0).otherwise(F.var_samp(x))


def weighted_pair(rows: DataFrame, by: list[str], value: str, gap: str, full: float = 100.0) -> DataFrame:
    """Mean weighted by min(1, full/|gap|), and squares around it, unweighted, over the weights less one (1 if they are at most 1)."""
    w = F.when(F.col(gap) == 0, 1.0).otherwise(F.least(F.lit(1.0), full / F.abs(F.col(gap))))
    weighted = rows.withColumn("_w", w)
    means = weighted.groupBy(*by).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("wmean"))
    sums = weighted.join(means, by).groupBy(*by).agg(F.first("wmean").alias("wmean"), F.sum(F.pow(F.col(value) - F.col("wmean"), 2)).alias("sq"), F.sum("_w").alias("w"))
    return sums.select(*by, "wmean", F.when(F.col("w") <= 1, 1.0).otherwise(F.col("sq") / (F.col("w") - 1)).alias("pvar"))


def _ranked(rows: DataFrame, by: list[str], value: str, index: Column) -> DataFrame:
    w = Window.partitionBy(*by)
    ranked = rows.select(*by, value).withColumns({"_k": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("_k") == index).select(*by, F.col(value).alias("q"))


def quantile_lower(rows: DataFrame, by: list[str], value: str, at: float) -> DataFrame:
    """The value of index floor((n-1)*at)."""
    return _ranked(rows, by, value, F.floor((F.col("_n") - 1) * F.lit(at)))


def quantile_upper(rows: DataFrame, by: list[str], value: str, at: float) -> DataFrame:
    """The value of index floor(n*at), the last at most."""
    return _ranked(rows, by, value, F.least(F.floor(F.col("_n") * F.lit(at)), F.col("_n") - 1))


def hash_order(key: Column, seed: int = 42) -> Column:
    """A fixed random order, by a digest that any engine has."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def coverage_sample(units: DataFrame, unit: str, item: str, quota: int, seed: int = 42) -> DataFrame:
    """Units that hold, for each item, the first quota units in a fixed random order; so rare items keep all theirs.
    The limit on row numbers is applied in each task before the shuffle, so an item of every unit sends at most quota rows a task."""
    w = Window.partitionBy(item).orderBy(hash_order(F.col(unit), seed), unit)
    return units.select(unit, item).distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= quota).select(unit).distinct()


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows, kept in the shared folder named in spark.checkpoint.dir."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexiloom-"))
    return rows.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and comp, the least node of its component: minimum labels with pointer jumping, checkpointed each round, until no label
    changes."""
    both = checkpointed(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("comp").alias("root"))
        step = low.join(up, "new").select("node", "comp", F.least("new", "root").alias("new")).checkpoint()
        labels = step.select("node", F.col("new").alias("comp"))
        if step.where("new <> comp").isEmpty():
            return labels


def normal_equations(rows: DataFrame, row: str, col: str, value: str, target: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """A'WA as (i, j, v) and A'Wb as (i, v) from sparse rows (row, col, value, target, weight)."""
    r = rows.select(row, F.col(col).alias("i"), F.col(value).alias("vi"), target, weight)
    s = rows.select(row, F.col(col).alias("j"), F.col(value).alias("vj"))
    ata = r.join(s, row).groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj") * F.col(weight)).alias("v"))
    atb = r.groupBy("i").agg(F.sum(F.col("vi") * F.col(target) * F.col(weight)).alias("v"))
    return ata, atb


def least_squares(rows: DataFrame, row: str, col: str, value: str, target: str, weight: str, most: int = 5000) -> DataFrame:
    """col and x of the weighted least squares solution. The unknowns are counted first; more than most raise an error."""
    spark = rows.sparkSession
    unknowns = rows.select(col).distinct().count()
    if unknowns > most:
        raise ValueError(f"{unknowns} unknowns; the solver takes {most}")
    ata, atb = (d.toPandas() for d in normal_equations(rows, row, col, value, target, weight))
    names = sorted(set(ata["i"]))
    at = {n: k for k, n in enumerate(names)}
    m, v = np.zeros((len(names), len(names))), np.zeros(len(names))
    m[ata["i"].map(at), ata["j"].map(at)] = ata["v"]
    v[atb["i"].map(at)] = atb["v"]
    return spark.createDataFrame(pd.DataFrame({col: names, "x": np.linalg.solve(m, v)}))
