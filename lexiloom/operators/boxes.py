"""Glyph boxes in reading order: lines, spaces, fills, intervals, clusters, suppression, edits and styles.

A boxes table has page_no, box_no (the order), chr, style, var, degenerate, corr and the edges l, r, t, b.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The codes of a space, a line end and an unknown glyph.
SPACE, NEWLINE, UNKNOWN = " ", "\\n", "??"


def line_ids(rows: DataFrame, by: list[str], order: str, is_break: Column) -> DataFrame:
    """line_no: how many breaks came before; a break belongs to the line that it ends."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("line_no", F.coalesce(F.sum(is_break.cast("int")).over(w), F.lit(0)).cast("long"))


def insert_gaps(rows: DataFrame, by: str, order: list[str], gap: Column, symbol: str, space: str) -> DataFrame:
    """Each row, and before it a row of the space symbol where gap (which may look back through lag) is true."""
    return rows.withColumn("_gap", F.coalesce(gap, F.lit(False))).withColumn("_part", F.explode(F.when(F.col("_gap"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))).withColumn("inserted", F.col("_part") == 0).withColumn(symbol, F.when(F.col("_part") == 0, F.lit(space)).otherwise(F.col(symbol))).drop("_gap", "_part")


def fill(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """filled_down: the last known value; filled_up: the next known one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({
        "filled_down": F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "filled_up": F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })


def merge_intervals(rows: DataFrame, by: list[str], low: str, high: str, gap: float = 0) -> DataFrame:
    """Islands of intervals that overlap or lie at most gap apart: by, island (from 1), low, high and n."""
    w = Window.partitionBy(*by).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(low) > reach + gap, F.lit(True)).cast("int")
    rows = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return rows.groupBy(*by, "island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("n"))


def occupancy(rows: DataFrame, low: str, high: str) -> DataFrame:
    """y and n: how many intervals cover each whole number, from the changes at the ends, not from every covered cell."""
    ends = rows.select(F.col(low).alias("y"), F.lit(1).alias("d")).union(rows.select((F.col(high) + 1).alias("y"), F.lit(-1).alias("d")))
    steps = ends.groupBy("y").agg(F.sum("d").alias("d")).where("d <> 0")
    w = Window.orderBy("y")  # one row for each distinct end: the height of a page
    runs = steps.withColumns({"n": F.sum("d").over(w), "next": F.lead("y").over(w)}).where("n > 0")
    return runs.select(F.explode(F.sequence("y", F.col("next") - 1)).alias("y"), F.col("n").cast("long").alias("n"))


def dbscan_1d(rows: DataFrame, by: list[str], value: str, eps: float) -> DataFrame:
    """cluster (from 1; 0 is noise) of each row for at least two points a cluster: a gap of eps or more separates."""
    w = Window.partitionBy(*by).orderBy(value)
    rows = rows.withColumn("_gap", F.col(value) - F.lag(value).over(w)).withColumn("_run", F.sum(F.when(F.col("_gap") < eps, 0).otherwise(1)).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, "_run"))
    rows = rows.withColumn("_size", size)
    starts = F.when((F.col("_size") > 1) & (F.coalesce(F.col("_gap"), F.lit(eps)) >= eps), 1).otherwise(0)
    return rows.withColumn("_no", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("cluster", F.when(F.col("_size") > 1, F.max("_no").over(Window.partitionBy(*by, "_run"))).otherwise(0).cast("long")).drop("_gap", "_run", "_size", "_no")


def near_pairs(rows: DataFrame, key: str, vector: str, eps: float, blocks: int = 32) -> DataFrame:
    """Pairs (a < b) of mean absolute difference under eps. Vectors meet in pairs of blocks, each one matrix computation.

    Every block goes to blocks tasks, so each task holds two blocks, whatever the number of rows; raise blocks with the data.
    """
    numbered = rows.select(key, vector).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j")))
    spread = numbered.select(key, vector, "_b", F.explode(places).alias("p")).select(key, vector, "_b", "p.*")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        x, y = group[group["_b"] == i], group[group["_b"] == j]
        out: list[tuple] = []
        if len(x) and len(y):
            ym, yk = np.stack(y[vector].to_numpy()).astype(np.float64), y[key].to_numpy()
            for k, v in zip(x[key], x[vector], strict=True):
                d = np.abs(ym - np.asarray(v, np.float64)).mean(axis=1)
                hit = yk[d < eps]
                out += [(min(k, h), max(k, h)) for h in hit if (k < h if i == j else True)]
        return pd.DataFrame(out, columns=["a", "b"])

    kind = rows.schema[key].dataType.simpleString()
    return spread.groupBy("i", "j").applyInPandas(run, f"a {kind}, b {kind}")


#: Vectors that every other one is compared with first, and vectors of a block.
HUB, BLOCK = 1 << 12, 1 << 14


def _close(x: np.ndarray, v: np.ndarray, eps: float) -> np.ndarray:
    """Places in x (rows of numbers) whose mean absolute difference from v is under eps. Plain sums decide but for those near the limit,
    which are added up anew in 64 bits, in order."""
    sums = np.abs(x - v).sum(axis=1)
    limit, n = eps * x.shape[1], x.shape[1]
    slack = 1e-6 * n * (1 + limit)
    sure, doubt = sums < limit - slack, np.flatnonzero(np.abs(sums - limit) <= slack)
    if len(doubt):
        sure[doubt] = np.cumsum(np.abs(x[doubt].astype(np.float64) - v.astype(np.float64)), axis=1)[:, -1] / n < eps
    return np.flatnonzero(sure)


def _grown(x: np.ndarray, keys: np.ndarray, eps: float) -> np.ndarray:
    """The first row of each row's component, by search: a row that is reached is not compared again. Rows of one key are not linked."""
    comp, rest = np.full(len(x), -1), np.arange(len(x))
    while len(rest):
        first, rest = rest[0], rest[1:]
        comp[first], todo = first, [first]
        while todo and len(rest):
            i = todo.pop()
            hit = _close(x[rest], x[i], eps)
            hit = hit[keys[rest[hit]] != keys[i]]
            found = rest[hit]
            comp[found] = first
            todo += found.tolist()
            rest = np.delete(rest, hit)
    return comp


def near_links(rows: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """Pairs (a, b) that connect what all links connect, those of mean absolute difference under eps; null vectors have none. A pair
    need not be a link itself: a component that a task knows is a star, so that labels spread over it in one step.

    A hub of HUB rows is searched whole, and its largest component is the core. Each other row is compared with the core until one link
    is found. Rows without one, the rest, are compared with all rows, blocks of them with blocks: a link that isn't looked for has both
    its ends in the core's component. So the work is that of all pairs only if no large component exists."""
    from .stats import checkpointed

    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    array = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    table = rows.select(F.col(key).alias("k"), F.col(vector).cast(array).alias("v")).where("k is not null and v is not null")
    order = F.xxhash64("k", "v")
    hub = table.orderBy(order, "k").limit(HUB).toPandas()
    if not len(hub):
        return spark.createDataFrame([], f"a {kind}, b {kind}")
    matrix = lambda v: np.stack(v.to_numpy()).astype(np.float32 if array == "array<float>" else np.float64)
    x, keys = matrix(hub["v"]), hub["k"].to_numpy()
    comp = _grown(x, keys, eps)
    core = np.flatnonzero(comp == np.bincount(comp).argmax())
    inner = {x[i].tobytes() + str(keys[i]).encode() for i in core}
    centre = keys[core].min()
    shared = spark.sparkContext.broadcast((x[core], keys[core], inner, centre))

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row, whether it is of the core, and the core's least key if it is or has a link to the core; null for the rest."""
        cx, ck, own, centre = shared.value
        for batch in batches:
            if not len(batch):
                continue
            to, inside = [], []
            for k, v in zip(batch["k"], matrix(batch["v"]), strict=True):
                inside.append(v.tobytes() + str(k).encode() in own)
                to.append(centre if inside[-1] else None)
                for low in range(0, 0 if inside[-1] else len(cx), 512):
                    hit = _close(cx[low : low + 512], v, eps)
                    hit = hit[ck[low : low + 512][hit] != k]
                    if len(hit):
                        to[-1] = centre
                        break
            yield pd.DataFrame({"k": batch["k"].to_numpy(), "v": batch["v"], "core": inside, "link": pd.Series(to, dtype=object)})

    sought = checkpointed(table.mapInPandas(seek, f"k {kind}, v {array}, core boolean, link {kind}").withColumn("rest", F.expr("link is null")))
    n, left = sought.agg(F.count(F.lit(1)), F.count_if("rest")).first()
    linked = sought.where("link is not null and link <> k").select(F.col("k").alias("a"), F.col("link").alias("b"))
    if not left:
        return linked
    wide = max(-(-n // BLOCK), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    high = -(-left // BLOCK)
    spread = lambda m: F.pmod(order, F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rest = sought.where("rest").select("k", "v", "rest", F.lit(0).alias("side"), spread(high).alias("i"), every(wide).alias("j"))
    all_ = sought.select("k", "v", "rest", F.lit(1).alias("side"), spread(wide).alias("j"), every(high).alias("i")).select("k", "v", "rest", "side", "i", "j")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        """The components within the rest that this block shows, as stars, and the core's least key for rows with a link to what has it."""
        a, b = group[group["side"] == 0], group[group["side"] == 1]
        out: list[tuple] = []
        if len(a) and len(b):
            bx, bk, open_ = matrix(b["v"]), b["k"].to_numpy(), b["rest"].to_numpy()
            root: dict = {}

            def find(z):
                while root.setdefault(z, z) != z:
                    root[z] = root[root[z]]
                    z = root[z]
                return z

            for k, v in zip(a["k"], matrix(a["v"]), strict=True):
                hit = _close(bx, v, eps)
                hit = hit[bk[hit] != k]
                out += [] if open_[hit].all() else [(k, shared.value[3])]
                for h in bk[hit[open_[hit]]]:
                    p, q = find(k), find(h)
                    root[max(p, q)] = min(p, q)
            out += [(z, find(z)) for z in list(root) if find(z) != z]
        return pd.DataFrame(out, columns=["a", "b"])

    met = rest.unionByName(all_).groupBy("i", "j").applyInPandas(meet, f"a {kind}, b {kind}")
    return linked.union(met)


def near_components(rows: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """node and comp, the least key of its component, of all rows that have another within eps."""
    from .stats import components

    return components(near_links(rows, key, vector, eps))


def nms(rows: DataFrame, by: list[str], score: str, key: str, share: float = 0.25) -> DataFrame:
    """Greedy by falling score: a box goes if it overlaps a kept one by more than share of the smaller area. Ties: t, l, key."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values([score, "t", "l", key], ascending=[False, True, True, True])
        l, r, t, b = (g[c].to_numpy(np.float64) for c in ("l", "r", "t", "b"))  # noqa: E741
        area, keep = (r - l) * (b - t), []
        for i in range(len(g)):
            k = np.array(keep, int)
            over = np.maximum(0, np.minimum(r[k], r[i]) - np.maximum(l[k], l[i])) * np.maximum(0, np.minimum(b[k], b[i]) - np.maximum(t[k], t[i]))
            if not (over > share * np.minimum(area[k], area[i])).any():
                keep.append(i)
        return g.iloc[keep]

    return rows.groupBy(*by).applyInPandas(run, rows.schema)


def peak_suppress(rows: DataFrame, by: list[str], score: str, key: str, reach: int = 9) -> DataFrame:
    """Strongest first: a point goes if a kept one lies within reach in both directions. x, y; ties by key."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values([score, key], ascending=[False, True])
        x, y, keep = g["x"].to_numpy(), g["y"].to_numpy(), []
        for i in range(len(g)):
            k = np.array(keep, int)
            if not ((np.abs(x[k] - x[i]) <= reach) & (np.abs(y[k] - y[i]) <= reach)).any():
                keep.append(i)
        return g.iloc[keep]

    return rows.groupBy(*by).applyInPandas(run, rows.schema)


def line_top(rows: DataFrame, by: list[str], top: str, corr: str) -> DataFrame:
    """Median top (lower rule) of the better half by corr, then top."""
    from .stats import quantile_lower

    w = Window.partitionBy(*by)
    ranked = rows.withColumns({"_k": F.row_number().over(w.orderBy(corr, top)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return quantile_lower(ranked.where(F.col("_k") >= F.floor(F.col("_n") / 2)), by, top, 0.5)


def interpolate_spots(spots: DataFrame, good: DataFrame, by: str, x: str) -> DataFrame:
    """For each spot the mean _top of its line's reliable boxes (_by, _x, _top, _c), weighted by _c/100 and min(1, 10/dx²)."""
    dx2 = F.pow(F.col(x) - F.col("_x"), 2)
    w = F.col("_c") / 100 * F.when(dx2 <= 10, 1.0).otherwise(F.lit(10.0) / dx2)
    return spots.join(good, F.col(by) == F.col("_by"), "left").groupBy(by, x).agg((F.sum(w * F.col("_top")) / F.sum(w)).alias("top_i"))


def interpolate_top(rows: DataFrame, by: str, x: str, top: str, corr: str, least: float = 60) -> DataFrame:
    """Rows of corr up to least, and the others, with the interpolated top of their line; null without a reliable box."""
    good = rows.where(F.col(corr) > least).select(F.col(by).alias("_by"), F.col(x).alias("_x"), F.col(top).alias("_top"), F.col(corr).alias("_c"))
    return interpolate_spots(rows.select(by, x).distinct(), good, by, x)


def toggle_style(rows: DataFrame, by: list[str], selected: Column, style: str, bit: int) -> DataFrame:
    """Clears a style bit of the selected rows if all of them have it, else sets it."""
    has = F.col(style).bitwiseAND(F.lit(bit)) != 0
    every = F.bool_and(F.when(selected, has)).over(Window.partitionBy(*by))
    new = F.when(every, F.col(style).bitwiseAND(F.lit(~bit))).otherwise(F.col(style).bitwiseOR(F.lit(bit)))
    return rows.withColumn(style, F.when(selected, new).otherwise(F.col(style)))


def reclassify(rows: DataFrame, selected: Column, **new: str | int | None) -> DataFrame:
    """Overwrites the given columns of selected rows, but for empty values."""
    return rows.withColumns({c: F.when(selected, F.lit(v)).otherwise(F.col(c)) for c, v in new.items() if v not in (None, "")})


def merge_boxes(rows: DataFrame, by: list[str], order: str, with_next: Column, chr_: str = "chr") -> DataFrame:
    """Rows with with_next join the row after them: texts concatenate, edges unite, the class is the first row's."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = ~F.coalesce(F.lag(with_next).over(w), F.lit(False))
    grouped = rows.withColumn("_g", F.sum(starts.cast("int")).over(w))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(chr_).alias("c"))))
    return grouped.groupBy(*by, "_g").agg(F.min(order).alias(order), F.array_join(F.transform(items, lambda i: i["c"]), "").alias(chr_), F.min("l").alias("l"), F.max("r").alias("r"), F.min("t").alias("t"), F.max("b").alias("b")).drop("_g")


def split_boxes(rows: DataFrame, chr_: str = "chr") -> DataFrame:
    """Each box becomes two: its first character and the rest (unknown if there is none), cut at the first character's share."""
    n = F.length(chr_)
    cut = (F.col("l") + F.floor((F.col("r") - F.col("l")) / F.greatest(F.lit(2), n))).cast("long")
    rest = F.when(n > 1, F.substring(F.col(chr_), F.lit(2), n)).otherwise(F.lit(UNKNOWN))
    part = lambda k, c, l, r: F.struct(F.lit(k).alias("part"), c.alias("c"), l.cast("long").alias("pl"), r.cast("long").alias("pr"))  # noqa: E731, E741
    both = F.array(part(0, F.substring(chr_, 1, 1), F.col("l"), cut), part(1, rest, cut, F.col("r")))
    return rows.withColumn("_p", F.explode(both)).withColumns({chr_: F.col("_p.c"), "part": F.col("_p.part"), "l": F.col("_p.pl"), "r": F.col("_p.pr")}).drop("_p")


def resize(rows: DataFrame, selected: Column, dl: int = 0, dr: int = 0, dt: int = 0, db: int = 0) -> DataFrame:
    return rows.withColumns({c: F.when(selected, F.col(c) + d).otherwise(F.col(c)) for c, d in (("l", dl), ("r", dr), ("t", dt), ("b", db))})


def sane(width: int, height: int) -> Column:
    return (F.col("l") >= 0) & (F.col("t") >= 0) & (F.col("r") <= width) & (F.col("b") <= height) & (F.col("l") < F.col("r")) & (F.col("t") < F.col("b"))


def confident(corr: str, chr_: str, low: float = 20, punctuation: float = 40) -> Column:
    """Rows that stay: corr of at least low, and of punctuation for commas and stops."""
    return (F.col(corr) >= low) & ~((F.col(corr) < punctuation) & F.col(chr_).isin(",", "."))


def decode_prefix(rows: DataFrame, key: str, text: str, prefixes: dict[str, int]) -> DataFrame:
    """The leading prefix characters as the or of their bits, and the rest of the text."""
    chars = "".join(prefixes)
    head = F.regexp_extract(text, f"^[{chars}]*", 0)
    bits = F.lit(0)
    for c, b in prefixes.items():
        bits = bits.bitwiseOR(F.when(head.contains(c), F.lit(b)).otherwise(F.lit(0)))
    return rows.select(key, bits.alias("style"), F.substring(F.col(text), F.length(head) + 1, F.length(text)).alias("rest"))


def encode_prefix(style: Column, prefixes: dict[str, int]) -> Column:
    return F.concat(*[F.when(style.bitwiseAND(F.lit(b)) != 0, F.lit(c)).otherwise(F.lit("")) for c, b in prefixes.items()])


def text_of_boxes(rows: DataFrame, by: list[str], order: str, chr_: str = "chr") -> DataFrame:
    """The text of each group's boxes in order, line ends as newlines."""
    c = F.when(F.col(chr_) == NEWLINE, F.lit("\n")).otherwise(F.col(chr_))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), c.alias("c"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(items, lambda i: i["c"]), "").alias("text"))


def style_paths(tokens: DataFrame, by: str, order: str, candidates: str) -> DataFrame:
    """For each group the choice of one candidate style a position with the least sum of bit changes, by dynamic programming.

    candidates is an array of integers. Of equal sums the path of the smallest styles counts. Returns by, path and cost.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, tuple[int, tuple]] = {}
        for options in group.sort_values(order)[candidates]:
            options = sorted({int(o) for o in options})
            if not best:
                best = {o: (0, (o,)) for o in options}
            else:
                best = {o: min((c + (p ^ o).bit_count(), (*path, o)) for p, (c, path) in best.items()) for o in options}
        cost, path = min(best.values(), default=(0, ()))
        return pd.DataFrame({by: [group[by].iloc[0]], "path": [list(path)], "cost": [cost]})

    kind = tokens.schema[by].dataType.simpleString()
    return tokens.groupBy(by).applyInPandas(run, f"{by} {kind}, path array<int>, cost int")


def eliminate_overlaps(rows: DataFrame, by: list[str], order: str | list[str], bands: tuple = ((0.8, 0), (0.5, 10), (0.25, 30))) -> DataFrame:
    """Goes through neighbours in order; of two that share more of the narrower one's width than a band's share, at a difference of
    corr of at least the band's, the weaker goes, and the survivor meets the next."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order, kind="stable")
        keep: list[int] = []
        places = list(zip(*(g[c].tolist() for c in ("l", "r", "corr")), strict=True))
        for i, (l, r, corr) in enumerate(places):  # noqa: E741
            if keep:
                left, right, known = places[keep[-1]]
                shared, width = min(right, r) - max(left, l), max(1, min(right - left, r - l))
                if any(shared > s * width and abs(known - corr) >= d for s, d in bands):
                    keep[-1] = i if corr > known else keep[-1]
                    continue
            keep.append(i)
        return g.iloc[keep]

    return rows.groupBy(*by).applyInPandas(run, rows.schema)


def relocate(rows: DataFrame, glyphs: DataFrame, selected: Column, x: int, y: int, key: list[str]) -> DataFrame:
    """Selected boxes move to a centre, with their glyph's size if the font (bounded) has it, and are marked as helped."""
    sized = rows.join(F.broadcast(glyphs.select(*key, F.col("w").alias("_w"), F.col("h").alias("_h"))), key, "left")
    w, h = F.coalesce("_w", F.col("r") - F.col("l")), F.coalesce("_h", F.col("b") - F.col("t"))
    left, top = F.lit(x) - F.floor(w / 2), F.lit(y) - F.floor(h / 2)
    new = {"l": left, "t": top, "r": left + w, "b": top + h}
    moved = sized.withColumns({f"_{c}": F.when(selected, v).otherwise(F.col(c)).cast("long") for c, v in new.items()} | {"helped": selected})
    return moved.drop(*new, "_w", "_h").withColumnsRenamed({f"_{c}": c for c in new})


def paste_after(rows: DataFrame, new: DataFrame, by: list[str], order: str, after: Column) -> DataFrame:
    """New rows (without order) stand after the first row for which after holds; the order counts anew from 1."""
    place = rows.where(after).groupBy(*by).agg(F.min(order).alias("_at"))
    put = new.join(place, by).withColumn("_k", F.lit(1)).withColumn(order, F.col("_at")).drop("_at")
    both = rows.withColumn("_k", F.lit(0)).unionByName(put)
    w = Window.partitionBy(*by).orderBy(order, "_k")
    return both.withColumn("_n", F.row_number().over(w)).withColumn(order, F.col("_n").cast(rows.schema[order].dataType)).drop("_n", "_k")


def agreement(left: DataFrame, right: DataFrame, by: list[str], order: str, symbol: str) -> DataFrame:
    """by and n: how many leading symbols of both sequences agree; order counts from 1 without gaps."""
    r = right.select(*by, order, F.col(symbol).alias("_s"))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = left.join(r, [*by, order], "left").withColumn("_ok", F.bool_and(F.coalesce(F.col(symbol) == F.col("_s"), F.lit(False))).over(w))
    return same.groupBy(*by).agg(F.count_if("_ok").alias("n"))


def resync(old: DataFrame, new: DataFrame, order: str, key: list[str]) -> DataFrame:
    """For each new row the first old row, at or after its place, with equal key columns; null without one."""
    o = old.select(F.col(order).alias("_o"), *[F.col(k).alias(f"_{k}") for k in key])
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("_o") >= F.col(order)]
    return new.join(o, on, "left").groupBy(order, *key).agg(F.min("_o").alias("old_no"))


def unnest_styles(chars: list[tuple[str, int]], tags: dict[int, str]) -> str:
    """Characters with style bits as properly nested tags: to close one, those inside close and open again."""
    out, stack = [], []
    for c, style in [*chars, ("", 0)]:
        while any(not style & b for b in stack):
            out.append(f"</{tags[stack.pop()]}>")
        for b in tags:
            if style & b and b not in stack:
                stack.append(b)
                out.append(f"<{tags[b]}>")
        out.append(c)
    return "".join(out)


def styled_text(rows: DataFrame, by: str, order: str, tags: dict[int, str]) -> DataFrame:
    """by and markup, from boxes with chr and style; one page's boxes meet in a task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        chars = [("\n" if c == NEWLINE else c, int(s)) for c, s in zip(g["chr"], g["style"], strict=True)]
        return pd.DataFrame({by: [g[by].iloc[0]], "markup": [unnest_styles(chars, tags)]})

    return rows.groupBy(by).applyInPandas(run, f"{by} {rows.schema[by].dataType.simpleString()}, markup string")


def export_lines(rows: DataFrame, page: str = "page_no") -> DataFrame:
    """Text and bounding box of every line, the last one too."""
    lined = line_ids(rows, [page], "box_no", F.col("chr") == NEWLINE).where(F.col("chr") != NEWLINE)
    items = F.array_sort(F.collect_list(F.struct("box_no", "chr")))
    solid = lambda c: F.when(F.col("chr") != SPACE, F.col(c))
    return lined.groupBy(page, "line_no").agg(F.array_join(F.transform(items, lambda i: i["chr"]), "").alias("text"), F.min(solid("l")).alias("l"), F.max(solid("r")).alias("r"), F.min(solid("t")).alias("t"), F.max(solid("b")).alias("b"))
