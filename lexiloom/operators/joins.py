"""Ordered joins: as-of, ceiling, band and ordinal."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, at: str, keep: list[str], forward: bool = False) -> DataFrame:
    """Left rows with the right row that was last (or comes first, forward) at or before their place; by keeps groups apart.

    One union and one window: the right rows are marks that are carried along the order, so each row is shuffled once.
    Of right rows at one place, the one with the largest values (smallest, forward) counts.
    """
    mark = F.struct(at, *keep)
    none = F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType)
    rows = left.withColumns({"_mark": none, "_side": F.lit(1)}).unionByName(
        right.select(by, at, mark.alias("_mark"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    tie = F.col("_mark").asc_nulls_last()
    if forward:
        w = Window.partitionBy(by).orderBy(at, F.desc("_side"), tie).rowsBetween(0, Window.unboundedFollowing)
        found = F.first("_mark", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(by).orderBy(at, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_mark", ignorenulls=True).over(w)
    out = rows.withColumn("_found", found).where("_side = 1")
    names = {c: F.col(f"_found.{c}") for c in keep} | {f"{at}_found": F.col(f"_found.{at}")}
    return out.withColumns(names).drop("_mark", "_side", "_found")


def with_buckets(rows: DataFrame, at: str, width: float, reach: float) -> DataFrame:
    """A row for each bucket of the given width that at ± reach touches."""
    low, high = F.floor((F.col(at) - reach) / width), F.floor((F.col(at) + reach) / width)
    return rows.withColumn("_bucket", F.explode(F.sequence(low.cast("long"), high.cast("long"))))


def band(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, reach: float) -> DataFrame:
    """Pairs of one group whose places differ by at most reach, as an equi-join on buckets twice as wide as the reach."""
    width = max(2 * reach, 1e-9)
    a = with_buckets(left, left_at, width, reach)
    b = right.withColumn("_bucket", F.floor(F.col(right_at) / width).cast("long")).withColumnRenamed(by, "_by")
    on = (a[by] == b["_by"]) & (a["_bucket"] == b["_bucket"]) & (F.abs(a[left_at] - b[right_at]) <= reach)
    return a.join(b, on).drop(b["_bucket"]).drop("_by", "_bucket")


def band_semi(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, reach: float, key: str) -> DataFrame:
    """Left rows with any right row in the band."""
    width = max(2 * reach, 1e-9)
    hit = with_buckets(left, left_at, width, reach).alias("a").join(
        right.select(F.col(by).alias("_by"), F.col(right_at).alias("_at"), F.floor(F.col(right_at) / width).cast("long").alias("_b")),
        (F.col(f"a.{by}") == F.col("_by")) & (F.col("_bucket") == F.col("_b")) & (F.abs(F.col(left_at) - F.col("_at")) <= reach), "left_semi",
    )
    return left.join(hit.select(key).distinct(), key, "left_semi")


def nearest(pairs: DataFrame, key: str, distance: Column, *ties: Column) -> DataFrame:
    """Of each key's pairs the nearest one, then by ties."""
    w = Window.partitionBy(key).orderBy(distance, *ties)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ordinal_zip(left: DataFrame, right: DataFrame, by: str, left_order: str, right_order: str) -> DataFrame:
    """k-th left row of a group with its k-th right row; missing ones are null."""
    number = lambda d, o: d.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(o)))
    return number(left, left_order).join(number(right, right_order), [by, "k"], "left")


def alias_roots(aliases: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """src with the root at the end of its chain, by pointer doubling; keys on a cycle, or that lead to one, have root null.

    The aliases are counted first: no chain is longer than their number, so its logarithm bounds the rounds.
    """
    edges = aliases.select(F.col(src).alias("src"), F.col(dst).alias("root"))
    heads = edges
    for _ in range(max(1, edges.count().bit_length())):
        nxt = heads.select(F.col("src").alias("_s"), F.col("root").alias("_r"))
        heads = heads.join(nxt, heads["root"] == nxt["_s"], "left").select("src", F.coalesce("_r", "root").alias("root"))
    inner = aliases.select(F.col(src).alias("_s"))
    return heads.join(inner, heads["root"] == inner["_s"], "left").select("src", F.when(F.col("_s").isNull(), F.col("root")).alias("root"))


#: Rows that are looked at for common shingles, and in how many of them a shingle is common. They set the order of shingles, no result.
SAMPLE, COMMON = 5000, 3
#: Bits of the filter that keeps rows without candidates out of the joins; its size is fixed, so it only gets less sharp.
FILTER_BITS = 1 << 24
#: Distinct words whose hashes a worker keeps.
WORDS_KEPT = 1 << 18


class _Shingles:
    """The distinct 64-bit hashes of a text's runs of words, in order; words are separated by ASCII white space."""

    def __init__(self, words: int):
        self.known: dict[bytes, int] = {}
        self.factors = np.random.default_rng(7).integers(0, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: bytes) -> np.ndarray:
        words, n = text.split(), len(self.factors)
        if len(words) < n:
            return np.empty(0, np.uint64)
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        out = sum(h[k : len(h) - n + 1 + k] * f for k, f in enumerate(self.factors))
        out ^= out >> np.uint64(29)
        return np.unique(out * self.factors[0])


def _alike(x: np.ndarray, y: np.ndarray, tenths: int) -> bool:
    """Whether two sets of hashes, neither empty, share tenths/10 of their union."""
    if 10 * min(len(x), len(y)) < tenths * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 10 * both >= tenths * (len(x) + len(y) - both)


def only(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows, without most of those whose key is not among ids (one column), by a filter of fixed size."""
    name = ids.columns[0]
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    got = ids.groupBy((slot(name) / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(`{name}`), {FILTER_BITS}L), 64) as int))")).alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    bits = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            kept = batch.filter(pa.array((bits.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) > 0))
            yield kept.select(range(batch.num_columns - 1))

    return rows.withColumn("_slot", slot(key)).mapInArrow(run, rows.schema)


def with_texts(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (first, later) with their texts a and b. Only texts of rows in pairs are shuffled."""
    n = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    t = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    heads = only(t, "k", pairs.select("first")).toDF("first", "a")
    tails = only(t, "k", pairs.select("later")).toDF("later", "b")
    return pairs.join(heads, "first").repartition(n, "later").join(tails.repartition(n, "later"), "later").select("first", "later", "a", "b")


def copy_pairs(docs: DataFrame, key: str, text: str = "text", words: int = 5, tenths: int = 8) -> DataFrame:
    """first and later: each row with the least row that is a near copy of it by word shingles, at most one pair a row.

    Of two texts whose sets of shingles are alike by tenths/10, in any fixed order of shingles each holds one of the other's among its own
    first n - ceil(n*tenths/10) + 1. The order is by hash, those that a sample shows to be common last. Holders of a shingle are candidates:
    the least one first, then, for rows that may have a lesser copy than the best found, windows of further holders until none is left. Candidates are compared over all shingles, so the least near copy is found whatever else holds its shingles.
    Texts of fewer words, and null ones, have no pairs."""
    from .stats import checkpointed

    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).where("id is not null and t is not null")

    def hashes(order: bool, common: np.ndarray | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles = _Shingles(words)
            for batch in batches:
                parts, sizes, whole = [], [], []
                for t in batch.column(1):
                    h = shingles(t.as_py())
                    whole.append(len(h))
                    if order and len(h):
                        late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)
                        h = np.concatenate([h[~late], h[late]])[: len(h) - -(-len(h) * tenths // 10) + 1]
                    parts.append(h)
                    sizes.append(len(h))
                at = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if len(at) else at
                columns = [np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64), np.array(whole, np.int32)[at], place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), batch.column(0).take(pa.array(at)), *map(pa.array, columns[1:])], ["h", "id", "n", "p"])

        return run

    raw = rows.select("id", F.col("t").cast("binary").alias("t"))
    share = max(1, rows.count() // SAMPLE)
    seen = raw.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).mapInArrow(hashes(False), f"h long, id {kind}, n int, p int").select("h")
    common = np.sort(seen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).select("h").toPandas()["h"].to_numpy().astype(np.int64).view(np.uint64))
    held = raw.mapInArrow(hashes(True, common), f"h long, id {kind}, n int, p int")
    groups = checkpointed(held.groupBy("h").agg(F.collect_list(F.struct("id", "n", "p")).alias("ids")).where("size(ids) > 1").select(F.sort_array("ids").alias("ids")))
    most = groups.agg(F.max(F.size("ids"))).first()[0] or 0
    # the first shingle that two alike rows share leaves enough of both behind it, and their sizes are alike
    fit = f"f.id < l.id and 10 * least(f.n, l.n) >= {tenths} * greatest(f.n, l.n) and {10 + tenths} * least(f.n - f.p, l.n - l.p) >= {tenths} * (f.n + l.n)"
    lowest = checkpointed(groups.select(F.col("ids")[0]["id"].alias("f"), F.explode(F.expr("slice(ids, 2, size(ids))")).alias("l")).groupBy(F.col("l.id").alias("later")).agg(F.min("f").alias("lowest")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(words)
        for batch in batches:
            ok, known = [], lru_cache(8)(shingles)
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                x, y = p.as_py().encode(), q.as_py().encode()
                ok.append(len(known(x)) > 0 if x == y else _alike(known(x), known(y), tenths))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["first", "later", "ok"])

    def tried(pairs: DataFrame) -> DataFrame:
        return checkpointed(with_texts(pairs, rows, "id", "t").mapInArrow(verify, f"first {kind}, later {kind}, ok boolean"))

    done, low, high = None, 0, 1
    while done is None or low + 1 < most:
        window = groups.where(F.size("ids") > low + 1).select(F.slice("ids", low + 1, high - low).alias("w"), F.explode(F.expr(f"slice(ids, {low + 2}, size(ids))")).alias("l"))
        if done is None:
            new = checkpointed(window.select("l", F.explode("w").alias("f")).where(fit).select(F.col("f.id").alias("first"), F.col("l.id").alias("later")).distinct())
            done = tried(new)
        else:
            best = done.groupBy("later").agg(F.min(F.when(F.col("ok"), F.col("first"))).alias("best"))
            open_ = checkpointed(lowest.join(best, "later", "left").where("best is null or lowest < best").select("later", "best"))
            pairs = window.select("l", F.explode("w").alias("f")).where(fit).select(F.col("f.id").alias("first"), F.col("l.id").alias("later")).distinct()
            more = pairs.join(open_, "later").where("best is null or first < best").select("first", "later")
            new = checkpointed(more.join(done.select("first", "later"), ["first", "later"], "left_anti"))
            done = checkpointed(done.union(tried(new)))
        low, high = high, max(64, 8 * high)
    least = done.where("ok").groupBy("later").agg(F.min("first").alias("first"))
    return least.select("first", "later")
