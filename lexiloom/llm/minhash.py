"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

A document is the multiset of its SHINGLE-word shingles. Weights are cut into dyadic intervals: [0,1), [1,2), [2,4), ...
Each (shingle, interval) owns a Poisson process of that interval's rate, whose points carry a time, a register and a height;
points above the weight are thinned out. A register keeps the earliest point over all shingles, so registers of two
documents agree with the probability of their weighted Jaccard similarity. Points are made in rounds, for all shingles
of a block of documents at once, until no shingle's next point can still change a register.

Equal word sequences are one text from the start. Bands of ROWS registers make buckets. First every text of a bucket is
tested exactly against the bucket's least one. Links unite classes, and a bucket of one class is done; in the others, blocks of
at most GROUP texts meet in pairs, one task computes all overlaps of a pair of blocks as one matrix product, and only the
links that unite classes leave it. So every pair that shares a bucket is tested or already in one class, and no task
or table holds the pairs of a group. Classes are the connected components of the verified links, by minimum labels with
pointer jumping over DataFrames.

Defined results: null text is empty; documents without words are copies of each other; a text under SHINGLE words is one
shingle; a null doc_id takes part in no class but its own, of null class_id; repeated rows share a class; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_lists, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Shingles of a block of documents that is signed at once.
BLOCK = 200_000
#: Texts of a bucket in a block, and their bytes.
GROUP, GROUP_BYTES = 500, 16 << 20
#: Bits of the filter that keeps texts without candidates out of the joins.
FILTER_BITS = 1 << 26

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S = [np.uint64(s) for s in (29, 32, 11, 40)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[1])) * _A
    x = (x ^ (x >> _S[0])) * _B
    return x ^ (x >> _S[1])


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _B + h[k : k + len(out)]
    return np.unique(_mix(out), return_counts=True)


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two multisets."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 1.0


def sign(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of registers (unsigned 32-bit) for each multiset; all ones where it is empty."""
    docs = len(bags)
    held = np.full(docs * registers, np.iinfo(np.uint64).max, np.uint64)
    sizes = [len(b[0]) for b in bags]
    h0, w0 = (np.concatenate([b[i] for b in bags]) for i in (0, 1)) if docs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    d0 = np.repeat(np.arange(docs), sizes)
    seeds, rates, weights, rows = [_mix(h0 ^ _C)], [np.ones(len(h0), np.float32)], [np.full(len(h0), np.inf, np.float32)], [d0]
    level, at = 1, w0 > 1
    old = np.seterr(over="ignore")
    while at.any():  # intervals [2^(level-1), 2^level); heights are relative to the lower end
        low = float(1 << (level - 1))
        seeds.append(_mix(h0[at] ^ (_C + np.uint64(level) * _A)))
        rates.append(np.full(at.sum(), low, np.float32))
        weights.append((w0[at] / low - 1).astype(np.float32))
        rows.append(d0[at])
        level += 1
        at = w0 > (1 << (level - 1))
    seed, rate, weight, row = map(np.concatenate, (seeds, rates, weights, rows))
    time = np.zeros(len(seed), np.float32)
    step = np.uint64(0)
    while len(seed):
        step += np.uint64(1)
        r = _mix(seed + step * _A)
        unit = ((r >> _S[3]).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
        time = time - np.log(unit) / rate
        r2 = _mix(r ^ _B)
        height = ((r2 >> _S[3]).astype(np.float32)) * np.float32(2.0**-24)
        inside = height < weight
        place = row * registers + ((r2 & np.uint64(0xFFFFFF)) % np.uint64(registers)).astype(np.int64)
        key = (time.view(np.uint32).astype(np.uint64) << _S[1]) | (r & np.uint64(0xFFFFFFFF))
        np.minimum.at(held, place[inside], key[inside])
        limit = held.reshape(docs, registers).max(axis=1)
        on = (time.view(np.uint32).astype(np.uint64) << _S[1]) <= limit[row]
        seed, rate, weight, row, time = seed[on], rate[on], weight[on], row[on], time[on]
    np.seterr(**old)
    return (held & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(docs, registers)


def bands(signatures: np.ndarray, n: int = BANDS) -> np.ndarray:
    """One 64-bit hash for each band and row."""
    s = signatures.reshape(len(signatures), n, -1).astype(np.uint64)
    out = np.zeros(s.shape[:2], np.uint64)
    for k in range(s.shape[2]):
        out = _mix(out * _A + s[:, :, k] + np.uint64(k + 1))
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (of the word sequence) and the hashes of the bands (null without words)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            keys, bags, size = [], [], 0

            def out() -> dict:
                got = bands(sign(bags)).astype(np.int64)  # noqa: B023
                return {"doc_id": [k[0] for k in keys], "text_key": [k[1] for k in keys], "bands": [got[i].tolist() if len(b[0]) else None for i, b in enumerate(bags)]}  # noqa: B023

            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = b" ".join((text or "").encode("utf-8", "replace").split())
                keys.append((key, xxhash.xxh3_128_hexdigest(words)))
                bags.append(shingles(text))
                size += len(bags[-1][0])
                if size > BLOCK:
                    yield out()
                    keys, bags, size = [], [], 0
            if keys:
                yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_lists(rows, run, "doc_id long, text_key string, bands array<long>")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents in ids; a fixed-size filter keeps most others from being shuffled."""
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    got = ids.select((slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(id), {FILTER_BITS}L), 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots = batch["slot"].to_numpy().astype(np.int64)
            yield batch[(shared.value[slots // 64] >> (slots % 64).astype(np.uint64)) & np.uint64(1) > 0]

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").withColumn("slot", slot)
    return rows.mapInPandas(run, rows.schema).drop("slot").groupBy("id").agg(F.max("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b and whether their overlap reaches the similarity; a pair's texts meet in one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bag = None, None
        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"], strict=True):
                if a != last:
                    last, bag = a, shingles(ta)
                ok.append(overlap(bag, shingles(tb)) >= similarity)
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "ok": ok})

    both = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a")
    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long, ok boolean")


def all_overlaps(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs; the k-th occurrence of a shingle is an element of its own."""
    n = len(bags)
    sizes = np.array([int(b[1].sum()) for b in bags], np.float64)
    shingle = np.concatenate([np.repeat(*b) for b in bags])
    nth = np.concatenate([np.arange(c) for b in bags for c in b[1].tolist()] or [np.zeros(0, np.int64)]).astype(np.uint64)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    _, element = np.unique(_mix(shingle + nth * _A), return_inverse=True)
    common, step = np.zeros((n, n)), 1 << 14
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    for low in range(0, int(element.max(initial=-1)) + 1, step):
        x, y = np.searchsorted(element, [low, low + step])
        m = np.zeros((n, step), np.float32)
        m[owner[x:y], element[x:y] - low] = 1
        common += m @ m.T
    both = sizes[:, None] + sizes[None, :] - common
    return np.divide(common, both, out=np.ones_like(common), where=both > 0)


def _uniting(group: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Of a pair of blocks, links between texts of different classes, no more than unite them."""
    group = group.drop_duplicates("id").sort_values("id")
    ids, classes = group["id"].tolist(), group["class"].tolist()
    root = {c: c for c in classes}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    if len(root) > 1:
        like = all_overlaps([shingles(t) for t in group["text"]])
        for i, j in zip(*np.nonzero(np.triu(like >= similarity, 1)), strict=True):
            x, y = find(classes[i]), find(classes[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def links(docs: DataFrame, buckets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: verified links between texts, enough to unite their classes, from bucket rows (band, hash, id)."""
    heads = buckets.groupBy("band", "hash").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = written(buckets.join(heads, ["band", "hash"]), "near-members")
    texts = written(_texts(docs, members.select("id").distinct()), "near-texts")
    pairs = members.where("id > a").select("a", F.col("id").alias("b")).distinct()
    first = written(verified(pairs, texts, similarity), "near-tested").where("ok").select("a", "b")
    labels = components(first)
    sizes = texts.select("id", F.octet_length("text").alias("size"))
    rows = members.select("band", "hash", "id").join(labels, "id", "left").join(sizes, "id").select("band", "hash", "id", "size", F.coalesce("label", "id").alias("class"))
    rows = written(rows, "near-rows")
    open_ = rows.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    blocks = F.ceil(F.greatest(F.col("n") / GROUP, F.col("size") / GROUP_BYTES)).cast("int")
    rest = rows.join(open_.select("band", "hash", blocks.alias("blocks")), ["band", "hash"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("band", "hash", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "class").join(texts, "id")
    more = rest.groupBy("band", "hash", "i", "j").applyInPandas(lambda g: _uniting(g, similarity), "a long, b long")
    return first.unionByName(written(more, "near-united"))


def components(edges: DataFrame) -> DataFrame:
    """id and label, the least id of its component, of all ids in edges (a, b)."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("label").alias("root"))
        jumped = written(lower.join(up, "new").select("id", F.least("new", "root").alias("new"), "label"), "labels")
        labels = jumped.select("id", F.col("new").alias("label"))
        if jumped.where("new <> label").isEmpty():
            return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, class_id (the least doc_id of the class) and representative, for every row."""
    rows = written(signed(docs), "signed")
    firsts = rows.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("id"))
    reps = rows.join(firsts, "text_key").where("doc_id = id and bands is not null").dropDuplicates(["id"])
    buckets = reps.select("id", F.posexplode("bands").alias("band", "hash"))
    joined = components(links(docs, buckets, similarity))
    of_text = written(firsts.join(joined, "id", "left").select("text_key", F.coalesce("label", "id").alias("class_id")), "classes")
    out = rows.select("doc_id", "text_key").join(of_text, "text_key", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    return out.select("doc_id", "text_key", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("representative"))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document with its class."""
    return classes(docs).select("doc_id", "class_id", "representative")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each class (the least doc_id; rows that repeat it go too)."""
    (name,) = fresh(docs, "gone")
    gone = classes(docs).where("not representative").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
