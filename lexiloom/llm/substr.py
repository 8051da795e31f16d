"""Substring dedup over a log-structured fingerprint index.

A window is WINDOW consecutive words. Its fingerprint in the index is that of its anchor: of the GRAM-word grams in the
window, the one of the least hash. Equal windows have equal anchors, so a window can only be repeated if its anchor is,
and a fifth of the positions need an entry. Documents come in batches of rising doc_id. The index is a list of
immutable runs, each sorted by fingerprint within parts of the hash range; a batch is merge-joined with the runs, which
gives the anchors that two documents share, and becomes a run itself; more than MAX_RUNS runs are compacted into one.
The runs are partitions of one table that is bucketed by part: a batch is shuffled to the buckets, the runs are read where they lie.

The hits are then verified: documents with shared anchors give 128-bit hashes (of other word hashes than the anchors')
of the windows over them, and a window is repeated if the least doc_id that has it is smaller than its own; of 5e12 windows, some
100 TB, two different ones share a hash with a probability below 1e-13. Each task adds
up before it shuffles: for a fingerprint or window that several of its documents have, only the smallest doc_id goes on, and
the others are decided on the spot. So a passage in a third of all documents sends a row for each task, not for each document.

Defined results: null text has no words; a null doc_id is neither smaller nor larger than others, so nothing is removed
from it or because of it; rows that repeat a doc_id don't make each other's words repeated; texts under WINDOW words stay;
an empty table gives an empty result; in documents that lose words, the others are joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, map_lists, new_path, written

WINDOW, GRAM = 13, 5
BATCHES = 4
MAX_RUNS = 2
#: Words of a task's documents that are added up together.
CHUNK = 3_000_000
#: Bytes of text for each part of the hash range.
PART_BYTES = 2 << 20
#: Bytes of text for each bucket of the index, and its least and most buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 8, 100_000
#: Bits of the filter that keeps documents without hits out of the joins; its size is fixed, so it only gets less sharp.
FILTER_BITS = 1 << 26

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _rolled(h: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """Hash of each run of n words."""
    count = len(h) - n + 1
    out = h[:count].copy()
    for k in range(1, n):
        out = out * odd + h[k : k + count]
    return _mix(out)


def _word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram hashes, and for each window the place of its anchor."""
    grams = _rolled(_word_hashes(words, 0), GRAM, _B)
    return grams, np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(axis=1) + np.arange(len(words) - WINDOW + 1)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def _own_group() -> int:
    """A group of its own for rows that only pass through; negative, so no part."""
    return -1 - TaskContext.get().partitionId()


_ENTRY = "part int, kind int, h binary, doc binary, flag binary"


def _entries(docs: DataFrame, parts: int) -> DataFrame:
    """Per task chunk and part: sorted distinct anchors, the least doc_id of each, and whether two documents had it."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[np.ndarray] = []
        keys: list[int] = []
        size = 0

        def out() -> dict:
            h = np.concatenate(held)
            d = np.repeat(np.array(keys, np.int64), [len(x) for x in held])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            starts = np.flatnonzero(first)
            last = np.append(starts[1:], len(h)) - 1
            shared = d[starts] != d[last]
            local = np.repeat(shared, last - starts + 1)  # decided here: these documents share the anchor
            rows = [(_own_group(), 1, h[local].tobytes(), d[local].tobytes(), b"")] if local.any() else []
            h, d = h[starts], d[starts]
            part = _part(h, parts)
            order = np.argsort(part, kind="stable")
            h, d, shared, part = h[order], d[order], shared[order].astype(np.uint8), part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows.append((int(part[a]), 0, h[a:b].tobytes(), d[a:b].tobytes(), shared[a:b].tobytes()))
            return dict(zip(("part", "kind", "h", "doc", "flag"), zip(*rows, strict=True), strict=True))

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = text.encode("utf-8", "replace").split()
                if len(words) < WINDOW:
                    continue
                grams, at = anchors(words)
                held.append(np.unique(grams[at]))
                keys.append(key)
                size += len(words)
                if size >= CHUNK:
                    yield out()
                    held, keys, size = [], [], 0
        if held:
            yield out()

    return map_lists(docs.select("doc_id", "text"), run, _ENTRY)


def _arrays(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(group["h"]), np.uint64), np.frombuffer(b"".join(group["doc"]), np.int64), np.frombuffer(b"".join(group["flag"]), np.uint8)


def _merge(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """Of one part, the batch (kind 0) and the runs (kind 2): the batch as a run (kind 2), and hits (kind 1)."""
    if not len(new) or new["part"].iloc[0] < 0:
        return new
    (h, d, f), (h0, d0, f0) = _arrays(new), _arrays(old)
    n_old = len(h0)
    hs, ds, fs = np.concatenate([h0, h]), np.concatenate([d0, d]), np.concatenate([f0, f])
    is_new = np.arange(len(hs)) >= n_old
    order = np.lexsort((ds, hs))
    hs, ds, fs, is_new = hs[order], ds[order], fs[order], is_new[order]
    starts = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if len(hs) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(hs)))
    ends = starts + sizes - 1
    shared = (ds[starts] != ds[ends]) | (np.maximum.reduceat(fs, starts) > 0 if len(hs) else np.zeros(0, bool))
    old_entries = np.add.reduceat((~is_new).astype(np.int64), starts) if len(hs) else starts
    old_flag = np.maximum.reduceat(np.where(is_new, 0, fs), starts) > 0 if len(hs) else shared
    settled = old_flag | (old_entries > 1)  # shared before this batch: the old documents were hits then
    hit = np.repeat(shared, sizes) & (fs == 0) & (is_new | ~np.repeat(settled, sizes))
    rows = [(1, hs[hit].tobytes(), ds[hit].tobytes(), b"")]
    mine = np.add.reduceat(is_new.astype(np.int64), starts) > 0 if len(hs) else shared
    first_new = np.minimum.reduceat(np.where(is_new, ds, np.iinfo(np.int64).max), starts) if len(hs) else starts
    rows.append((2, hs[starts][mine].tobytes(), first_new[mine].tobytes(), shared[mine].astype(np.uint8).tobytes()))
    out = pd.DataFrame(rows, columns=["kind", "h", "doc", "flag"])
    out.insert(0, "part", new["part"].iloc[0])
    return out


def _compact(group: pd.DataFrame) -> pd.DataFrame:
    h, d, f = _arrays(group)
    order = np.lexsort((d, h))
    h, d, f = h[order], d[order], f[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(starts, len(h)))
    shared = ((np.maximum.reduceat(f, starts) > 0) | (sizes > 1)).astype(np.uint8)
    return pd.DataFrame([(group["part"].iloc[0], 2, h[starts].tobytes(), d[starts].tobytes(), shared.tobytes())], columns=["part", "kind", "h", "doc", "flag"])


class FingerprintIndex:
    """The runs so far. Batches must come in rising doc_id."""

    def __init__(self, spark: SparkSession, parts: int, max_runs: int = MAX_RUNS, buckets: int = LEAST_BUCKETS):
        self.spark, self.parts, self.max_runs, self.buckets = spark, parts, max_runs, buckets
        self.path = new_path(spark, "index")
        self.table = "lexiloom_" + self.path.rsplit("-", 1)[1]
        self.runs: list[int] = []
        self.written = 0

    def _read(self, runs: list[int], kind: int) -> DataFrame:
        return self.spark.table(self.table).where(F.col("run").isin(runs) & (F.col("kind") == kind)).select("part", "kind", "h", "doc", "flag")

    def _write(self, rows: DataFrame) -> int:
        """A new run; files of others are never changed."""
        self.written += 1
        run = rows.withColumn("run", F.lit(self.written))
        run.write.partitionBy("run").bucketBy(self.buckets, "part").mode("append").option("path", self.path).saveAsTable(self.table)
        return self.written

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, text); returns its hits, and those it makes of older documents, as doc_id and anchor."""
        rows = _entries(docs, self.parts)
        if self.runs:
            rows = rows.groupBy("part").cogroup(self._read(self.runs, 2).groupBy("part")).applyInPandas(_merge, _ENTRY)
        else:
            rows = rows.repartition(self.buckets, "part").groupBy("part").applyInPandas(lambda new: _merge(new, new.iloc[:0]), _ENTRY)
        run = self._write(rows)
        self.runs.append(run)
        if len(self.runs) > self.max_runs:
            self.compact()

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for h, d in zip(batch["h"], batch["doc"], strict=True):
                    yield pd.DataFrame({"doc_id": np.frombuffer(d, np.int64), "anchor": np.frombuffer(h, np.int64)})

        return self._read([run], 1).select("h", "doc").mapInPandas(spread, "doc_id long, anchor long")

    def compact(self) -> None:
        """All runs become one; hits stay readable in the old runs."""
        self.runs = [self._write(self._read(self.runs, 2).groupBy("part").applyInPandas(_compact, _ENTRY))]

    def drop(self) -> None:
        """Removes the index; hits can't be read any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        discard(self.spark, self.path)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """The fixed-size filter of doc_ids; at most FILTER_BITS / 64 rows reach the driver."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    rows = ids.select((slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id), {FILTER_BITS}L), 64) as int))").alias("bit"))
    got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _in_filter(bits: np.ndarray, slots: list[int]) -> np.ndarray:
    slots = np.asarray(slots, np.int64)
    return (bits[slots // 64] >> (slots % 64).astype(np.uint64)) & np.uint64(1) > 0


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, a key of the text, and the place in the filter."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"text_key": F.xxhash64("text"), "slot": F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))})


_WINDOWS = "part int, h binary, doc binary, text_key binary, at binary, n binary"


def _row(part: int, h: np.ndarray, d: np.ndarray, k: np.ndarray, a: np.ndarray) -> tuple:
    """Windows in the order of their documents; neighbours in a document share one entry of doc, key, first place and number."""
    starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (a[1:] != a[:-1] + 1)]))
    n = np.diff(np.append(starts, len(d))).astype(np.int32)
    return part, h.tobytes(), d[starts].tobytes(), k[starts].tobytes(), a[starts].tobytes(), n.tobytes()


def _later(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the window. h: two hashes in a row for each window."""
    order = np.lexsort((d, h[:, 1], h[:, 0]))
    hs, ds = h[order], d[order]
    starts = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]).any(axis=1)]))
    out = np.zeros(len(h), bool)
    out[order] = ds > np.repeat(ds[starts], np.diff(np.append(starts, len(h))))
    return out


def window_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits for each window, as two numbers in a row."""
    h = _word_hashes(words, 1)
    return np.stack([_rolled(h, WINDOW, _A), _rolled(h ^ _B, WINDOW, _C)], axis=1)


def verify(docs: DataFrame, hits: DataFrame, parts: int) -> DataFrame:
    """doc_id, text_key and runs (first to last) of the windows, by first word, that also start in a smaller doc_id."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter_of(hits))

    def candidates(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            on = np.flatnonzero(_in_filter(bits.value, batch["slot"])).tolist()
            yield {c: [batch[c][i] for i in on] for c in ("doc_id", "text", "text_key")}

    rows = map_lists(_keyed(docs).where("doc_id is not null"), candidates, "doc_id long, text string, text_key long")
    rows = rows.join(hits.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "doc_id")

    def windows(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple] = []
        size = 0

        def out() -> dict:
            n = [len(x[0]) for x in held]
            h, a = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            part = np.concatenate([x[2] for x in held])
            d, k = np.repeat(np.array([x[3] for x in held], np.int64), n), np.repeat(np.array([x[4] for x in held], np.int64), n)
            later = _later(h, d)  # decided here
            rows = [_row(_own_group(), h[:0], d[later], k[later], a[later])] if later.any() else []
            keep = np.flatnonzero(~later)
            keep = keep[np.argsort(part[keep], kind="stable")]
            h, a, part, d, k = h[keep], a[keep], part[keep], d[keep], k[keep]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            rows += [_row(int(part[x]), h[x:y], d[x:y], k[x:y], a[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            return dict(zip(("part", "h", "doc", "text_key", "at", "n"), zip(*rows, strict=True), strict=True))

        for batch in batches:
            for key, text, text_key, shared in zip(batch["doc_id"], batch["text"], batch["text_key"], batch["anchors"], strict=True):
                words = text.encode("utf-8", "replace").split()
                if len(words) < WINDOW:
                    continue
                grams, at = anchors(words)
                own = grams[at]
                chosen = np.flatnonzero(np.isin(own, np.array(shared, np.int64).view(np.uint64)))
                if len(chosen):
                    held.append((window_hashes(words)[chosen], chosen.astype(np.int32), _part(own[chosen], parts), key, text_key))
                    size += len(chosen)
                if size >= CHUNK // 2:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        d = np.frombuffer(b"".join(group["doc"]), np.int64)
        k = np.frombuffer(b"".join(group["text_key"]), np.int64)
        n = np.frombuffer(b"".join(group["n"]), np.int32)
        a = np.repeat(np.frombuffer(b"".join(group["at"]), np.int32), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d, k = np.repeat(d, n), np.repeat(k, n)
        if group["part"].iloc[0] >= 0:
            later = _later(np.frombuffer(b"".join(group["h"]), np.uint64).reshape(-1, 2), d)
            d, k, a = d[later], k[later], a[later]
        order = np.lexsort((a, k, d))  # windows side by side become one row
        d, k, a = d[order], k[order], a[order].astype(np.int64)
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (a[1:] - a[:-1] > 1)]) if len(d) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        last = np.append(starts[1:], len(d)) - 1 if len(d) else starts
        return pd.DataFrame({"doc_id": d[starts], "text_key": k[starts], "first": a[starts], "last": a[last] if len(d) else a})

    rows = rows.select("doc_id", "text", "text_key", "anchors")
    return map_lists(rows, windows, _WINDOWS).groupBy("part").applyInPandas(decide, "doc_id long, text_key long, first long, last long")


def repeated(docs: DataFrame, batches: int = BATCHES, part_bytes: int = PART_BYTES, max_runs: int = MAX_RUNS) -> DataFrame:
    """Repeated windows of the whole table: doc_id, text_key, and runs of window starts first to last. Written once."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    facts = own.agg(F.sum(F.octet_length("text")), F.expr(f"approx_percentile(doc_id, array({', '.join(str((i + 1) / batches) for i in range(max(1, batches - 1)))}))")).first()
    size = int(facts[0] or 0)
    parts = max(64, size // part_bytes)
    index, hits, low = FingerprintIndex(spark, parts, max_runs, min(MOST_BUCKETS, max(LEAST_BUCKETS, size // BUCKET_BYTES))), None, None
    bounds = sorted({*(facts[1] or [])})[: batches - 1] if batches > 1 else []
    for high in [*bounds, None]:
        batch = own
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        got = index.ingest(batch)
        hits, low = got if hits is None else hits.unionByName(got), high
    found = written(verify(docs, hits, parts), "repeats")
    index.drop()
    return found


def kept_words(words: list, runs: list[tuple[int, int]]) -> list:
    gone = np.zeros(len(words) + 1, np.int64)
    for first, last in runs:
        gone[first] += 1
        gone[min(last + WINDOW, len(words))] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    return [w for w, x in zip(words, stay, strict=True) if x]


def digest(docs: DataFrame, batches: int = BATCHES, max_runs: int = MAX_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    found = repeated(docs, batches, max_runs=max_runs)
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(found))
    by_doc = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    sha = lambda words: hashlib.sha256(b" ".join(words)).hexdigest()

    def plain(batches: Iterator[dict]) -> Iterator[dict]:
        """Documents outside the filter are done here, and their texts go no further."""
        for batch in batches:
            maybe = [m and k is not None for m, k in zip(_in_filter(bits.value, batch["slot"]).tolist(), batch["doc_id"], strict=True)]
            split = [None if m else t.encode("utf-8", "replace").split() for t, m in zip(batch["text"], maybe, strict=True)]
            yield {
                "doc_id": batch["doc_id"], "text_key": batch["text_key"], "text": [t if m else None for t, m in zip(batch["text"], maybe, strict=True)],
                "n_words": [None if w is None else len(w) for w in split], "kept_sha256": [None if w is None else sha(w) for w in split],
            }

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for text, n, hashed, runs in zip(batch["text"], batch["n_words"], batch["kept_sha256"], batch["runs"], strict=True):
                if text is None:
                    out.append((n, 0, hashed))
                    continue
                words = text.encode("utf-8", "replace").split()
                stay = kept_words(words, [(r["first"], r["last"]) for r in runs or []])
                out.append((len(words), len(words) - len(stay), sha(stay)))
            yield {"doc_id": batch["doc_id"]} | dict(zip(("n_words", "n_removed", "kept_sha256"), zip(*out, strict=True), strict=True))

    rows = map_lists(_keyed(docs), plain, "doc_id long, text_key long, text string, n_words long, kept_sha256 string")
    joined = rows.join(by_doc, ["doc_id", "text_key"], "left").drop("text_key")
    return map_lists(joined, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs, all columns and rows, without the repeated words."""
    found = repeated(docs, batches)
    key, runs, doc, text_key = fresh(docs, "key", "runs", "doc", "text_key")
    by_doc = found.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(text_key)).agg(F.collect_list(F.struct("first", "last")).alias(runs))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = keyed.join(by_doc, (keyed["doc_id"].cast("long") == by_doc[doc]) & (keyed[key] == by_doc[text_key]), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, r in zip(text, runs, strict=True):
            if r is None or not len(r):
                out.append(t)
            else:
                words = (t or "").encode("utf-8", "replace").split()
                out.append(b" ".join(kept_words(words, [(x["first"], x["last"]) for x in r])).decode())
        return pd.Series(out, dtype=object)

    text = F.when(F.col(runs).isNull(), F.col("text")).otherwise(cut(F.col("text").cast("string"), runs))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
