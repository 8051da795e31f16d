"""Quality rules: base rules on words, lines and symbols, then a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of words are hashed into BUCKETS counters. Two multinomials are fitted: the raw one from every
document of the corpus, the trusted one from documents labelled good (a bounded sample of TRUSTED labelled rows: those
of the smallest seeded hash). A document's score is the mean over its n-grams of log p_trusted - log p_raw; below
THRESHOLD it is rejected. The threshold is a constant, so the verdict depends on the document and the two models alone.

Defined results: null text has no words and fails the base rules; documents without words score 0; without trusted rows
both models are equal, all scores are 0 and only the base rules reject; rows with equal texts get equal values.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_lists

BUCKETS = 1 << 14
TRUSTED = 20_000
THRESHOLD = -0.15
WINDOW = 8
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint64(29)
    x = x * _MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1))


def ngram_buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of all unigrams and bigrams."""
    pairs = _mixed(h[:-1] * _ODD + h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate([h, pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def repeated_words(words: list[bytes], h: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more; windows of equal hashes are compared word by word."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    roll = h[:n].copy()
    for k in range(1, window):
        roll = roll * _ODD + h[k : k + n]
    order = np.argsort(roll, kind="stable")
    same = roll[order][1:] == roll[order][:-1]
    if not same.any():
        return 0
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    group = np.repeat(first, np.diff(np.append(first, n)))
    leader, member = order[group], order
    often = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    if all((ids[leader[often] + k] == ids[member[often] + k]).all() for k in range(window)):
        hit = member[often]
    else:  # two windows share a hash
        seen: dict[bytes, list[int]] = {}
        for i in range(n):
            seen.setdefault(ids[i : i + window].tobytes(), []).append(i)
        hit = np.array([i for at in seen.values() if len(at) > 1 for i in at], np.int64)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n += line in seen
            seen.add(line)
    return n


def _base(text: str, words: list[bytes], h: np.ndarray) -> tuple:
    n, repeat = len(words), repeated_words(words, h)
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat, n < 20 or 100 * repeat > 30 * n


def fit(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> np.ndarray:
    """log p_trusted - log p_raw for each bucket."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ids = {r[0] for r in good.orderBy(F.xxhash64(F.lit(4), "doc_id"), "doc_id").limit(trusted).collect()}

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = np.bincount(ngram_buckets(word_hashes((text or "").encode("utf-8", "replace").split())), minlength=BUCKETS)
                raw += found
                if key in ids:
                    target += found
        yield {"bucket": np.arange(BUCKETS, dtype=np.int32), "raw": raw, "target": target}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = map_lists(rows, count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda c: np.log((c + 1) / (c.sum() + BUCKETS))
    return share(target) - share(raw)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """Per document: the base measures, llr (the length-normalised ratio) and the verdict."""
    ratio = fit(docs, labels, trusted)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[dict]) -> Iterator[dict]:
        table = shared.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                words = text.encode("utf-8", "replace").split()
                h = word_hashes(words)
                base = _base(text, words, h)
                llr = float(np.sum(table[ngram_buckets(h)]) / (2 * len(words) - 1)) if words else 0.0
                rows.append((*base, llr, not base[-1] and round(llr, 9) >= threshold))
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
            yield {"doc_id": batch["doc_id"]} | dict(zip(names, zip(*rows, strict=True), strict=True))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_lists(rows, score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean")


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with their columns, in one pass: the verdict is taken where the text is."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            kept = []
            for text in batch.column(place).to_pylist():
                text = text or ""
                words = text.encode("utf-8", "replace").split()
                h = word_hashes(words)
                kept.append(not _base(text, words, h)[-1] and round(float(np.sum(table[ngram_buckets(h)]) / (2 * len(words) - 1)), 9) >= threshold)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
