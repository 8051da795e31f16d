"""Toxicity by non-negative positive-unlabelled learning.

Positives are the documents confirmed toxic, the rest of the training text counts as unlabelled. With class prior p, the
risk of a linear scorer over hashed features (words and their beginnings) is p*R+(positives) + max(0, R-(unlabelled) - p*R-(positives)); when
the second part turns negative, the step goes up it instead (the non-negative correction). Training runs in numpy on
the driver, on samples bounded by POSITIVES and UNLABELLED documents, chosen by the smallest seeded hash of doc_id, and by
MOST_FEATURES features, chosen by counts that Spark sums; a sampled document reaches the driver as one bit a feature.
Rows whose crc32(doc_id as text) mod 3 is 1 are held out: neither their labels nor their texts are learned from.

Defined results: null text is empty and scores like any text without known words; without positive labels the prior is
0 and all scores are 0; repeated rows get equal values; a null doc_id is not held out and never trained on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_lists, written

DIMS = 1 << 20
#: Lengths of word beginnings that are features beside the words; they stand for stems that inflected words share.
STEMS = (4, 5, 6)
#: The samples. Fewer unlabelled rows make rare features of clean text, and so the scores of held-out text, less certain.
POSITIVES = 8_000
UNLABELLED = 12_000
CUT = 0.7
FOLDS, HELD = 3, 1
#: A feature must occur in this share of the sampled documents, and in LEAST_DOCS of them.
LEAST_SHARE, LEAST_DOCS = 0.002, 3
#: A feature's share among positives must exceed that among unlabelled texts by so many standard errors.
DEVIATION = 4.0
#: Most features of the model: those that lie the most standard errors apart.
MOST_FEATURES = 1 << 14
#: Weight of the squared weights in the risk, and Adam's rate; chosen of 16 settings by four folds of the rows that are learned from.
DECAY, RATE = 1e-4, 0.05
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def features(text: str | None) -> np.ndarray:
    """The distinct hashed words and word beginnings of a text."""
    words = set(_WORD.findall((text or "").lower()))
    names = [w.encode("utf-8", "replace") for w in words]
    for n in STEMS:
        names += [b"^" + x.encode("utf-8", "replace") for x in {w[:n] for w in words if len(w) > n}]
    return np.unique(np.fromiter(map(zlib.crc32, names), np.uint32, len(names)) & np.uint32(DIMS - 1))


def _sample(docs: DataFrame, pos_ids: list[int], unl_ids: list[int]) -> DataFrame:
    """Distinct feature sets (at, sorted) of the sampled documents, and whether a positive and an unlabelled one has it: copies count
    once. Written, as it is read for counts and for bits."""
    pos, unl = {*pos_ids}, {*unl_ids}
    chosen = [(i, i in pos, i in unl) for i in sorted(pos | unl)]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long, pos boolean, unl boolean"))  # at most POSITIVES + UNLABELLED rows

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield batch | {"at": [features(x).astype(np.int32) for x in batch["text"]]}

    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(wanted, "id").select("id", "pos", "unl", "text")
    one = map_lists(found, run, "id long, pos boolean, unl boolean, at array<int>").groupBy("id").agg(F.max("at").alias("at"), F.max("pos").alias("pos"), F.max("unl").alias("unl"))
    return written(one.groupBy("at").agg(F.max("pos").alias("pos"), F.max("unl").alias("unl")), "toxic-sample")


def _bits(sample: DataFrame, names: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(positive, unlabelled) rows as places in names; at most MOST_FEATURES bits of each row reach the driver."""
    place = np.full(DIMS, -1)
    place[names] = np.arange(len(names))
    shared = sample.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for at in batch["at"]:
                on = np.zeros(len(names), np.uint8)
                mine = shared.value[np.array(at, np.int64)]
                on[mine[mine >= 0]] = 1
                out.append(np.packbits(on).tobytes())
            yield {"pos": batch["pos"], "unl": batch["unl"], "bits": out}

    rows = sorted((bytes(r[2]), r[0], r[1]) for r in map_lists(sample, run, "pos boolean, unl boolean, bits binary").collect())
    places = [np.flatnonzero(np.unpackbits(np.frombuffer(r[0], np.uint8), count=len(names))) for r in rows]
    return [p for p, r in zip(places, rows, strict=True) if r[1]], [p for p, r in zip(places, rows, strict=True) if r[2]]


class Sparse:
    """Rows of binary features, each row scaled to length 1."""

    def __init__(self, rows: list[np.ndarray]):
        self.at = np.concatenate([*rows, np.zeros(0, np.int64)])
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.n = len(rows)

    def score(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], minlength=self.n)

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.at, g[self.row], minlength=dims)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(pos: Sparse, unl: Sparse, w: np.ndarray, b: float, prior: float) -> tuple[float, float]:
    """The two parts of the risk with the logistic loss: prior * R+(positives), and R-(unlabelled) - prior * R-(positives)."""
    sp, su = pos.score(w) + b, unl.score(w) + b
    plus, minus = (lambda s: np.mean(np.logaddexp(0, -s))), (lambda s: np.mean(np.logaddexp(0, s)))  # the losses of +1 and -1
    return prior * plus(sp), minus(su) - prior * minus(sp)


def gradients(pos: Sparse, unl: Sparse, w: np.ndarray, b: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the two parts of the risk; the bias is the last place."""
    sp, su = _sigmoid(pos.score(w) + b), _sigmoid(unl.score(w) + b)
    whole = lambda p, u: np.append(pos.back(p, len(w)) + unl.back(u, len(w)), p.sum() + u.sum())
    return whole(prior * (sp - 1) / pos.n, 0 * su), whole(-prior * sp / pos.n, su / unl.n)


def nnpu(pos: Sparse, unl: Sparse, dims: int, prior: float, steps: int = 300, rate: float = RATE, decay: float = DECAY, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Adam on the corrected risk; where its second part is below -beta, the step goes up that part. Returns weights and bias."""
    w, b = np.zeros(dims), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    for step in range(1, steps + 1):
        first, second = gradients(pos, unl, w, b, prior)
        g = first + second if risk(pos, unl, w, b, prior)[1] >= -beta else -second
        g = g + decay * np.append(w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float, float] | None:
    """Weights over DIMS, bias, and the class prior; None without positive labels."""
    train = labels.where(~held_out(F.col("doc_id").cast("long")) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    counts = train.agg(F.count(F.lit(1)), F.sum(F.expr("cast(toxic = 1 as int)"))).first()
    if not counts[1]:
        return None
    prior = min(max(counts[1] / counts[0], 1e-4), 0.9)
    by_hash = (F.xxhash64(F.lit(8), "doc_id"), F.col("doc_id"))
    pos_ids = [r[0] for r in train.where("toxic = 1").orderBy(*by_hash).limit(positives).select("doc_id").collect()]
    free = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    unl_ids = [r[0] for r in free.orderBy(*by_hash).limit(unlabelled).collect()]
    sample = _sample(docs, pos_ids, unl_ids)
    n_pos, n_unl = (int(x or 0) for x in sample.agg(F.sum(F.col("pos").cast("int")), F.sum(F.col("unl").cast("int"))).first())
    if not n_pos or not n_unl:
        return None
    counts = sample.select(F.explode("at").alias("name"), "pos", "unl").groupBy("name").agg(F.sum(F.col("pos").cast("int")).alias("p"), F.sum(F.col("unl").cast("int")).alias("u"))
    p, q, both = F.col("p") / n_pos, F.col("u") / n_unl, (F.col("p") + F.col("u")) / (n_pos + n_unl)
    error = F.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_unl))
    often = F.col("p") + F.col("u") >= max(LEAST_DOCS, LEAST_SHARE * (n_pos + n_unl))
    apart = counts.where(often & (p - q >= DEVIATION * error)).orderBy(F.desc((p - q) / F.greatest(error, F.lit(1e-12))), "name").limit(MOST_FEATURES)
    names = np.array(sorted(r[0] for r in apart.select("name").collect()), np.int64)
    pos, unl = _bits(sample, names)
    w, b = nnpu(Sparse(pos), Sparse(unl), len(names), prior)
    full = np.zeros(DIMS, np.float32)
    full[names] = w
    return full, b, prior


def score(docs: DataFrame, labels: DataFrame, cut: float = CUT, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    model = fit(docs, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        model = shared.value
        for batch in batches:
            s = np.zeros(len(batch["text"]))
            if model is not None and len(s):
                w, b, _ = model
                s = _sigmoid(np.array([float(w[features(x)].sum(dtype=np.float64)) + b for x in batch["text"]]))
            yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": s}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    out = map_lists(rows, run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
