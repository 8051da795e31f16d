"""Byte-level BPE: encoding and decoding by a literal rank map.

Texts are split by the vocabulary's pattern. The merges of a word are a fold (aggregate) over its byte array: the state
is one array of whole numbers, each of them a piece: the rank of the pair that it makes with the next piece, its place in the
word, its id. So the least one is the leftmost pair of the lowest rank; a step merges it and looks up the one or two pairs that are new.
Ranks of pairs are a literal of the plan: BUCKETS short arrays, each the mark of a pair that doesn't merge, then a pair and what it
merges to, negative, and so on; so what stands after the place of a pair (0 if it isn't there) is the answer.

A fold over n bytes copies n ids a step, so a word of over LONG bytes is folded in parts: first cut at every LONG bytes, then
again with cuts between two ids in the middle of each part. Ids are the whole word's if each two neighbours are what their own bytes fold to;
neighbours within a part are. The second cuts therefore stand if both of their neighbours come out as in the first fold; where one
doesn't, parts are eight times as long, and at last the word is folded whole.

Words are folded once: the KEPT most frequent words of the corpus (a bounded table, broadcast to the Python workers) are
folded as a table of distinct words; every other word is folded where it stands, once for each block of documents.
Python only splits texts, and puts ids in their places. Decoding concatenates the binary piece of each id.

Defined results: null text is empty and has no ids; an empty table gives an empty result; words and texts may have any
length; other columns are not carried; text that is no token of the pattern
does not exist, as the pattern covers every character.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Finder, map_lists, written

BUCKETS = 32749
#: Most frequent words in the broadcast table, of at most KEPT_CHARS characters: under 80 MB whatever the corpus.
KEPT, KEPT_CHARS = 1 << 19, 32
#: Bytes of text in a block of documents.
BLOCK = 1 << 20
#: Bytes of a word that are folded at once; no piece of the vocabulary may be as long.
LONG = 256
#: Bits of an id and of a place in the word; the rank stands above them. Pairs that don't merge have the rank _NONE.
ID_BITS, PLACE_BITS = 17, 29
_NONE = (1 << ID_BITS) - 1
#: The vocabulary's pattern, its classes spelt out for engines with other ideas of white space.
WORDS = r" ?[\p{L}]+| ?[\p{N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^<white>\p{L}\p{N}]+|[<white>]+(?![^<white>])|[<white>]+"


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(4)
def pieces(path: str) -> list[bytes]:
    """Piece by id."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


@lru_cache(4)
def _literals(path: str) -> tuple[str, ...]:
    """JSON of the merged ids of two bytes, of the byte ids, of the merged ids by pair in each bucket, and of the bytes of an id."""
    ranks = load_ranks(path)
    if max(ranks.values()) >= _NONE:
        raise ValueError(f"ids must be below {_NONE}")
    two = [ranks.get(bytes([a, b]), _NONE) for a in range(256) for b in range(256)]
    pairs: list[list[int]] = [[-_NONE] for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                pair = (left << ID_BITS) + right
                pairs[pair % BUCKETS] += [pair, -rank]
    spell = lambda x: json.dumps(x, separators=(",", ":"))
    return spell(two), spell([ranks[bytes([b])] for b in range(256)]), spell(pairs), spell([*map(len, pieces(path))])


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Merger:
    """The fold as a Column function of words' bytes, arrays of integers from 0 to 255. The rank map is a literal that stands in the
    plan once: within(use) binds it, and use(fold) is computed where it is bound."""

    def __init__(self, path: str):
        two, of_byte, pairs, sizes = _literals(path)
        typed = {"two": (two, "array<int>"), "of_byte": (of_byte, "array<int>"), "pairs": (pairs, "array<array<long>>"), "sizes": (sizes, "array<int>")}
        self.tables = F.struct(*[F.from_json(F.lit(x), t).alias(n) for n, (x, t) in typed.items()])

    def within(self, use) -> Column:
        return _let(self.tables, lambda t: use(lambda raw: self.fold(t, raw)))

    def rank(self, t: Column, left: Column, right: Column) -> Column:
        """The id of the merged pair of ids (long), _NONE if there is none or one of them is null."""
        bucket = lambda pair: F.get(t["pairs"], (pair % BUCKETS).cast("int"))
        after = lambda pair: F.get(bucket(pair), F.array_position(bucket(pair), pair).cast("int"))
        return F.coalesce(-after(F.shiftleft(left, ID_BITS) + right), F.lit(_NONE).cast("long"))

    def fold(self, t: Column, raw: Column) -> Column:
        n = F.size(raw)
        single = F.transform(raw, lambda b: F.get(t["of_byte"], b))
        return F.when(n <= 1, single).when(n <= LONG, self.short(t, raw)).otherwise(self.long(t, raw))

    def short(self, t: Column, raw: Column) -> Column:
        low = ID_BITS + PLACE_BITS
        id_of = lambda x: x.bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("long"))
        ranked = lambda rank, rest: F.shiftleft(rank, low).bitwiseOR(rest)
        below = lambda x: x.bitwiseAND(F.lit((1 << low) - 1))

        def piece(byte: Column, i: Column) -> Column:
            rank = F.coalesce(F.get(t["two"], byte * 256 + F.get(raw, i + 1)), F.lit(_NONE))
            return ranked(rank.cast("long"), F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(F.get(t["of_byte"], byte).cast("long")))

        def merge(state: Column, least: Column) -> Column:
            best = F.shiftright(least, low)

            def at(p: Column) -> Column:
                before = F.get(state, p - 1)
                joined = ranked(self.rank(t, best, id_of(F.get(state, p + 2))), below(least) - id_of(least) + best)
                new = lambda x: F.when(x == least, joined).when(x == before, ranked(self.rank(t, id_of(before), best), below(before))).otherwise(x)
                return F.transform(F.array_remove(state, F.get(state, p + 1)), new)

            return _let((F.array_position(state, least) - 1).cast("int"), at)

        def step(state: Column, _: Column) -> Column:
            return _let(F.array_min(state), lambda least: F.when(least < (_NONE << low), merge(state, least)).otherwise(state))

        return F.aggregate(F.slice(raw, F.lit(2), F.size(raw)), F.transform(raw, piece), step, lambda s: F.transform(s, lambda x: id_of(x).cast("int")))

    def long(self, t: Column, raw: Column) -> Column:
        """Tries parts of LONG and of 8 * LONG bytes, then the whole word."""
        whole = F.array(F.struct(F.lit(0).alias("from"), F.size(raw).alias("n")))

        def attempt(size: int, otherwise: Column) -> Column:
            cuts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(raw) / size).cast("int") - 1), lambda k: F.struct((k * size).alias("from"), F.lit(size).alias("n")))

            def seams(first: Column) -> Column:
                """Of each part but the last the cut in its middle: its place in the word, and the ids on both sides."""

                def seam(ids: Column, k: Column) -> Column:
                    half = F.floor(F.size(ids) / 2).cast("int")
                    size_of = F.aggregate(F.slice(ids, F.lit(1), half), F.lit(0), lambda s, i: s + F.get(t["sizes"], i))
                    return F.struct((k * size + size_of).alias("at"), F.get(ids, half - 1).alias("left"), F.get(ids, half).alias("right"))

                return F.transform(F.slice(first, F.lit(1), F.size(first) - 1), seam)

            def again(cut: Column) -> Column:
                starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda s: s["at"]), F.array(F.size(raw)))
                pieces = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda k: F.struct(F.get(starts, k).alias("from"), (F.get(starts, k + 1) - F.get(starts, k)).alias("n")))

                def joined(ids: Column) -> Column:
                    stands = lambda s, k: (s["left"] == F.element_at(F.get(ids, k), -1)) & (s["right"] == F.get(F.get(ids, k + 1), F.lit(0)))
                    ok = F.forall(F.transform(cut, stands), lambda x: x)
                    return F.when(ok, F.flatten(ids)).otherwise(otherwise)

                return _let(folded(pieces), joined)

            return _let(folded(cuts), lambda first: _let(seams(first), again))

        folded = lambda parts: F.transform(parts, lambda p: self.short(t, F.slice(raw, p["from"] + 1, p["n"])))
        return attempt(LONG, F.when(F.size(raw) > 8 * LONG, attempt(8 * LONG, F.flatten(folded(whole)))).otherwise(F.flatten(folded(whole))))


def bytes_of(word: Column) -> Column:
    """The UTF-8 bytes of a string as an array of integers."""
    raw = F.hex(F.encode(word, "UTF-8"))
    digit = lambda i: F.instr(F.lit("0123456789ABCDEF"), F.substring(raw, i, F.lit(1))) - 1
    return F.transform(F.sequence(F.lit(1), (F.length(raw) / 2).cast("int")), lambda i: digit(2 * i - 1) * 16 + digit(2 * i))


def count_words(docs: DataFrame) -> DataFrame:
    """word and n over all texts; each task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = Finder(WORDS), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array([*seen.values()], pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(find(text or ""))
            if len(seen) > 200_000:
                yield out()
                seen = Counter()
        yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, kept: int = KEPT) -> DataFrame:
    """The most frequent words, at most kept of them: all those above the least count at which they fit."""
    top = 1 << 16
    sizes = counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    least, total = top + 1, 0
    for n, words in sizes:
        total += words
        if total > kept:
            break
        least = n
    return counts.where(F.col("n") >= least)


def fold_table(docs: DataFrame, path: str, kept: int = KEPT) -> pa.Table:
    """word and ids of the most frequent words, by the fold."""
    counts = written(count_words(docs).where(F.length("word") <= KEPT_CHARS), "bpe-words")
    return frequent(counts, kept).select("word", Merger(path).within(lambda fold: _let(bytes_of(F.col("word")), fold)).alias("ids")).toArrow()


def _as_dict(table: pa.Table) -> dict[str, bytes]:
    table = table.combine_chunks()
    if not table.num_rows:
        return {}
    ids = table["ids"].chunk(0)
    raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    at = [4 * x for x in ids.offsets.to_pylist()]
    return {w: raw[a:b] for w, a, b in zip(table["word"].to_pylist(), at, at[1:], strict=False)}


class _Table(dict):
    """Ids by word; a word that is missing gets a mark that stands for its place among the block's other words."""

    def __init__(self, known: dict[str, bytes]):
        super().__init__(known)
        self.others: list[str] = []

    def __missing__(self, word: str) -> bytes:
        mark = self[word] = (0x80000000 | len(self.others)).to_bytes(4, "little")
        self.others.append(word)
        return mark

    def drain(self) -> pa.ListArray:
        """The other words' bytes, one list for each word, and a fresh start."""
        raw = [w.encode("utf-8", "replace") for w in self.others]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))]).astype(np.int32)
        for w in self.others:
            del self[w]
        self.others = []
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)))


def decode_ids(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _joined(keys: list, parts: list[bytes], sizes: np.ndarray, flat: np.ndarray, table: list[bytes], finish: str) -> pa.RecordBatch:
    """The rows of a block: marks give way to the ids of the words that they stand for (flat, of these sizes)."""
    starts = np.cumsum(sizes) - sizes
    counts, ids_of, hashes = [], [], []
    for part in parts:
        ids = np.frombuffer(part, "<u4")
        marked = ids >= 0x80000000
        if marked.any():
            which = (ids[marked] & 0x7FFFFFFF).astype(np.int64)
            own = sizes[which]
            repeat = np.ones(len(ids), np.int64)
            repeat[marked] = own
            out = np.repeat(ids, repeat)
            first = (np.cumsum(repeat) - repeat)[marked]
            step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(first, own) + step] = flat[np.repeat(starts[which], own) + step]
            part = out.astype("<u4").tobytes()
        counts.append(len(part) // 4)
        if finish == "digest":
            ids_of.append(hashlib.sha256(part).hexdigest())
            hashes.append(hashlib.sha256(decode_ids(part, table)).hexdigest())
        else:
            ids_of.append(part)
    columns = {"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array(counts, pa.int64())}
    if finish == "digest":
        columns |= {"ids_sha256": pa.array(ids_of, pa.string()), "decoded_sha256": pa.array(hashes, pa.string())}
    else:
        columns["ids"] = pa.array(ids_of, pa.binary())
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def encode(docs: DataFrame, path: str | None = None, kept: int = KEPT, finish: str = "ids") -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit); with finish="digest" the hashes of ids and of the decoded bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    sc = docs.sparkSession.sparkContext
    known, table = sc.broadcast(fold_table(docs, path, kept)), sc.broadcast(pieces(path))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, words = Finder(WORDS), _Table(_as_dict(known.value))
        keys, parts, size = [], [], 0
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([one(pa.array(keys, pa.int64())), one(pa.array(parts, pa.binary())), one(words.drain())], ["keys", "parts", "others"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                parts.append(b"".join(map(words.__getitem__, find(text or ""))))
                size += len(text or "") + 64
                if size >= BLOCK:
                    yield block()
                    keys, parts, size = [], [], 0
        if keys:
            yield block()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_by_id = table.value
        for batch in batches:
            for i in range(batch.num_rows):
                keys, parts = (batch.column(c)[i].values.to_pylist() for c in (0, 1))
                others = batch.column(2)[i].values
                sizes = np.diff(others.offsets.to_numpy()).astype(np.int64)
                flat = others.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
                yield _joined(keys, parts, sizes, flat, pieces_by_id, finish)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = rows.mapInArrow(split, "keys array<long>, parts array<binary>, others array<array<int>>")
    folded = blocks.select("keys", "parts", Merger(path).within(lambda fold: F.transform("others", fold)).alias("others"))
    return folded.mapInArrow(join, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if finish == "digest" else "ids binary"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded (binary): the pieces of the ids, concatenated."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    table = encoded.sparkSession.sparkContext.broadcast(pieces(path))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "decoded": [decode_ids(x, table.value) for x in batch["ids"]]}

    return map_lists(encoded.select("doc_id", "ids"), run, "doc_id long, decoded binary")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode(docs, path, finish="digest")
