"""Packing by the shortest pack first over the histogram of lengths.

Documents become token ids (own end id last), and each is cut into pieces of at most ``size`` ids. The histogram of piece
lengths has at most ``size`` entries, whatever the corpus holds. From the longest length down, the plan puts a length
into the packs with the most room, as many at once as there are packs of that fill, and opens new packs when none has
room. A run of packs with equal fill is (first sequence, how many), so a placement is (length, first rank, how many, first
sequence, offset): at most a few for each length. Pieces of a length then take their placements by rank; ranks are
counted in salted groups of about RANKED pieces, so a hot length is not one task.

Defined results: null text is empty and is one piece with the end id alone; a repeated doc_id gives pieces of its own;
an empty table gives no sequences; columns other than doc_id and text are not carried.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Finder, map_lists, written

SIZE = 4096
END = 2
#: Pieces of one length that are ranked together.
RANKED = 1 << 14
#: Words kept with their ids in a Python worker, some 100 MB; beyond it the table starts anew. Workers are reused, so it stays with them.
KEPT_WORDS = 500_000
#: Texts that are encoded together.
TEXTS = 1000
#: The words that the vocabulary file's pattern finds.
WORDS = r"[\p{L}]+|[\p{N}]|'(?:s|t|re|ve|m|ll|d)|[^<white>\p{L}\p{N}]+"


class WordEncoder:
    """Ids of whole texts; each distinct word goes through the tokenizers library once and is then looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.find = Finder(WORDS)
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """All new words in one call; a word's ids end with the one that holds the word's end."""
        # the fast call leaves out offsets, which nobody reads
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            for w in words:
                self.known[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            return
        raw, at = ids.astype("<u4").tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist(), strict=True):
            self.known[w] = raw[at:end]
            at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text the ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        out: list[list] = []
        holes: list[tuple[list, int, str]] = []  # words that are not known yet
        get = self.known.get
        for text in texts:
            text = text or ""
            if self.special and self.special.search(text):
                out.append([np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()])
                continue
            text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            words = self.find(text)
            parts = list(map(get, words))
            at = -1
            for _ in range(parts.count(None)):
                at = parts.index(None, at + 1)
                holes.append((parts, at, words[at]))
            out.append(parts)
        new = list({w for _, _, w in holes})
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        for parts, at, word in holes:
            parts[at] = self.known[word]
        return [b"".join(parts) for parts in out]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit) for each piece."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        own = encoder(path)
        for batch in batches:
            keys, texts = batch["doc_id"], batch["text"]
            for i in range(0, len(keys), TEXTS):
                out = []
                for key, ids in zip(keys[i : i + TEXTS], own.encode(texts[i : i + TEXTS]), strict=True):
                    ids += tail
                    total = len(ids) // 4
                    out += [(key, at, min(size, total - at), total, ids[4 * at : 4 * (at + size)]) for at in range(0, total, size)]
                yield dict(zip(("doc_id", "start", "length", "doc_tokens", "ids"), zip(*out, strict=True), strict=True))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_lists(rows, cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, how many, first sequence, offset); ranks count from 0 in each length."""
    out: list[tuple[int, int, int, int, int]] = []
    runs: list[tuple[int, int, int]] = []  # (fill, first sequence, how many), the emptiest on top
    sequences = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if runs and runs[0][0] + length <= size:
                fill, first, n = heapq.heappop(runs)
                if n > left:
                    heapq.heappush(runs, (fill, first + left, n - left))
                n = min(n, left)
            else:  # new packs, each with as many of this length as it holds
                fill, first, n = 0, sequences, -(-left // max(1, size // length))
                sequences += n
            # as many of the length as still fit go side by side into each pack of the run if all runs are fuller
            out.append((length, rank, n, first, fill))
            rank, left = rank + n, left - n
            if fill + length < size:
                heapq.heappush(runs, (fill + length, first, n))
    return out


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table with doc_id, start and length, written and not computed anew)."""
    spark = cut.sparkSession
    histogram = {int(k): int(n) for k, n in cut.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most size rows
    salts = F.broadcast(spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, salts int"))
    cut = cut.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "doc_id", "start"), F.col("salts")).cast("int")).drop("salts")
    counts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row for RANKED pieces, and one for each length
    placed = plan(histogram, size)
    counts = counts.sort_values(["length", "salt"])
    counts["before"] = counts.groupby("length")["n"].cumsum() - counts["n"]
    starts = F.broadcast(spark.createDataFrame(counts[["length", "salt", "before"]].astype({"length": "int64"}), "length long, salt int, before long"))
    table = F.broadcast(spark.createDataFrame(pd.DataFrame(placed, columns=["length", "first_rank", "n", "first_sequence", "offset"]), "length long, first_rank long, n long, first_sequence long, offset long"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = cut.withColumn("within", F.row_number().over(within) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    joined = ranked.join(table, (ranked["length"] == table["length"]) & (ranked["rank"] >= table["first_rank"]) & (ranked["rank"] < table["first_rank"] + table["n"])).drop(table["length"])
    return joined.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank")).drop("salt", "before", "within", "rank", "first_rank", "n", "first_sequence")


def sequences(packed: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids padded to size unless their number is a power of two, doc_ids."""
    body = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    n = F.sum("length")
    hexed = F.array_join(F.transform(body, lambda p: F.hex(p["ids"])), "")
    short = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(F.lit(size) - n)
    filler = F.repeat(F.lit(pad.to_bytes(4, "little").hex()), short.cast("int"))
    return packed.groupBy("sequence_id").agg(F.unhex(F.concat(hexed, filler)).alias("ids"), n.alias("n_tokens"), F.transform(body, lambda p: p["doc_id"]).alias("doc_ids"))


def digest(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    cut = pieces(docs, path, size).withColumn("ids_crc32", F.crc32("ids"))
    return pack(written(cut.drop("ids"), "pieces"), size).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
