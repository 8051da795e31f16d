"""Personal data by bootstrapped contextual extraction.

Regular expressions find the base spans (email, ip, card, phone); those are the seeds. Their neighbouring words are
lexical patterns. Over the graph of patterns and instances (identifier-like tokens), Spark scores in turns: a pattern
by the share of its distinct instances that belong to a kind, an instance by its patterns together (noisy or). Patterns
need PATTERN_SUPPORT distinct instances and PATTERN_SCORE; instances of INSTANCE_SCORE or more that were not seeds are new
identifiers, and count as seeds of the next round. Base spans always stay.

Values and patterns travel as 128-bit hashes, so rows are small whatever the length of a token or word; 2e12 distinct values
make a collision among them less likely than one in a hundred trillion.

Defined results: null text is empty and has no spans; rows that repeat a doc_id are judged by their own texts; an empty
table gives an empty result; a value found under two kinds takes the better scored, then the first in KINDS. Tokens and
context words count at any length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists, written

KINDS = ("email", "ip", "card", "phone")
PATTERN_SUPPORT = 5
PATTERN_SCORE = 0.8
INSTANCE_SCORE = 0.9
ROUNDS = 2
#: Fewest characters of a token that may be an identifier.
LEAST = 6

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]").search
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place in KINDS, start, end) by kind, then start."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                done = m.end()
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(digits := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _shape(word: str) -> str:
    return re.sub(r"[0-9]", "0", word.lower())


def _key(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "replace"))


def contexts(words: list[tuple[int, int, str]], starts: list[int], start: int, end: int) -> list[str]:
    """The patterns around a span: the two words before it, and one on either side. words: (start, end, text) in order.

    A span inside a word has that word's other parts as its neighbours.
    """
    at = bisect_left(starts, start)
    before = words[max(0, at - 2) : at]
    near = [w[: max(0, start - a)] if b > start else w for a, b, w in before]
    after = bisect_left(starts, end)
    rest = ""
    if after and words[after - 1][1] > end:  # the word that the span ends in
        rest = words[after - 1][2][end - words[after - 1][0] :]
    elif after < len(words):
        rest = words[after][2]
    left = [_shape(w) for w in near]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and rest:
        out.append(f"{left[-1]} _ {_shape(rest)}")
    return out


def occurrences(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """The base spans, and every base span and identifier-like token with its patterns; kind -1 for those that are no base span."""
    spans = base_spans(text)
    if not spans and not _MARK(text):
        return [], []
    words = [(*m.span(), m[0]) for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]
    row = lambda k, s, e: {"kind": k, "at": s, "end": e, "value": _key(text[s:e]), "patterns": [*map(_key, contexts(words, starts, s, e))]}
    seen = [row(k, s, e) for k, s, e in spans]
    taken = sorted((s, e) for _, s, e in spans)
    ends: list[int] = []  # the furthest end so far, as spans of different kinds may overlap
    for _, e in taken:
        ends.append(max(e, ends[-1] if ends else 0))
    first = [s for s, _ in taken]
    for s, e, word in words:
        if e - s >= LEAST and _MARK(word):
            at = bisect_left(first, e)  # the spans that begin before the word's end
            if not at or ends[at - 1] <= s:
                seen.append(row(-1, s, e))
    return spans, seen


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: row key, counts, base spans, and occurrences (kind, span, value, patterns)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row_key", *(f"n_{k}" for k in KINDS), "base", "seen")}
            for text in batch["text"]:
                spans, seen = occurrences(text or "")
                out["row_key"].append(_key(text or ""))
                for i, k in enumerate(KINDS):
                    out[f"n_{k}"].append(sum(s[0] == i for s in spans))
                out["base"].append([x for s in spans for x in s])
                out["seen"].append(seen)
            yield {"doc_id": batch["doc_id"]} | out

    seen = "array<struct<kind int, at long, end long, value string, patterns array<string>>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_lists(rows, run, f"doc_id long, row_key string, {', '.join(f'n_{k} long' for k in KINDS)}, base array<long>, seen {seen}")


def discover(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """value, kind and score of instances beyond the seeds, from occurrences (kind, value, patterns)."""
    edges = occurrences.select("value", F.explode("patterns").alias("pattern")).distinct()
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PATTERN_SUPPORT)
    edges = written(edges.join(sizes, "pattern"), "pii-edges")
    seeds = occurrences.where("kind >= 0").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    known = seeds
    found = None
    for _ in range(rounds):
        support = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("own"), F.max("n").alias("n"))
        patterns = support.where((F.col("own") >= PATTERN_SUPPORT) & (F.col("own") / F.col("n") >= PATTERN_SCORE)).select("pattern", "kind", (F.col("own") / F.col("n")).alias("p"))
        scored = edges.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("p") * 0.999)))).alias("score")).where(F.col("score") >= INSTANCE_SCORE)
        best = scored.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        found = written(best.join(seeds.select("value"), "value", "left_anti"), "pii-found")
        known = seeds.unionByName(found)
    return found


def extract(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: doc_id, counts, base spans and all spans, each [kind, start, end, ...] by kind and start."""
    rows = written(scan(docs), "pii-scan")
    seen = rows.select("doc_id", "row_key", F.inline("seen"))
    new = discover(seen, rounds)
    extra = seen.where("kind < 0").drop("kind").join(new, "value").select("doc_id", "row_key", "kind", "at", "end").distinct()
    extra = extra.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct(F.col("kind").cast("long").alias("k"), F.col("at").alias("s"), F.col("end").alias("e")))).alias("extra"))
    r, x = rows.drop("seen").alias("r"), extra.alias("x")
    joined = r.join(x, F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("r.row_key") == F.col("x.row_key")), "left").select("r.*", "x.extra")
    base = F.expr("transform(sequence(0, cast(size(base) / 3 as int) - 1), i -> struct(base[3 * i] as k, base[3 * i + 1] as s, base[3 * i + 2] as e))")
    base = F.when(F.size("base") > 0, base).otherwise(F.from_json(F.lit("[]"), "array<struct<k long, s long, e long>>"))
    joined = joined.withColumn("base", base)
    return joined.withColumn("all", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))).drop("extra", "row_key")


def digest(docs: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["k"].cast("int")), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return extract(docs).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(said("base"), 256).alias("base_sha256"), said("all").alias("spans"))
