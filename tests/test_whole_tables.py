"""Queries over whole tables against brute force."""

import collections
import functools
import hashlib
import random
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd

from lexiloom.functions.text import SPELT
from lexiloom.operators import joins, lexicon
from lexiloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def read(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


def rows(spark, name):
    return sorted(map(tuple, catalogue.QUERIES[name](spark, DATA).toPandas().astype(int).to_numpy().tolist()))


def test_line_ids_of_all_documents(spark):
    want = []
    for doc, text in read("documents")[["doc_id", "text"]].itertuples(index=False):
        line = 0
        for i, c in enumerate(text or ""):
            if c == "\n":
                line += 1
            else:
                want.append((doc, i, line))
    assert rows(spark, "line_ids") == sorted(want)


def test_components_of_all_lineitems(spark):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for part, supp in read("lineitem")[["l_partkey", "l_suppkey"]].itertuples(index=False):
        x, y = find(part), find(-1 - supp)
        root[max(x, y)] = min(x, y)
    assert rows(spark, "components") == sorted((x, find(x)) for x in list(root))


def test_segments_of_all_images(spark):
    want = []
    for vec, px in read("embeddings")[["vec_id", "embedding"]].itertuples(index=False):
        left = {(i % 8, i // 8) for i, v in enumerate(px) if abs(v) > 0.1}
        while left:
            group, todo = [], [left.pop()]
            while todo:
                x, y = todo.pop()
                group.append((x, y))
                near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            xs, ys = zip(*group, strict=True)
            want.append((vec, min(xs), max(xs), min(ys), max(ys), len(group)))
    assert rows(spark, "segment_components") == sorted(want)


def shingles(text):
    w = [x for x in re.split("[ \t\n\x0b\f\r]+", text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_copies_and_their_blocks(spark):
    docs = dict(read("documents")[["doc_id", "text"]].itertuples(index=False))
    sets = {k: s for k, t in docs.items() if (s := shingles(t))}
    holders = collections.defaultdict(list)
    for k in sorted(sets):
        for s in sets[k]:
            holders[s].append(k)
    near = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    want = {b: min(hits) for b in sets if (hits := {a for s in sets[b] for a in holders[s] if a < b and near(a, b)})}
    got = {r.later: r.first for r in joins.copy_pairs(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect()}
    assert want and got == want
    short = {b: a for b, a in want.items() if len(docs[b]) < 8000}
    blocks = sorted((f"{a}-{b}", *m) for b, a in short.items() for m in SequenceMatcher(None, docs[a], docs[b], False).get_matching_blocks() if m.size)
    whole = catalogue.QUERIES["matching_blocks"](spark, DATA).collect()
    assert {r.pair for r in whole} == {f"{a}-{b}" for b, a in want.items()}
    assert sorted(tuple(r) for r in whole if int(r.pair.split("-")[1]) in short) == blocks


def test_copy_pairs_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, long, 0), (2, long + " end", 0), (3, None, 0), (4, "", 0), (5, "a b c d", 0), (6, "a b c d", 0), (7, "a b c d e", 0), (8, " a  b\nc d e ", 0), (None, "a b c d e", 0)]
    df = spark.createDataFrame(rows, "id long, body string, first int")
    assert sorted(map(tuple, joins.copy_pairs(df, "id", "body").collect())) == [(1, 2), (7, 8)]
    assert joins.copy_pairs(df.limit(0), "id", "body").collect() == []


def test_common_blocks_equal_difflib(monkeypatch):
    rng = random.Random(1)
    for cells in (0, 1 << 14):
        monkeypatch.setattr(lexicon, "SMALL_SLICE", cells)
        for t in range(200):
            letters = "ab" if t % 3 else "abcdeé\U0001f600 "
            draw = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(120)))  # noqa: E731, B023
            x = draw()
            y = x[: rng.randrange(len(x) + 1)] + draw()[:9] + x[rng.randrange(len(x) + 1) :] if t % 4 else draw()
            assert lexicon.common_blocks(x, y) == [tuple(m) for m in SequenceMatcher(None, x, y, False).get_matching_blocks() if m.size]


def test_normaliser_of_all_documents(spark):
    want = []
    for doc, text in read("documents")[["doc_id", "text"]].itertuples(index=False):
        spelt = functools.reduce(lambda t, e: t.replace(*e), SPELT, (text or "").lower())
        norm = "".join(c for c in unicodedata.normalize("NFKD", spelt) if unicodedata.category(c) != "Mn")
        want.append((doc, hashlib.md5(norm.encode()).hexdigest(), len(norm)))
    assert sorted(map(tuple, catalogue.QUERIES["normalize_with_map"](spark, DATA).collect())) == sorted(want)


def test_bearings_equal_a_library(spark):
    c = read("customer").groupby(["c_nationkey", "c_mktsegment"])["c_acctbal"].agg(["mean", "size"]).reset_index()
    names = sorted({f"n{n}" for n in c["c_nationkey"]} | {f"s{s}" for s in c["c_mktsegment"]})
    m, v = np.zeros((len(c) + 1, len(names))), np.zeros(len(c) + 1)
    for i, (nation, segment, mean, n) in enumerate(c.itertuples(index=False)):
        root = np.sqrt(n)
        m[i, names.index(f"n{nation}")], m[i, names.index(f"s{segment}")], v[i] = root, root, root * mean
    m[-1, names.index("sBUILDING")] = np.sqrt(1000)
    want = dict(zip(names, np.linalg.lstsq(m, v, rcond=None)[0], strict=True))
    got = {r.unknown: r.x for r in catalogue.QUERIES["wls_bearings"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_point_in_box_of_larger_and_odd_tables(spark, tmp_path):
    """sf0.001 has no box at the point, so the comparison there is of two empty results."""
    import duckdb

    odd = read("lineitem").head(6).assign(l_orderkey=[7, 507, 64, 563, -3, 1], l_partkey=[140, 440, 149, 149, 149, 148], l_suppkey=30, l_quantity=[20.0, 30.0, 1.6, 1.4, 9.0, 2.5], l_extendedprice=[5.0, 4.0, 3.0, 2.0, 1.0, np.nan])
    odd.to_parquet(tmp_path / "lineitem.parquet")
    for folder in ("/root/testdata/sf0.01", str(tmp_path)):
        con = duckdb.connect()
        con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
        want = con.execute(catalogue.SQL["point_in_box"]).fetchall()
        got = catalogue.QUERIES["point_in_box"](spark, folder).select("page", "score").collect()
        assert want and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_normaliser_sends_bounded_batches(spark, monkeypatch):
    """Places as numbers, in batches of bounded length, whatever the length of the texts; equal to the plain rule."""
    from lexiloom.functions import text

    texts = [None, "", "Æſß éÉ\U0001d400 ﷺ İ́ǆ", "x" * 70_000, *("åß" * n for n in range(300)), "Σας Å²\x00퟿"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string").coalesce(1)
    for chars in (1, 1000, text.NORM_CHARS):
        monkeypatch.setattr(text, "NORM_CHARS", chars)
        got = {r.id: (r.norm, r.places) for r in text.normalise_texts(rows, "id", "body").collect()}
        assert got == {i: text.normalise_with_map(t or "") for i, t in enumerate(texts)}


def test_near_components_equal_brute_force(spark, monkeypatch):
    """Links between far ends of chains, islands, copies, a repeated key and a null vector; with small hubs and blocks as well."""
    from lexiloom.operators import boxes

    rng = np.random.default_rng(3)
    points = [*np.cumsum(rng.normal(0, 0.06, (150, 3)), axis=0), *rng.normal(0, 1, (80, 3)), *rng.normal(5, 0.02, (30, 3)), *[np.ones(3) * 9] * 4, np.ones(3) * 20, np.ones(3) * 20]
    keys = [*range(1000, 1000 - len(points) + 1, -1), 1000 - len(points) + 2]  # the last two rows have one key, and no link
    x = np.array(points, np.float32).astype(np.float64)
    link = (np.abs(x[:, None] - x[None]).mean(axis=2) < 0.112) & (np.array(keys)[:, None] != np.array(keys)[None])
    comp = {k: k for k, row in zip(keys, link, strict=True) if row.any()}
    for _ in keys:
        for i, j in zip(*np.nonzero(link), strict=True):
            comp[keys[i]] = comp[keys[j]] = min(comp[keys[i]], comp[keys[j]])
    rows = spark.createDataFrame([*((k, [float(f) for f in p]) for k, p in zip(keys, x, strict=True)), (5000, None)], "id long, v array<float>")
    for hub, block in ((4096, 1 << 14), (40, 16), (1, 1000), (300, 7)):
        monkeypatch.setattr(boxes, "HUB", hub)
        monkeypatch.setattr(boxes, "BLOCK", block)
        assert dict(map(tuple, boxes.near_components(rows, "id", "v", 0.112).collect())) == comp
    assert boxes.near_components(rows.limit(0), "id", "v", 0.112).collect() == []


def test_near_components_hold_no_pairs(spark):
    """Of 3000 vectors that are all alike, one link a vector is kept, not 4.5 million."""
    from lexiloom.operators import boxes

    rows = spark.range(3000).selectExpr("id", "array(cast(id as float) / 1e6f) as v")
    assert boxes.near_links(rows, "id", "v", 0.112).count() <= 3000


def test_copy_pairs_behind_unlike_holders(spark):
    """Near copies whose every shingle is held by earlier, unlike rows, at depths in and beyond the first windows."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    lines = [" ".join(word() for _ in range(12)) for _ in range(4)]
    texts = [f"{lines[i % 4]} {' '.join(word() for _ in range(60))}" for i in range(100)]
    texts += [" ".join(lines), " ".join(lines) + " end", "start " + " ".join(lines), None, " ".join(lines[:2])]
    sets = [shingles(t) for t in texts]
    near = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    want = sorted((min(hits), b) for b in range(len(texts)) if sets[b] and (hits := [a for a in range(b) if sets[a] and near(a, b)]))
    assert want == [(100, 101), (100, 102)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    assert sorted(map(tuple, joins.copy_pairs(df, "id", "body").select("first", "later").collect())) == want
