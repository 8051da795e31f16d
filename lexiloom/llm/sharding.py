"""Sharding by a two-pass external shuffle.

Pass one scatters rows into buckets by seeded hashes: the shard is the jump consistent hash of the hashed key, so
one more shard takes rows only into itself, and the bucket within a shard comes from a second hash, with as many
buckets as keep each one below ``bucket_bytes``. Pass two brings each bucket into one task, applies a Fisher-Yates
shuffle seeded by the bucket's number and writes it. Nothing but the count per bucket, one row for each bucket,
is gathered anywhere.

A bucket number is the hash of key and text, so rows that repeat both would fill one bucket. Where such rows outgrow a
bucket, they alone are dealt to it and the extra buckets after it by their place in the input.

Defined results: a null key is a key of its own; a null text has no bytes; rows with equal keys share the shard, and
their buckets differ by text; an empty table gives empty shards; other columns are carried unless they clash with the
added names, which win.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, new_path, text_of, written

LAW = "key"
ADDED = ("shard", "bucket", "place", "grown_shard")
#: Most repeated rows (by their hashes) that are broadcast; more of them are joined by a shuffle.
MOST_HOT = 100_000


def jump_hash(key: Column, n: int, seed: int) -> Column:
    """Jump consistent hash as one expression. In step b, the key moves to bucket b with probability 1/(b+1).

    The draws of a key are independent seeded hashes, one for each bucket number, so growing n by one only adds a draw.
    """
    out = F.lit(0)
    for b in range(1, n):
        draw = F.pmod(F.xxhash64(F.lit(seed + b), key), F.lit(b + 1).cast("long"))
        out = F.when(draw == 0, F.lit(b)).otherwise(out)
    return out.cast("int")


def _rehash(column: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), column)


def shard_rows(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", seed: int = 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Scatters, shuffles and writes; returns the written rows with shard, bucket, place (in its bucket) and grown_shard."""
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    total = docs.agg(F.sum(F.octet_length(text_of(docs, text)) + 64)).first()[0] or 0
    per_shard = max(1, -(-int(total) // (shards * bucket_bytes)))
    hashed = _rehash(docs[key], seed)
    row_hash = F.xxhash64(F.lit(seed + 1), docs[key], docs[text])
    scattered = docs.withColumns({
        "shard": jump_hash(hashed, shards, seed),
        "grown_shard": jump_hash(hashed, shards + 1, seed),
        "bucket": F.pmod(row_hash, F.lit(per_shard)).cast("int"),
    })
    same, parts, row = fresh(scattered, "same", "parts", "row")
    repeats = docs.groupBy(row_hash.alias(same)).agg(F.ceil(F.sum(F.octet_length(text_of(docs, text)) + 64) / bucket_bytes).cast("int").alias(parts), F.count(F.lit(1)).alias("n"))
    repeats = written(repeats.where(f"n > 1 and {parts} > 1").drop("n"), "repeats")
    n_hot = repeats.count()
    if n_hot:
        numbered = scattered.withColumns({same: row_hash, row: F.monotonically_increasing_id()})
        joined = numbered.join(F.broadcast(repeats) if n_hot <= MOST_HOT else repeats, same, "left")
        extra = F.pmod(F.xxhash64(F.lit(seed + 2), row), F.coalesce(parts, F.lit(1))) * per_shard
        scattered = joined.withColumn("bucket", (F.col("bucket") + extra).cast("int")).drop(same, parts, row)
    schema = T.StructType([*scattered.schema.fields, T.StructField("place", T.LongType())])

    def mix(group: pa.Table) -> pa.Table:
        n = group.num_rows
        order = [(c, "ascending") for c in group.column_names if pa.types.is_integer(group.schema.field(c).type) or c == text]
        group = group.sort_by(order)  # the same start in every attempt
        numbers = np.random.default_rng([seed, group["shard"][0].as_py(), group["bucket"][0].as_py()])
        at = np.arange(n)
        picks = (numbers.random(n) * np.arange(1, n + 1)).astype(np.int64)
        for i in range(n - 1, 0, -1):  # Fisher-Yates
            j = picks[i]
            at[i], at[j] = at[j], at[i]
        return group.take(pa.array(at)).append_column("place", pa.array(np.arange(n)))

    path = new_path(spark, "shards")
    scattered.groupBy("shard", "bucket").applyInArrow(mix, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_slots(sharded: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, from the counts per bucket."""
    counts = sharded.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first_slot", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return sharded.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("first_slot") + F.col("place")).cast("long")).drop("first_slot")


def digest(docs: DataFrame, **options) -> DataFrame:
    out = shard_rows(docs, **options)
    facts = out.select(
        "doc_id",
        (F.octet_length(text_of(out)) + 8).cast("long").alias("size"),
        F.crc32(text_of(out).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "bucket",
        "place",
        "grown_shard",
    )
    return with_slots(facts).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
