"""Helpers that the operators share: table access, the shared working folder, text defaults."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


#: Rows in an Arrow batch: texts may be long, and a batch lies in memory whole.
BATCH_ROWS = 1000


def tuned(spark: SparkSession) -> SparkSession:
    """Sets what the operators need of a session: small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; one of our own only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexiloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: df as Parquet in the shared folder, read again. Lost executors cost no recomputation of it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name like each of names that no column of df has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_lists(df: DataFrame, run: Callable[[Iterator[dict[str, list]]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over plain lists: run takes and yields columns by name. Whole numbers stay exact beside nulls (pandas would
    turn them into doubles)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names, struct = df.columns, T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ({n: batch.column(i).to_pylist() for i, n in enumerate(names)} for batch in batches)
        for out in run(lists):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()  # workers are reused, and would keep it

    return df.mapInArrow(each, struct)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


#: White space as the tokenizer libraries see it (the Unicode property), in a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def latin_class(kind: str) -> str:
    """The characters below 256 of a general category, for a character class."""
    import unicodedata

    return "".join(chr(c) for c in range(256) if unicodedata.category(chr(c)).startswith(kind))


class Finder:
    """findall of a pattern with \\p{L}, \\p{N} and <white> in its classes; texts of Latin-1 alone take a faster engine."""

    def __init__(self, pattern: str):
        import re

        import regex

        self.full = regex.compile(pattern.replace("<white>", WHITE)).findall
        latin = pattern.replace("<white>", "\\t-\\r \\x85\\xa0").replace("[\\p{L}]", f"[{latin_class('L')}]").replace("[\\p{N}]", f"[{latin_class('N')}]")
        self.latin = re.compile(latin.replace("\\p{L}", latin_class("L")).replace("\\p{N}", latin_class("N"))).findall
        self.beyond = re.compile("[^\x00-\xff]").search

    def __call__(self, text: str) -> list[str]:
        return self.full(text) if self.beyond(text) else self.latin(text)
