"""Helpers that several operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def by_position(df: DataFrame) -> DataFrame:
    """The same rows under the names c0, c1, ...: clashing or repeated names no longer matter."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def position(df: DataFrame, name: str) -> str:
    """The name that :func:`by_position` gives the first column called ``name``, exact spelling first."""
    cols = df.columns
    if name in cols:
        return f"c{cols.index(name)}"
    low = [c.lower() for c in cols]
    if name.lower() in low:
        return f"c{low.index(name.lower())}"
    raise ValueError(f"no column named {name}")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of any table of documents: long ids, a missing text is empty."""
    flat = by_position(docs)
    return flat.select(F.col(position(docs, id_col)).cast("long").alias("doc_id"),
                       F.coalesce(F.col(position(docs, text_col)).cast("string"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the quick way, which is the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back.

    Cuts the lineage: what reads the result needs neither the plan behind it nor any one executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it executors delete the shuffle files of a query when it ends, rather than when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # since Spark 4.1; without effect before
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle of this session makes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those of the smallest hash of the key: the same ones at every run.

    Of a large table only about 4 * n rows are ordered, whatever the number of tasks.
    """
    h, total = F.xxhash64(key), df.count()
    bound = min((1 << 63) - 1, int(-(1 << 63) + min(1.0, 4 * n / max(1, total)) * (1 << 64)))
    return df.where(h <= bound).orderBy(h, key).limit(n)


def smallest_each(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """At most n rows for each value of ``by``, those of the smallest hash of the key; about 4 * n of each are ordered."""
    h, totals = F.xxhash64(key), df.groupBy(by).agg(F.count("*").alias("total_"))
    bound = F.when(F.col("total_") <= 4 * n, (1 << 63) - 1).otherwise((-(1 << 63) + F.lit(4.0 * n) / F.col("total_") * float(1 << 64)).cast("long"))
    order = Window.partitionBy(by).orderBy(h, key)
    return (df.join(F.broadcast(totals), by).where(h <= bound).withColumn("rank_", F.row_number().over(order))  # one row a value of ``by``
            .where(F.col("rank_") <= n).select(*df.columns))


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker: tables that every task would build again."""
    return sys.modules.setdefault("heliochron_llm_worker_state", types.ModuleType("heliochron_llm_worker_state")).__dict__


def in_slices(rows: Iterable[tuple], weight: int = 4 << 20) -> Iterator[list[tuple]]:
    """Lists of rows (id, text, ...) of about ``weight`` characters, so that a task holds little at once."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        out.append(row)
        held += len(row[1]) + 64
        if held >= weight:
            yield out
            out, held = [], 0
    if out:
        yield out


def give_back() -> None:
    """Hand memory that is free but kept by the allocators back: workers live on from stage to stage."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with every C library
        pass


def rows_of(batches, *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a thousand at a time; memory is given back when all have been read."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield from zip(*(part.column(n).to_pylist() for n in names))
    give_back()
