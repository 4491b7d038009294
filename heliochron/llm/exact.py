"""Exact duplicates by digest, with frequent digests split off.

A Misra-Gries summary names the digests that may be frequent.  Spark's ``approx_top_k`` keeps one: a
bounded set of counters that are all lowered when it is full.  Summaries are made per group of input
partitions, so that none has to be merged over the whole table: a digest that is frequent in the table
is frequent in one of the groups.  The candidates are then counted exactly, and those that hold at
least ``1 / heavy`` of all rows are broadcast: there are at most ``heavy`` of them, whatever the data.
Their rows are decided where they lie.  All other digests are dealt out by an ordinary shuffle, in
which no group is larger than that share.

Two texts are equal if their digests are: SHA-256 of the text after lower-casing A-Z.  Missing texts
are empty texts.  Rows with equal text and equal id are one document that was read twice: they share
every decision, and the filter leaves one of them.  A missing id is smaller than any other.
Everything is DataFrame functions; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, by_position, position, stored, texts_of

HEAVY = 512
GROUPS = 16


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): lower-case hexadecimal SHA-256 of the normalised text."""
    return texts_of(docs).select("doc_id", F.sha2(ascii_lower(F.col("text")), 256).alias("digest"))


def candidates(keys: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Digests that may hold ``1 / heavy`` of the rows; none that does is missing.

    A summary of c counters misses no key above 3.5 / c of its rows, here less than half the share asked
    for; of the keys it counts, fewer than 4 * heavy can reach that share.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS))
    top = (keys.select("digest", group.alias("g")).groupBy("g")
           .agg(F.expr(f"approx_top_k(digest, {4 * heavy}, {8 * heavy})").alias("t")))
    return top.select(F.explode("t.item").alias("digest")).distinct()


def frequent(keys: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(digest, keep_id, group_size) of the digests with at least ``1 / heavy`` of all rows: at most ``heavy`` rows."""
    share = keys.agg(F.count("*")).first()[0] / heavy
    some = F.broadcast(candidates(keys, heavy))  # at most GROUPS * 4 * heavy digests
    counted = keys.join(some, "digest", "left_semi").groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return counted.where(F.col("group_size") >= max(2.0, share))


def decide(keys: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) per row of a stored table of digests; the largest id of equal texts stays."""
    top = stored(frequent(keys, heavy), "frequent-digests")
    split = keys.join(F.broadcast(top), "digest", "left")  # at most `heavy` rows
    own = Window.partitionBy("digest")
    rest = (split.where(F.col("group_size").isNull()).select("doc_id", "digest")
            .withColumns({"keep_id": F.max("doc_id").over(own), "group_size": F.count("*").over(own)}))
    both = split.where(F.col("group_size").isNotNull()).select("doc_id", "digest", "keep_id", "group_size").unionByName(rest)
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The documents with one row of each text left, that of the largest id; columns as they came."""
    keys = stored(digests(docs), "digests")
    top = stored(frequent(keys, heavy), "frequent-digests")
    own = Window.partitionBy("digest")
    rest = keys.join(F.broadcast(top.select("digest")), "digest", "left_anti").withColumn("keep_id", F.max("doc_id").over(own))
    losers = rest.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("digest", "doc_id").distinct().toDF("digest_", "id_")
    text = F.coalesce(F.col(position(docs, "text")).cast("string"), F.lit(""))
    marked = by_position(docs).withColumns({"digest_": F.sha2(ascii_lower(text), 256), "id_": F.col(position(docs, "doc_id")).cast("long")})
    winners = F.broadcast(top.select(F.col("digest").alias("digest_"), F.col("keep_id").alias("top_"), F.lit(True).alias("is_top_")))
    left = marked.join(winners, "digest_", "left").where(F.col("is_top_").isNull() | F.col("id_").eqNullSafe(F.col("top_"))).drop("top_", "is_top_")
    left = _without(left, losers)
    again = stored(keys.groupBy("digest", "doc_id").count().where("count > 1").select("digest", "doc_id").toDF("digest_", "id_"), "read-twice")
    if not again.isEmpty():  # documents that were read more than once
        once = left.join(again, _same(left, again), "left_semi").dropDuplicates(["digest_", "id_"])
        left = _without(left, again).unionByName(once)
    return left.drop("digest_", "id_").toDF(*docs.columns)


def _same(a: DataFrame, b: DataFrame):
    return (a["digest_"] == b["digest_"]) & a["id_"].eqNullSafe(b["id_"])


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, _same(rows, gone), "left_anti")
