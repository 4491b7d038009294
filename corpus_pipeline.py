"""A corpus from documents to packed sequences: five stages over everything their predecessor kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs.  All but the last return the columns of documents.

In every stage a missing text counts as an empty one and stays missing, a missing id is one more value, rows that repeat id
and text stay or go together (exact dedup leaves one of them), further columns are carried along, and an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliochron.llm.common import stored
from heliochron.llm.exact import exact_dedup
from heliochron.llm.packing import pack_documents
from heliochron.llm.quality import keep_good
from heliochron.llm.simhash import drop_near_copies
from heliochron.llm.suffix import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier in the corpus are taken out of the texts."""
    return without_repeats(docs, 100)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2048 ids."""
    import public_tokenizers
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("suffix-array dedup", repeats),
          ("best-fit packing", packing)]

#: Scores, fingerprints and token ids have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
