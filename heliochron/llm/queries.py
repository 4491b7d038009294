"""The registered queries of the operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    from .packing import pack_documents
    packed = pack_documents(documents(spark, sf), vocabulary("byte_bpe_50k.json"), 2048, 0, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_token_files")
def token_files(spark: SparkSession, sf: str) -> DataFrame:
    from .binary import read_tokens, write_tokens
    path = scratch_path(spark, "token-files")
    write_tokens(documents(spark, sf), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path, with_ids=False)


@query("op8_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .simhash import near_duplicates
    found = near_duplicates(documents(spark, sf), shingle=3, budget=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_exact_dedup", """WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d""")
def exact_dedup_decisions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import stored
    from .exact import decide, digests
    decided = decide(stored(digests(documents(spark, sf)), "digests"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op6_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .suffix import repeat_digests
    return repeat_digests(documents(spark, sf), 100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op4_license_scan")
def license_scan(spark: SparkSession, sf: str) -> DataFrame:
    from .licenses import scan
    return scan(documents(spark, sf)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from .quality import classify
    return classify(documents(spark, sf), labels(spark, sf), sample=8_000)


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    from .rules import judge
    return judge(documents(spark, sf), labels(spark, sf), sample=20_000)


@query("op9_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    from .language import identify
    return identify(documents(spark, sf), sample=20_000)


@query("op3_bpe_chunk_reuse")
def bpe_chunk_reuse(spark: SparkSession, sf: str) -> DataFrame:
    from .bpe import decode_documents, encode_documents
    path = vocabulary("byte_bpe_50k.json")
    return decode_documents(encode_documents(documents(spark, sf), path), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op11_secret_scan")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    from .secrets import find_secrets
    return find_secrets(documents(spark, sf))


@query("op12_conversation_repair")
def conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    from .conversations import repaired_conversations
    return repaired_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    from .periods import periodic_runs as found
    return found(documents(spark, sf))
