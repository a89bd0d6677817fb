"""The thin ``opN_<name>`` queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dexlake.llm.common import table


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from dexlake.llm.token_count import count_tokens, vocabulary_of

    return count_tokens(table(spark, sf_dir, "documents"), *vocabulary_of(public_tokenizers.path("piece_bpe_32k.model")))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dexlake.llm.order_minhash import order_fingerprints

    return order_fingerprints(table(spark, sf_dir, "documents"))


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dexlake.llm.tiff import text_media

    return text_media(table(spark, sf_dir, "documents"))


def held_out(id_col: str, folds: int, fold: int) -> F.Column:
    """Is crc32 of the id as text in the fold that isn't learned from?  False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


#: Target shares of the sources in op4 and the pipeline; sources that aren't listed share the last part.
SHARES = {"src0": 6} | {f"src{i}": 4 for i in range(1, 5)} | {f"src{i}": 3 for i in range(5, 10)} | {f"src{i}": 2 for i in range(10, 15)} | {f"src{i}": 1 for i in range(15, 20)}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dexlake.llm.mixing import schedule

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    names = {"source": "mix_source", "size": "size", "block": "block", "phase": "phase", "release": "release", "deadline": "deadline", "slot": "slot"}
    return schedule(docs, SHARES).select("doc_id", *[F.col(f"_mix_{k}").alias(v) for k, v in names.items()])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dexlake.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), 24)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dexlake.llm.suffix_dedup import dedup_digests

    return dedup_digests(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dexlake.llm.language_id import identify_languages, learn_languages

    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 5, 0)
    return identify_languages(docs, learn_languages(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dexlake.llm.quality import learn_quality, quality_scores

    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 4, 2)
    model = learn_quality(docs, table(spark, sf_dir, "labels"), ~held)
    return quality_scores(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from dexlake.llm.packing import added_tokens, pack

    special = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dexlake.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_count, op2_order_minhash, op3_tiff, op4_mixing, op5_sharding, op6_suffix_dedup, op7_language_id, op8_quality, op9_packing, op10_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express; the others are tested against brute force, round trips and held-out accuracy."""
    from dexlake.llm.oracles import queries_sql

    return queries_sql(SHARES)
