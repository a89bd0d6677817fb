"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
``docs``.  All but the last return the columns of ``documents``.

* quality: documents that the compression classifier scores below its threshold go.
* near_duplicates: of each group of rows linked by 5-word shingles at similarity 0.8 the one with the least id stays (null ids last; of one id any).
  Rows without words aren't linked and stay.
* repeated_passages: bytes covered by a repeated string of ``PASSAGE_BYTES`` bytes are taken out of the texts; no document goes.
* mixing: documents are laid out in the order of the Pfair schedule for the target shares; no document goes.
* packing: documents are packed, in the order of the schedule, into sequences of at most 1024 tokens; one row for each piece.  Reading a
  table again doesn't keep the order of its files, so the schedule is made again from the rows.

Null texts are empty.  Columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dexlake.llm.common import cut, drop, table
from dexlake.llm.jaccard_join import jaccard_components
from dexlake.llm.mixing import mixed
from dexlake.llm.packing import added_tokens, pack
from dexlake.llm.quality import THRESHOLD, learn_quality, score_quality
from dexlake.llm.queries import SHARES, held_out
from dexlake.llm.suffix_dedup import deduplicated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A passage of over 50 words is longer than this in the languages of the corpus; the grams that deal windows out are half as long.
PASSAGE_BYTES = 240


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _known(docs)
    model = learn_quality(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return score_quality(docs, model, score_col="_score").where(F.col("_score") >= THRESHOLD).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _known(docs)
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        gone = jaccard_components(docs).where("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # ids that are null or repeated don't tell rows apart: written numbers do
    numbered = cut(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    linked = jaccard_components(numbered, id_col="row").join(numbered.select("row", "doc_id"), "row")
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    return numbered.join(first, "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = deduplicated(_known(docs), window=PASSAGE_BYTES, gram=PASSAGE_BYTES // 2)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(_known(docs), SHARES)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    special = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    ordered = mixed(docs.select("doc_id", "source", "text"), SHARES)
    return pack(ordered, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: The quality scores, and so all that follows from them, can't be had from SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
