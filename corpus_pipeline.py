"""A corpus pipeline of five stages: quality, exact copies, near copies, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet below the shared
folder and reads it again as the next stage's ``docs``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import cotraining, exact_dedup, mixing, near_dup, packing
from fleetlens.llm.common import Scratch, sized, table


def _keyed(docs: DataFrame, tmp: Scratch) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for every row, and the key's name: the doc_id, but for rows without one and repeats of one.

    These get numbers above all ids. The rows are kept as a table first, so that the numbers stay the same.
    """
    key, row = (next(n for n in (c, *(f"{c}{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns) for c in ("_key", "_row"))
    rows = docs.withColumn(key, F.col("doc_id").cast("long"))
    rows_, ids, last = rows.agg(F.count(F.lit(1)), F.count_distinct(key), F.max(key)).first()
    if rows_ == ids:
        return rows, key
    rows = tmp.keep(rows.withColumn(row, F.monotonically_increasing_id()), "rows")
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = rows.join(sized(tmp.keep(first, "repeated")).select(F.col(key).alias("repeated"), "first"), F.col(key) == F.col("repeated"), "left")
    own = F.col(key).isNotNull() & (F.col("repeated").isNull() | (F.col(row) == F.col("first")))
    twice = twice.withColumn(key, F.when(own, F.col(key)).otherwise(F.lit((last or 0) + 1) + F.col(row)))
    return tmp.keep(twice.select(*docs.columns, key), "rows"), key


def _decide(docs: DataFrame, operator: Callable[[DataFrame, Scratch], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``operator`` keeps: it sees one id for each row, and answers (doc_id, kept)."""
    tmp = Scratch(docs.sparkSession)
    rows, key = _keyed(docs, tmp)
    verdict = operator(rows.withColumn("doc_id", F.col(key)).drop(key), tmp)
    gone = tmp.keep(verdict.where("not kept").select(F.col("doc_id").alias(key)), "dropped")
    return rows.join(sized(gone), key, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier does not reject; null text counts as empty, equal rows fare alike."""
    scored = cotraining.quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(scored.columns[-1])).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, also among rows without an id and rows that repeat one."""
    return _decide(docs, lambda d, tmp: exact_dedup.exact_duplicates(d, tmp=tmp))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, whatever their ids: five-word shingles, similarity 0.8; rows without words stay."""
    return _decide(docs, lambda d, tmp: near_dup.near_duplicates(d, width=5, tmp=tmp))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn to the target weights of sources, languages and topics; a row without an id has a draw of its own."""
    return _decide(docs, lambda d, tmp: mixing.mix(d, tmp=tmp).select("doc_id", F.col("sampled").alias("kept")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; each row is packed, null text counts as empty."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("packing", packed)]

#: The classifier and the tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tmp.keep(stage(spark, docs, sf_dir), name)
    return docs
