"""The corpus pipeline: documents pass the stages in order, each written as Parquet and reread by the next.

1. quality: documents that the quality classifier scores below 0.5 go.
2. near_dedup: of each group of near duplicates (similarity of 0.8 or more) the document with the smallest doc_id stays.
3. decontamination: documents that hold a passage of the benchmark go.
4. secrets: secrets in the text are replaced by a mark; every document stays.
5. encoding: texts become token ids.

Null and empty texts pass every stage (quality: by the score of an empty text) and become no tokens. Rows without a doc_id
can be neither labelled nor anyone's copy, so only their own text can remove them, in quality. Repeated rows of one doc_id have one
fate. Columns beyond those of documents are dropped; empty tables give empty results, and without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, near_dedup, quality, secrets, sentencepiece_codec
from graphloom.llm.shared import crc_fold, small_side, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIMILARITY = 80  # percent of the union that near duplicates share


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score 0.5 or more; the classifier learns from the labels of this stage's own documents, outside its held-out fold.

    Without a label every score is 0.5 and all documents stay. A null text is scored as an empty one and stays null.
    """
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    docs = docs.select(*COLUMNS)
    return quality.scored(docs, quality.fit(docs, labels)).where("score >= 0.5").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Repeated rows of one doc_id count as one; rows without a doc_id stay."""
    docs = docs.select(*COLUMNS)
    gone = written(near_dedup.near_duplicates(docs, percent=SIMILARITY).where("not kept").select("doc_id").distinct())
    return docs.join(small_side(gone, gone.count()), "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark. Rows without a doc_id stay; an empty benchmark rejects none."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; null texts stay null."""
    return secrets.redacted(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, parity and round_trip of every row; a null or empty text has no tokens."""
    return sentencepiece_codec.encoded(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("secrets", secret_stage), ("encoding", encoding_stage)]

#: The classifier and the token ids can't be expressed in SQL. tests/llm holds the stages against brute force: near duplicates and
#: decontamination against all pairs and all windows, tokens against the library, the rest by held-out labels and planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
