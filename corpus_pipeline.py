"""From raw documents to token ids, in stages that each read what the one before has written.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return
the columns of documents: the first drops documents that the quality classifier rejects, the
second all but one of exact copies, the third all but one of each group of near copies (five-word
shingles, similarity 0.8 or more), the fourth repeats or drops documents so that sources come
near their target weights. The last returns token ids and a digest of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import bpe, exact_dedup, jaccard, mixing, quality
from tidewake.llm.common import Tables, id_remainder, table
from tidewake.llm.queries import QUALITY_THRESHOLD, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), learn=id_remainder(F.col("id"), 4) != 2)
    return quality.keep_good(docs, model, QUALITY_THRESHOLD)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs, words=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_roundtrip(docs, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Trained classifiers and subword merges have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = Tables(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = written.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
