"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes every stage's rows as Parquet in the shared folder and reads
them again, so a lost executor costs a stage at most. Who owns the folder removes
what lies there; run() leaves it, as its result is still read from it.

In every stage null and empty texts are documents without words, repeated rows are
rows of their own but for near-duplicates, where one stays, an empty table stays
empty, and columns beside those of documents are carried on to the last stage,
whatever their names. Long texts are worked on whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import bpe, line_dedup, mixing, ngram_join, quality_model
from rostrum.llm.common import WORD, documents, free, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; without labels to learn from, all of them."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.weights is None:
        return docs
    names = free(docs, "score"), free(docs, "predicted")
    return quality_model.score_quality(docs, model, keep=tuple(docs.columns), names=names).filter(F.col(names[1]) == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that consisted of nothing else."""
    names = free(docs, "n_lines"), free(docs, "n_removed")
    cleaned = line_dedup.dedup_lines(docs, names=names)
    emptied = (F.col(names[1]) > 0) & (F.regexp_count("text", F.lit(WORD)) == 0)
    return cleaned.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = ("doc_id", "lang", "source", "n_chars")
    return bpe.encode(docs, path, keep=own, decoded=True).select(*own, F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("mix_sources", mix), ("bpe_codec", tokens)]

#: SQL expresses neither the classifier nor the tokenizer; the tests compare run() with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
