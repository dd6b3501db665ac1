"""From raw documents to packed training sequences: five stages, each by one operator of corpusloom.llm.

Each stage works on all that the one before kept. All but the last return the columns of `documents`; where a stage
changes the text, n_chars follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import crf_lang, decontam, linespread, packing, simhash_wide
from corpusloom.llm.common import col, crc_bucket, ensure_checkpoint_dir, free, table

#: Below this mean posterior of its best label a document's language is not told; it goes, as one without letters does.
MIN_LANGUAGE_SCORE = 0.4


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*map(col, columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = crf_lang.train(docs.filter(crc_bucket("doc_id") != 0))
    label, score = free(docs.columns, "lang_pred", "score")
    labelled = crf_lang.label_documents(docs, model, names=(label, score))
    return labelled.filter((F.col(label) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*map(col, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(linespread.clean(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_wide.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontam.remove_hits(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: The language model, the similarity groups and the packing plan have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of `documents`, with their token ids; each stage's result is written to the shared folder and read again."""
    import uuid

    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{name}")
        docs = spark.read.parquet(f"{shared}/{name}")
    return docs
