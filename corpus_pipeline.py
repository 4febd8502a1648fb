"""The corpus pipeline: language identification, exact dedup, near-duplicate removal, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns the pieces of packed sequences.

Defined cases: null and empty texts, and those without a letter, go with the first stage, since they have no language; ids may
be null or repeated (null comes last where the least id decides); very long texts are looked at whole by every stage; other
columns are carried along, whatever their names; of rows that are equal in all that a stage compares any one stays; no
documents give no pieces, and no benchmark hits nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealcol.llm import decontaminate, exact_dedup, langid, ngram_join, packing
from sealcol.llm.common import bucket_of, shared_dir, table
from sealcol.llm.queries import digest_buckets, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a known language stay: those that are undetermined, or whose language is less likely than not, go."""
    model = langid.train(docs, bucket_of("doc_id", 4) != 2, vocabulary("piece_bpe_32k.model"))
    return langid.keep_known(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays."""
    return exact_dedup.fresh_index(spark, digest_buckets(spark)).admit(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked at a Jaccard similarity of 0.8 stays."""
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    pieces = packing.pack(docs, F.col("text"), tokenizer=vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies), ("decontamination", benchmark_leaks), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after another over ``documents``, each written to the shared folder and read again."""
    at = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Language models and packing heuristics are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None
