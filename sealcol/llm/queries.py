"""The queries opN_<name> of this subpackage, thin over their operators, with production parameters and whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, binpack, decontaminate, exact_dedup, fim, langid, licenses, ngram_join, packing, quality, search, secrets, substring
from .common import bucket_of, shared_dir, table


def digest_buckets(spark: SparkSession) -> int:
    """Buckets of a new digest index: as many as the cluster's shuffles have partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("with_id").alias("with_doc_id"), F.col("first").alias("first_word"), F.col("stop").alias("end_word"), F.col("with_first").alias("with_first_word"), F.col("with_stop").alias("with_end_word"), "identity")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 3) == 1
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come to one index in two batches; groups are those of both."""
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.fresh_index(spark, digest_buckets(spark), docs.schema["doc_id"].dataType.simpleString())
    second = F.coalesce(bucket_of("doc_id", 2) == 1, F.lit(False))
    ledgers = [index.add(docs.filter(some), name) for name, some in (("first", ~second), ("second", second))]
    return index.annotate(ledgers[0].union(ledgers[1])).withColumnRenamed("id", "doc_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), F.col("text"), tokenizer=vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.col("found.label"))))
    score = F.greatest(F.coalesce(F.array_max("found.weight"), F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.at").alias("first_word"), F.array_max("base.at").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-matrices-{uuid.uuid4().hex}"
    binpack.write_matrices(table(spark, sf_dir, "documents"), path, tokenizer=vocabulary("word_bpe_49k.json"))
    return binpack.digest(binpack.read_matrices(spark, path))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 4) == 2
    found = langid.predict(docs, langid.train(docs, ~held_out, vocabulary("piece_bpe_32k.model")))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.samples(spark)))
    counts = [F.size(F.expr(f"filter(spans, x -> x.kind = {k})")).cast("long").alias(f"n_{kind[0]}") for k, kind in enumerate(secrets.KINDS)]
    base = F.filter("spans", lambda x: x["kind"] < len(secrets.KINDS))
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_index(table(spark, sf_dir, "documents"))
    return search.search(index, table(spark, sf_dir, "benchmark"), top=50)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bestfit.pack(table(spark, sf_dir, "documents"), tokenizer=vocabulary("word_bpe_49k.json"))
    return packed.pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_classifier, op3_ngram_jaccard_join, op4_exact_dedup, op5_decontamination, op6_packing, op7_license_scan, op8_token_id_output, op9_language_id, op10_secret_scan, op11_ranked_search, op12_fill_in_middle, op13_best_fit_packing)}
