"""The operators over their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, licenses, line_dedup, merkle, mixing, near_dup, quality, spelling, token_shards, toxicity, urls, warc
from tidemark.llm.common import held_out, read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item that it holds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document with its class."""
    members, _ = near_dup.near_duplicate_classes(read(spark, sf_dir, "documents"))
    return members.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "class_size")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = langid.label_spans(docs.select("doc_id", "text"), langid.learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.LineIndex.empty(spark).insert(docs).apply(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest: a row per sequence with its slot, its place in the shards and its documents."""
    return token_shards.write_shards(read(spark, sf_dir, "documents")).select("slot", "shard", "byte_offset", "n_tokens", "doc_ids")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")], F.size("license.spans").alias("n_spans"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per word with its most frequent near word, if that is common enough, and the last of such a chain."""
    return spelling.group_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(read(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_decontaminate, op2_mix, op3_urls, op4_near_duplicates, op5_toxicity, op6_quality, op7_language, op8_line_dedup, op9_token_shards, op10_licenses, op11_spelling, op12_merkle, op13_warc, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": mixing.ORACLE.format(docs="documents"), "op3_urls": urls.oracle(), "op8_line_dedup": line_dedup.ORACLE, "op11_spelling": spelling.ORACLE, "op12_merkle": merkle.oracle(), "op13_warc": warc.ORACLE}
