"""The operators of this package as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlab.llm import (
    byte_cnn,
    filter_audit,
    line_templates,
    merge_pieces,
    mixing,
    nn_descent,
    packing,
    pii,
    ppm,
    quality_rules,
    sharding,
    simhash,
    vector_codes,
)
from boutlab.sources.tables import read_table


def remainder(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``: how held-out documents are told apart."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii_ids(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in pii.BASE],
        F.sha2(pii.written("base_spans"), 256).alias("base_sha256"),
        pii.written("spans").alias("spans"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read_table(spark, sf_dir, "documents"), remainder(7) == 2)


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    net = byte_cnn.fit_quality(docs, labels, remainder(3) != 1)
    return byte_cnn.score_quality(docs, net).select(
        "doc_id",
        F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


def op8_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(read_table(spark, sf_dir, "documents"), passed_on=["doc_id"])
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge_quality(docs, passed_on=["doc_id"])
    return judged.select("doc_id", *quality_rules.SIGNALS, "kept", "posterior")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return vector_codes.coded_with_label_errors(vectors).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


def op13_merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_pieces.encode_texts(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        "agrees",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_ppm": op3_ppm,
    "op4_byte_cnn": op4_byte_cnn,
    "op5_mixing": op5_mixing,
    "op6_nn_descent": op6_nn_descent,
    "op7_line_templates": op7_line_templates,
    "op8_hash_ring": op8_hash_ring,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_merge_pieces": op13_merge_pieces,
}
ORACLE_SQL: dict[str, str] = {
    "op5_mixing": mixing.mix_sql(),
    "op7_line_templates": line_templates.drop_recurring_lines_sql(),
    "op11_filter_audit": filter_audit.audit_filters_sql(),
}
