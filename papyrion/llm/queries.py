"""Queries of the training-data operators tagged llm, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.llm.align import sentence_pairs
from papyrion.llm.leak import cleaned, leaked
from papyrion.llm.lookalike import look_classes, same_looking
from papyrion.llm.pairs import broken_answers
from papyrion.llm.scan import repaired, scan_noise
from papyrion.llm.spam import spam_pages
from papyrion.llm.tokens import encode_documents
from papyrion.session import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, text) of the passages and the memory's sources."""
    chunk = table(spark, sf_dir, "chunk").select(F.lit("chunk").alias("tbl"), "id", "text")
    return chunk.unionByName(table(spark, sf_dir, "tm").select(F.lit("tm").alias("tbl"), F.col("key").alias("id"), F.col("src").alias("text")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: pairs of records whose texts look the same but differ in their characters."""
    return same_looking(_texts(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: records whose texts look the same but differ, one row a record with its class."""
    return look_classes(_texts(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: sentences of passages and documents and of their translations that translate each other."""
    none = F.lit(None).cast("string")
    chunk = table(spark, sf_dir, "chunk").filter("vi is not null").select(F.lit("chunk").alias("tbl"), F.col("id").alias("rec_id"), "text", "vi", none.alias("blocks"))
    docs = table(spark, sf_dir, "documents").filter("translations is not null").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), "text", none.alias("vi"), F.col("translations").alias("blocks"))
    return sentence_pairs(chunk.unionByName(docs))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: broken answers of the translation memory and their defects."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return broken_answers(table(spark, sf_dir, "tm"), texts=texts)


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_id, text, title, kind, page, doc) of the passages and the parsed documents."""
    none = F.lit(None)
    chunk = table(spark, sf_dir, "chunk").select(F.lit("chunk").alias("tbl"), F.col("id").alias("rec_id"), "text", "title", "kind", "page", F.col("paper_id").alias("doc"))
    cache = table(spark, sf_dir, "parse_cache").select(F.lit("parse_cache").alias("tbl"), F.col("sha256").alias("rec_id"), F.col("blocks").alias("text"), "title", none.cast("string").alias("kind"), none.cast("int").alias("page"), none.cast("string").alias("doc"))
    return chunk.unionByName(cache)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: the kinds of scan noise in each passage and block."""
    return scan_noise(_scanned(spark, sf_dir))


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: the repaired paragraphs, empty for blocks that are furniture."""
    return repaired(_scanned(spark, sf_dir)).select("tbl", "rec_id", "block_id", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: token ids of every document in byte_bpe_50k."""
    return encode_documents(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: documents that contain test items."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: leaking documents without the leaked stretches, beyond the limits of length or coverage."""
    return cleaned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 10: keyword, link and tag pages."""
    return spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_text": p7_text,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
    "p8_ids": p8_ids,
}

SQL: dict[str, str] = {}
