"""Queries of the algorithmic training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.llm.entity_match import match_records
from papyrion.llm.split_pieces import split_pieces
from papyrion.llm.vector_neighbours import most_similar, mutual
from papyrion.session import table


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: every leaf passage as pieces within the limit."""
    leaves = table(spark, sf_dir, "chunk").filter("level = 0").select("id", "text", "ord", "section").distinct()
    return split_pieces(leaves).withColumnRenamed("item_id", "chunk_id")


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: the pieces of a passage without their overlaps are its text again, none beyond the limit."""
    p = p3_pieces(spark, sf_dir).distinct()
    own = F.substr("text", F.col("overlap") + 1)
    g = p.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("t")))).alias("l"), F.max(F.length("text")).alias("longest"), F.max("overlap").alias("overlap"))
    return g.select("chunk_id", F.sha2(F.array_join(F.transform("l", lambda x: x.t), ""), 256).alias("sha"), ((F.col("longest") <= 2200) & (F.col("overlap") <= 180)).alias("within"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: leaf passages that had to be cut."""
    return p3_pieces(spark, sf_dir).filter("n_pieces > 1").select("chunk_id").distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: matching papers and documents with a confidence."""
    none = F.lit(None).cast("string")
    papers = table(spark, sf_dir, "paper").select("id", "title", "authors", "year", "doi", none.alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "title", "authors", "year", none.alias("doi"), "text")
    m = match_records(papers, docs)
    return m.select(F.col("id_l").alias("paper_id"), F.col("id_r").cast("long").alias("doc_id"), F.round("confidence", 4).alias("confidence"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: pairs of a paper and a document that are the same work."""
    return p4_pairs(spark, sf_dir).select("paper_id", "doc_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: pairs that are each among the other's 5 most similar, with a cosine of at least 0.9."""
    return mutual(most_similar(table(spark, sf_dir, "emb"), least=0.9)).select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


QUERIES = {
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_rejoined": p3_rejoined,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_found": p5_found,
}

_USABLE = """
u AS (SELECT DISTINCT chunk_id, model, vec FROM emb
      WHERE vec IS NOT NULL AND len(vec) = dim AND list_bool_or(list_transform(vec, lambda x: x <> 0)))
"""

SQL: dict[str, str] = {
    "p3_found": "SELECT DISTINCT id AS chunk_id FROM chunk WHERE level = 0 AND length(text) > 2200",
    "p3_rejoined": "SELECT DISTINCT id AS chunk_id, sha256(text) AS sha, true AS within FROM chunk WHERE level = 0 AND text IS NOT NULL",
    "p5_found": f"""
WITH {_USABLE},
c AS (SELECT a.model, a.chunk_id AS a, b.chunk_id AS b,
             round(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[])
                   / sqrt(list_dot_product(a.vec::DOUBLE[], a.vec::DOUBLE[]) * list_dot_product(b.vec::DOUBLE[], b.vec::DOUBLE[])), 6) AS cosine
      FROM u a JOIN u b ON a.model = b.model AND a.chunk_id <> b.chunk_id),
t AS (SELECT *, row_number() OVER (PARTITION BY model, a ORDER BY cosine DESC, b) AS r FROM c)
SELECT x.a AS chunk_a, x.b AS chunk_b FROM t x JOIN t y ON x.model = y.model AND x.a = y.b AND x.b = y.a
WHERE x.r <= 5 AND y.r <= 5 AND x.cosine >= 0.9 AND x.a < x.b
GROUP BY 1, 2""",
}
