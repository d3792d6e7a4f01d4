"""A stored lexical index: postings by term, written once and read by the terms of a question.

The folder lies with the checkpoints (``spark.checkpoint.dir``) under a name made of the table's path,
size and time of change, so a rewritten table gets a new index and an old one is never read for it.
Postings are partitioned by a hash of the term and sorted by it: a question reads its terms' buckets
only, and within them the row groups that can hold its terms.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.operators.search import B, K1, WEIGHTS, doc_terms, postings, query_terms
from papyrion.session import path_exists, path_state, shared_folder

#: Passages for each bucket, and most buckets: a folder of its own for each, so few for few passages.
PER_BUCKET, MOST_BUCKETS = 50_000, 4096
#: Distinct terms of the questions up to which they are pushed down as a list; beyond, they are joined.
LISTED_TERMS = 10_000


#: What is stored; given when it is read, since an empty table leaves no file to tell.
POSTINGS, TERMS = "id string, term string, f double, len int, bucket int", "bucket int, term string, df long"


def folder(spark: SparkSession, table_path: str, weights: dict[str, float] = WEIGHTS) -> str:
    """Where the index of a table's present state lies."""
    state = path_state(spark, table_path) + repr(sorted(weights.items()))
    return f"{shared_folder(spark)}/index-{hashlib.sha256(state.encode()).hexdigest()[:24]}"


def bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(chunk: DataFrame, path: str, weights: dict[str, float] = WEIGHTS) -> None:
    """Writes (bucket, term, id, f, len), (bucket, term, df) and the totals; the totals last, as a sign that all is there."""
    docs = chunk.count()
    buckets = max(1, min(MOST_BUCKETS, docs // PER_BUCKET))
    terms = doc_terms(chunk, weights)
    post = postings(terms).select(F.col("id").cast("string").alias("id"), "term", F.col("f").cast("double").alias("f"), F.col("len").cast("int").alias("len"), bucket(F.col("term"), buckets).alias("bucket"))
    post.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = chunk.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
    stored.groupBy("bucket", "term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    terms.agg(F.lit(docs).cast("long").alias("docs"), F.avg("len").alias("avgdl"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/totals")


def ready(spark: SparkSession, table_path: str, chunk: DataFrame, weights: dict[str, float] = WEIGHTS) -> str:
    """The index's folder, built where it is missing."""
    path = folder(spark, table_path, weights)
    if not path_exists(spark, f"{path}/totals/_SUCCESS"):
        build(chunk, path, weights)
    return path


def scored(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """(qid, id, score): passages that hold a term of a question, by the stored postings; higher is better."""
    totals = spark.read.parquet(f"{path}/totals").first()
    q = query_terms(questions)
    terms = q.select("term", bucket(F.col("term"), totals.buckets).alias("bucket")).distinct()
    listed = [(r.term, r.bucket) for r in terms.limit(LISTED_TERMS + 1).collect()]
    post, df = spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(TERMS).parquet(f"{path}/terms")
    if len(listed) <= LISTED_TERMS:
        names, where = [t for t, _ in listed], sorted({b for _, b in listed})
        post = post.filter(F.col("bucket").isin(where) & F.col("term").isin(names))
        df = df.filter(F.col("term").isin(names))
    else:
        post, df = post.join(terms, ["bucket", "term"], "left_semi"), df.join(terms, ["bucket", "term"], "left_semi")
    docs, avgdl = float(totals.docs), float(totals.avgdl or 1.0)
    idf = F.greatest(F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    s = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / avgdl))
    j = post.join(df.select("term", "df"), "term").join(q, "term")
    return j.groupBy("qid", "id").agg(F.sum(idf * s * F.col("n")).alias("score"))
