"""Lexical and dense search: postings, BM25, vector top-k, rank fusion, diversity.

Everything is a composition of joins and aggregates, so that many queries are answered in one plan.
Statistics range over all passages (all corpora, all levels); the corpus filter applies after
scoring, as it must for scores to be comparable.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from papyrion.functions.text import tokens
from papyrion.session import cut, spread

#: BM25 parameters and the weight of each column (fixed values).
K1, B = 1.2, 0.75
WEIGHTS = {"text": 4.0, "ctx": 2.0, "vi": 2.0, "title": 6.0, "section": 1.0}
#: Reciprocal-rank constant, passages of one paper among the best, width of the candidate pool.
RRF_K, PER_PAPER, POOL = 60, 3, 60


def doc_terms(chunk: DataFrame, weights: dict[str, float] = WEIGHTS, only: list[str] | None = None) -> DataFrame:
    """(id, len, terms: array of (t, w)): one pass, no shuffle; ``only`` keeps the terms asked for.

    The tokens of each column are one projection that the others read, so no text is cut twice.
    """

    def weighted(c: str, w: float) -> Column:
        wanted = F.col(c) if only is None else F.filter(c, lambda x: x.isin(only))
        return F.transform(wanted, lambda x: F.struct(x.alias("t"), F.lit(w).alias("w")))

    cut_up = spread(chunk.select("id", *weights)).select("id", *(tokens(F.col(c)).alias(f"_{c}") for c in weights))
    length = sum((F.size(f"_{c}") for c in weights), F.lit(0))
    return cut_up.select("id", length.alias("len"), F.concat(*(weighted(f"_{c}", w) for c, w in weights.items())).alias("terms"))


def postings(terms: DataFrame) -> DataFrame:
    """(id, term, f, len): weighted frequency of each term in each passage.

    A passage's terms are counted where its row is: the grouping by id and term of exploded rows of
    one partition is pre-aggregated before anything moves.
    """
    p = terms.select("id", "len", F.explode("terms").alias("x")).select("id", "len", F.col("x.t").alias("term"), F.col("x.w").alias("w"))
    return p.groupBy("id", "term").agg(F.sum("w").alias("f"), F.first("len").alias("len"))


def query_terms(questions: DataFrame, id_col: str = "qid", text_col: str = "q") -> DataFrame:
    """(qid, term, n): syntax signs out, words of one letter out, at most 60 words; repeats count."""
    words = F.slice(F.filter(F.split(F.regexp_replace(text_col, r'["*():^\-]+', " "), r"\s+"), lambda w: F.length(w) > 1), 1, 60)
    t = questions.select(F.col(id_col).alias("qid"), F.explode(tokens(F.array_join(words, " "))).alias("term"))
    return t.groupBy("qid", "term").agg(F.count("*").alias("n"))


#: Distinct terms of the questions up to which they travel as a list; beyond, by a join.
LISTED_TERMS = 10_000


def bm25(chunk: DataFrame, questions: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(qid, id, score): passages that hold a term of the question; higher is better."""
    q = query_terms(questions)
    listed = [r.term for r in q.select("term").distinct().limit(LISTED_TERMS + 1).collect()]
    small = len(listed) <= LISTED_TERMS
    terms = cut(doc_terms(chunk, weights, listed if small else None))
    post = postings(terms if small else terms.filter("size(terms) > 0"))
    if not small:
        post = post.join(q.select("term").distinct(), "term", "left_semi")
    stats = terms.agg(F.count("*").alias("docs"), F.avg("len").alias("avgdl"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    s = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    # the statistics are one row: a scalar for every posting
    j = post.join(df, "term").join(q, "term").withColumn("_1", F.lit(1)).join(F.broadcast(stats.withColumn("_1", F.lit(1))), "_1")
    return j.groupBy("qid", "id").agg(F.sum(idf * s * F.col("n")).alias("score"))


#: Query vectors that one pass over the vectors answers; more make more passes.
QUERY_BLOCK = 4096


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): exact top-k by dot product of a stated set of query vectors against all.

    ``vectors``: (id, vec) and ``queries``: (qid, qvec) of one model. The queries travel to the
    executors in blocks; each Arrow batch is one matrix product and keeps its own best k a query, so
    what is shuffled grows with batches x queries x k, not with the vectors. Scores are rounded to
    six digits and ties go by id; vectors of another length than the query's, and nulls, are left out.
    """
    kept = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null and size(vec) > 0")
    schema = f"qid {dict(queries.dtypes)['qid']}, id {dict(kept.dtypes)['id']}, score double"
    kinds = (to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(kept.schema["id"].dataType))
    parts = []
    block: list = []

    def pass_over(block: list) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_dim: dict[int, tuple[list, np.ndarray]] = {}
            for dim in {len(v) for _, v in shared.value}:
                rows = [(q, v) for q, v in shared.value if len(v) == dim]
                by_dim[dim] = [q for q, _ in rows], np.array([v for _, v in rows], float)
            for b in batches:
                ids = np.array(b.column(0).to_pylist(), object)
                vecs = b.column(1).to_pylist()
                sizes = np.array([len(v) for v in vecs])
                for dim, (qids, q) in by_dim.items():
                    at = np.flatnonzero(sizes == dim)
                    if not len(at):
                        continue
                    s = np.round(q @ np.array([vecs[i] for i in at], float).T, 6)
                    order = ids[at].argsort(kind="stable")
                    s, names = s[:, order], ids[at][order]
                    top = np.argsort(-s, 1, kind="stable")[:, :k]
                    m = top.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(qids, object), m).tolist(), kinds[0]), pa.array(names[top].ravel().tolist(), kinds[1]), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["qid", "id", "score"])

        return kept.mapInArrow(run, schema)

    for r in queries.select("qid", F.col("qvec").cast("array<double>")).toLocalIterator():
        if r[1] is not None:
            block.append((r[0], list(r[1])))
        if len(block) >= QUERY_BLOCK:
            parts.append(pass_over(block))
            block = []
    if block or not parts:
        parts.append(pass_over(block))
    return ranked(reduce(DataFrame.unionAll, parts), k)


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds the rank of each question's rows, best first, ties by id; with k only the best k."""
    r = scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return r if k is None else r.filter(F.col("rank") <= k)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(qid, id, score): sum of 1 / (k + rank) over ranked lists with ranks from 1."""
    every = None
    for x in lists:
        x = x.select("qid", "id", "rank")
        every = x if every is None else every.unionByName(x)
    return every.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def diversify(hits: DataFrame, keep: int, cap: int = PER_PAPER) -> DataFrame:
    """The best ``keep`` hits of each question, at most ``cap`` of one paper before others fill up."""
    by_paper = Window.partitionBy("qid", "paper_id").orderBy("rank")
    over = hits.withColumn("_over", (F.row_number().over(by_paper) > cap).cast("int"))
    final = F.row_number().over(Window.partitionBy("qid").orderBy("_over", "rank"))
    return over.withColumn("place", final).filter(F.col("place") <= keep).drop("_over")


def rerank(hits: DataFrame, grades: DataFrame, limit: int = 20) -> DataFrame:
    """Hits by grade and score: ungraded count 1, without any grade 2; grade 0 goes unless nothing else is left."""
    q = Window.partitionBy("qid")
    g = hits.join(grades.select("qid", "id", "grade"), ["qid", "id"], "left")
    g = g.withColumn("_any", F.max(F.col("grade").isNotNull().cast("int")).over(q))
    g = g.withColumn("grade", F.when(F.col("_any") == 0, 2).otherwise(F.coalesce("grade", F.lit(1))))
    g = g.withColumn("_best", F.max("grade").over(q)).filter((F.col("grade") > 0) | (F.col("_best") == 0))
    r = g.withColumn("place", F.row_number().over(q.orderBy(F.desc("grade"), F.desc("score"), "id")))
    return r.filter(F.col("place") <= limit).drop("_any", "_best")
