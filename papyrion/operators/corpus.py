"""Corpus tables: current rows, scoped reads, statistics, keyed merges, cascades, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import memo_key


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row a key: the one with the latest ``by``; equal times are settled by the whole row.

    An aggregate (max_by over the row) instead of a window: pre-aggregated map-side, no sort.
    """
    cols = [c for c in df.columns if c != key]
    order = F.struct(F.col(by), F.xxhash64(*df.columns))
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in cols)).select(*df.columns)


def leaves(chunk: DataFrame, level: int | None = 0) -> DataFrame:
    """Passages of one level (None: all), each once."""
    c = chunk if level is None else chunk.filter(F.col("level") == level)
    return c.dropDuplicates(["id"])


def in_corpus(chunk: DataFrame, paper: DataFrame, survey_id: str) -> DataFrame:
    """Passages of one corpus: the scope predicate reaches the scan of paper."""
    return chunk.join(paper.filter(F.col("survey_id") == survey_id).select(F.col("id").alias("paper_id"), "survey_id"), "paper_id")


def missing_vectors(chunk: DataFrame, emb: DataFrame, model: str) -> DataFrame:
    """Passages without a vector of the model."""
    have = emb.filter(F.col("model") == model).select(F.col("chunk_id").alias("id"))
    return chunk.join(have, "id", "left_anti")


def keep_old_if_empty(old: DataFrame, new: DataFrame, key: str, columns: list[str], counter: str | None = None) -> DataFrame:
    """Merge by key: a new value replaces the old one unless it is null or empty; a counter is added up."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    merged = [F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c) for c in columns]
    count = [(F.coalesce(F.col(f"o.{counter}"), F.lit(0)) + F.coalesce(F.col(f"n.{counter}"), F.lit(0))).alias(counter)] if counter else []
    return j.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *merged, *count)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of all old rows of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def fingerprint(paper: DataFrame) -> DataFrame:
    """(survey_id, fp): hash over id, time and status of a corpus' papers in id order."""
    item = F.concat_ws(":", "id", F.unix_micros(F.col("updated_at").cast("timestamp")).cast("string"), F.coalesce("status", F.lit("")))
    return paper.groupBy("survey_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "|"), 256).alias("fp"))


def memo_split(wanted: DataFrame, memo: DataFrame, need: str = "vi") -> DataFrame:
    """(key, src, reused): texts to translate, and whether the memory satisfies the mode."""
    w = wanted.withColumn("key", memo_key(F.col("src"), F.col("model"))).dropDuplicates(["key"])
    m = memo.select("key", F.col(need).alias("_have"))
    return w.join(m, "key", "left").select("key", "src", (F.coalesce(F.length("_have"), F.lit(0)) > 0).alias("reused"))


def occurrence(df: DataFrame, group: str, text: str, pos: str) -> DataFrame:
    """k-th occurrence of equal texts in a document, for joins from k-th to k-th."""
    return df.withColumn("occ", F.row_number().over(Window.partitionBy(group, text).orderBy(pos)))
