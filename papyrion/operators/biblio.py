"""Bibliographic rows: dedup with the fullest fields, ranking, scores of cited works, abstracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import norm_title


def dedup_key() -> Column:
    doi = F.trim(F.lower(F.coalesce("doi", F.lit(""))))
    return F.when(doi != "", doi).otherwise(norm_title(F.col("title")))


def dedup(rows: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """One row a work: the first non-empty value of each field in arrival order, most citations, sources joined.

    Rows without identifier and title are dropped. The arrival order is a column: the result does
    not depend on partitions. Values are taken by min_by, so each group is pre-aggregated.
    """
    r = rows.withColumn("k", dedup_key()).filter("k <> ''")
    first = [F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in fields]
    src = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("source", F.lit("")).alias("s")))), lambda x: x.s), "+")
    return r.groupBy("k").agg(*first, F.max(F.coalesce("cites", F.lit(0))).alias("cites"), F.btrim(src, F.lit("+")).alias("source"))


def rank_score() -> Column:
    """Citations, recency and a small bonus for what can be read (fixed weights)."""
    recency = F.when(F.coalesce("year", F.lit(0)) > 0, F.greatest(F.lit(0.0), (F.col("year") - 2015) / 10.0)).otherwise(0.0)
    return 0.55 * F.log1p(F.coalesce("cites", F.lit(0)).cast("double")) + 0.30 * recency + F.when(F.coalesce("url", F.lit("")) != "", 0.35).otherwise(0.0)


def cited_score() -> Column:
    """How much a text says about a work it cites: contexts, influence, intents, corpus, citations (fixed weights)."""
    yes = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    return (
        2.2 * F.least("contexts", F.lit(4))
        + yes("influential", 4.0)
        + F.when(F.array_contains("intents", "methodology"), 1.5).otherwise(0.0)
        + F.when(F.array_contains("intents", "result"), 1.0).otherwise(0.0)
        + yes("in_corpus", 3.0)
        + 0.4 * F.log1p(F.coalesce("cites", F.lit(0)).cast("double"))
    )


def rebuild_inverted(index: Column, most: int = 1500) -> Column:
    """A text from its inverted index (map of word to places)."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.left(F.array_join(F.transform(F.array_sort(places), lambda x: x.w), " "), F.lit(most))


def title_overlap(a: Column, b: Column) -> Column:
    """Common words over the shorter title's words."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))
