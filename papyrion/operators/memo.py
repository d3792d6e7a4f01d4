"""Memo keys, budgets and rounds over injected model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import collapse


def question_key(fp, question):
    """Key of an answered question: the state of the corpus and the collapsed, lower-case question."""
    return F.sha2(F.concat(fp, F.lit("|"), F.lower(collapse(question))), 256)


def within_budget(costs: DataFrame, by: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """Steps that start before the running cost reaches the cap; a cap of zero or less is none."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(w), F.lit(0.0))
    return costs.withColumn("spent", F.round(spent, 6)).filter(F.lit(cap <= 0) | (F.col("spent") < cap))


def carry(rounds: DataFrame, keep: int = 2) -> DataFrame:
    """(qid, round, id): what each round passes on: its best unseen rows by grade."""
    seen = F.min("round").over(Window.partitionBy("qid", "id"))
    fresh = rounds.withColumn("_first", seen).filter(F.col("round") == F.col("_first"))
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("qid", "round").orderBy(F.desc("grade"), "id"))).filter(F.col("place") <= keep).drop("_first")


def usage(rows: DataFrame, by: str) -> DataFrame:
    """Summed usage: an addable record."""
    return rows.groupBy(by).agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))
