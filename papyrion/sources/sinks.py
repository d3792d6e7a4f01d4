"""Sinks: keyed partition overwrite, facet tables as CSV and Markdown, reading-order exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces just the partitions whose keys are in ``df``; other keys' files stay untouched."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One Markdown table row for each row."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.col(c)) for c in columns)), F.lit(" |")).alias("line"))


def export_document(blocks: DataFrame) -> DataFrame:
    """(doc, md): blocks in reading order with a template for each type."""
    t = F.col("text")
    line = F.when(F.col("type") == "title", F.concat(F.lit("# "), t)).when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.coalesce("level", F.lit(1)), F.lit(3)) + 1), F.lit(" "), t)).when(F.col("type") == "caption", F.concat(F.lit("*"), t, F.lit("*"))).when(F.col("type") == "equation", F.concat(F.lit("$$"), t, F.lit("$$"))).otherwise(t)
    b = blocks.filter("not coalesce(hidden, false)").select("doc", F.struct("pos", line.alias("l")).alias("x"))
    return b.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.l), "\n\n").alias("md"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
