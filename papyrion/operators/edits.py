"""Edits of stored documents as set operations: hide, drop, merge, split, renumber, invalidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import norm_name


def apply_flags(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Blocks after (doc, id, action) edits: drop removes, skip and keep set translate, hide and unhide set hidden.

    Several edits of one block count in the order of ``no``: the last of each kind wins.
    """
    e = edits.groupBy("doc", "id").agg(
        F.max(F.when(F.col("action") == "drop", 1)).alias("_drop"),
        F.max_by("action", F.when(F.col("action").isin("skip", "keep"), F.col("no"))).alias("_t"),
        F.max_by("action", F.when(F.col("action").isin("hide", "unhide"), F.col("no"))).alias("_h"),
    )
    j = blocks.join(e, ["doc", "id"], "left").filter("_drop is null")
    t = F.when(F.col("_t") == "skip", False).when(F.col("_t") == "keep", True).otherwise(F.col("translate"))
    h = F.when(F.col("_h") == "hide", True).when(F.col("_h") == "unhide", False).otherwise(F.coalesce("hidden", F.lit(False)))
    return j.withColumn("translate", t).withColumn("hidden", h).drop("_drop", "_t", "_h")


def joiner(left: Column, right: Column) -> Column:
    """Two texts as one: a broken word without its hyphen, else with a blank."""
    broken = F.rtrim(left).rlike("[A-Za-zÀ-ỹ]-$") & F.ltrim(right).rlike("^[a-zà-ỹ]")
    return F.when(broken, F.concat(F.regexp_replace(F.rtrim(left), "-$", ""), F.ltrim(right))).otherwise(F.concat_ws(" ", F.rtrim(left), F.ltrim(right)))


def merge_into_previous(blocks: DataFrame, marked: Column) -> DataFrame:
    """(doc, id, pos, text, n): each marked block joined to the one before, in order; the first of a document stays."""
    w = Window.partitionBy("doc").orderBy("pos")
    m = blocks.withColumn("_m", (marked & (F.row_number().over(w) > 1)).cast("int")).withColumn("_g", F.sum(1 - F.col("_m")).over(w))
    g = m.groupBy("doc", "_g").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "text"))).alias("l"))
    text = F.aggregate(F.slice("l", 2, 1_000_000), F.element_at("l", 1).getField("text"), lambda s, x: joiner(s, x.text))
    return g.select("doc", F.element_at("l", 1).getField("id").alias("id"), F.element_at("l", 1).getField("pos").alias("pos"), text.alias("text"), F.size("l").alias("n"))


def split_at(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc, pos, part, id, text): blocks cut at (doc, id, at); second halves get fresh ids after the highest."""
    w = Window.partitionBy("doc")
    top = F.max(F.expr("try_cast(regexp_extract(id, '^b([0-9]+)$', 1) AS int)")).over(w)
    j = blocks.withColumn("_top", F.coalesce(top, F.lit(0))).join(cuts, ["doc", "id"], "left")
    can = F.col("at").isNotNull() & (F.col("at") > 0) & (F.col("at") < F.length("text"))
    j = j.withColumn("_fresh", F.concat(F.lit("b"), (F.col("_top") + F.sum(can.cast("int")).over(w.orderBy("pos"))).cast("string")))
    first = F.struct(F.lit(0).alias("part"), F.col("id").alias("id"), F.when(can, F.rtrim(F.left("text", F.col("at")))).otherwise(F.col("text")).alias("text"))
    second = F.struct(F.lit(1).alias("part"), F.col("_fresh").alias("id"), F.ltrim(F.substr("text", F.col("at") + 1)).alias("text"))
    x = j.select("doc", "pos", F.explode(F.when(can, F.array(first, second)).otherwise(F.array(first))).alias("x"))
    return x.select("doc", "pos", "x.part", "x.id", "x.text")


def better_title(old: Column, new: Column) -> Column:
    """The new title only where the old is a shorter part of it, case aside."""
    part = F.contains(F.lower(new), F.lower(old)) & (F.length(new) > F.length(old)) & (F.trim(old) != "")
    return F.when(F.coalesce(part, F.lit(False)), new).otherwise(old)


def stale(outputs: DataFrame, changed: DataFrame) -> DataFrame:
    """Outputs (doc, ..., sources) that rest on a changed block."""
    c = changed.groupBy("doc").agg(F.collect_set("id").alias("_ids"))
    return outputs.join(c, "doc").filter(F.arrays_overlap("sources", "_ids")).drop("_ids")


def first_mentions(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, term, pos): each term at its first block, the longest term of a block; by equi-joins on word n-grams.

    Only n-grams of the lengths that terms have are made; a term's key has at most 80 characters, so at most 40 lengths.
    """
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9À-ỹ ]+", " "), " +"), lambda x: x != "")
    b = blocks.select("doc", "pos", w.alias("w"))
    t = terms.withColumn("k", norm_name(F.col("term"))).filter("k <> ''")
    lengths = sorted(r.n for r in t.select(F.size(F.split("k", " ")).alias("n")).distinct().collect())
    grams = None
    for n in lengths:
        g = b.filter(F.size("w") >= n).select("doc", "pos", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), _gram(n)))).alias("k"))
        grams = g if grams is None else grams.unionByName(g)
    if grams is None:
        return b.select("doc", F.lit("").alias("term"), "pos").limit(0)
    hit = grams.join(t, "k").groupBy("doc", "term").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("doc", "pos").orderBy(F.desc(F.length("term")), "term")
    return hit.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _gram(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def wrapped_lines(text: Column, width: int) -> Column:
    """Number of lines of a greedy word wrap at a width in characters."""
    zero = F.struct(F.lit(0).alias("used"), F.lit(1).alias("lines"))

    def step(s, w):
        n = F.length(w)
        fits = F.when(s.used == 0, n).otherwise(s.used + 1 + n) <= width
        return F.struct(F.when(fits, F.when(s.used == 0, n).otherwise(s.used + 1 + n)).otherwise(n).cast("int").alias("used"), F.when(fits | (s.used == 0), s.lines).otherwise(s.lines + 1).cast("int").alias("lines"))

    return F.aggregate(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), zero, step, lambda s: s.lines)


def largest_scale(height: Column, room: float, least: float = 0.78, step: float = 0.02) -> Column:
    """The largest scale (steps of 0.02 down to 0.78) at which a height fits; null where none does."""
    scales = [round(1.0 - step * i, 2) for i in range(int((1.0 - least) / step + 1e-9) + 1)]
    return F.array_max(F.filter(F.array(*(F.lit(x) for x in scales)), lambda x: height * x * x <= room))
