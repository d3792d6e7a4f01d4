"""Entity graph: mentions and relations from text, counts, one-hop expansion, overview, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import norm_name

_NAME = "([A-Z][A-Za-zÀ-ỹ]+(?:-[A-Za-z0-9]+)?)"
#: Phrases that state a relation between two named systems: relation, pattern, group of source, group of target (fixed values).
RELATIONS = (
    ("extends", _NAME + " extends " + _NAME + " with", 1, 2),
    ("builds_on", "Built on top of " + _NAME + ", " + _NAME + " adds", 2, 1),
    ("compares_with", _NAME + " (?:reaches|obtains) [0-9.,]+% [a-z ]+, compared with [0-9.,]+% for " + _NAME, 1, 2),
    ("beats", "preferred " + _NAME + " over " + _NAME + " in", 1, 2),
    ("measured_on", "On " + _NAME + ", " + _NAME + " reaches", 2, 1),
)
#: Relations that tell where a system comes from.
LINEAGE = ("extends", "builds_on", "compares_with", "beats")


def entity_id(survey, norm):
    """Id of an entity within a corpus."""
    return F.concat(F.lit("e"), F.left(F.sha2(F.concat(survey, F.lit("|"), norm), 256), F.lit(14)))


def edges_from_text(chunk: DataFrame, paper: DataFrame) -> DataFrame:
    """(survey_id, src, dst, rel, paper_id, chunk_id): relations the passages state, once each (src, dst, rel, paper)."""
    c = chunk.filter("level = 0 and text is not null").select(F.col("id").alias("chunk_id"), "paper_id", "text")
    found = None
    for rel, pattern, s, t in RELATIONS:
        x = c.select("chunk_id", "paper_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(s)).alias("s"), F.regexp_extract_all("text", F.lit(pattern), F.lit(t)).alias("t"))).alias("m"))
        x = x.select("chunk_id", "paper_id", F.col("m.s").alias("s"), F.col("m.t").alias("t"), F.lit(rel).alias("rel"))
        found = x if found is None else found.unionByName(x)
    e = found.join(paper.select(F.col("id").alias("paper_id"), "survey_id"), "paper_id").filter("survey_id is not null")
    e = e.withColumn("sn", norm_name(F.col("s"))).withColumn("tn", norm_name(F.col("t"))).filter("sn <> tn and length(sn) > 2 and length(tn) > 2")
    return e.groupBy("survey_id", entity_id(F.col("survey_id"), F.col("sn")).alias("src"), entity_id(F.col("survey_id"), F.col("tn")).alias("dst"), "rel", "paper_id").agg(F.min("chunk_id").alias("chunk_id"), F.min("s").alias("src_name"), F.min("t").alias("dst_name"))


def entities(edges: DataFrame) -> DataFrame:
    """(id, survey_id, name, papers): distinct papers over both ends of the edges; first name in order wins."""
    ends = edges.select("survey_id", F.col("src").alias("id"), F.col("src_name").alias("name"), "paper_id").unionByName(edges.select("survey_id", F.col("dst").alias("id"), F.col("dst_name").alias("name"), "paper_id"))
    return ends.groupBy("id", "survey_id").agg(F.min("name").alias("name"), F.count_distinct("paper_id").alias("papers"))


def find(entity: DataFrame, names: DataFrame, per_name: int = 5, limit: int = 12) -> DataFrame:
    """(qid, id, name, papers): per asked name the entities equal to or containing it, most papers first."""
    e = entity.withColumn("norm", norm_name(F.col("name")))
    q = names.withColumn("k", norm_name(F.col("q"))).filter("length(k) > 1")
    hit = q.join(e, F.expr("norm = k or contains(norm, k)"))
    top = hit.withColumn("r", F.row_number().over(Window.partitionBy("qid", "k").orderBy(F.desc("papers"), "id"))).filter(F.col("r") <= per_name)
    every = top.select("qid", "id", "name", "papers").distinct()
    return every.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("papers"), "id"))).filter(F.col("r") <= limit).drop("r")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that touch a seed, with whether both ends do: two equi-joins instead of a disjunction."""
    s = seeds.select("qid", F.col("id").alias("seed"))
    a = edges.join(s, edges.src == s.seed).drop("seed").withColumn("end", F.lit(1))
    b = edges.join(s, edges.dst == s.seed).drop("seed").withColumn("end", F.lit(2))
    keys = ["qid", "survey_id", "src", "dst", "rel", "paper_id"]
    return a.unionByName(b).groupBy(*keys).agg(F.min("chunk_id").alias("chunk_id"), (F.count_distinct("end") == 2).alias("both_ends"))


def expand(edges: DataFrame, seeds: DataFrame, paper: DataFrame, seen: DataFrame, limit: int = 24) -> DataFrame:
    """(qid, chunk_id, place): passages behind the seeds' edges not seen yet; edges between seeds first, then newer papers."""
    n = neighbours(edges, seeds).join(paper.select(F.col("id").alias("paper_id"), "year"), "paper_id", "left")
    n = n.join(seen.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy(F.desc("both_ends"), F.desc(F.coalesce("year", F.lit(0))), "src", "dst", "rel", "paper_id")
    first = n.withColumn("r", F.row_number().over(order)).groupBy("qid", "chunk_id").agg(F.min("r").alias("r"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("r"))).filter(F.col("place") <= limit).drop("r")


def overview(edges: DataFrame, entity: DataFrame, top: int) -> DataFrame:
    """Edges between the most mentioned entities of each corpus: two semi-joins."""
    best = entity.withColumn("r", F.row_number().over(Window.partitionBy("survey_id").orderBy(F.desc("papers"), "name", "id"))).filter(F.col("r") <= top).select("id")
    return edges.join(best, edges.src == best.id, "left_semi").join(best, edges.dst == best.id, "left_semi").groupBy("survey_id", "src", "dst", "rel").agg(F.count_distinct("paper_id").alias("papers"))


def lineage(edges: DataFrame, paper: DataFrame) -> DataFrame:
    """Which system came from which, in the order of years."""
    p = paper.select(F.col("id").alias("paper_id"), F.coalesce("year", F.lit(0)).alias("year"))
    e = edges.filter(F.col("rel").isin(*LINEAGE)).join(p, "paper_id", "left")
    order = Window.partitionBy("survey_id").orderBy(F.coalesce("year", F.lit(0)), "src", "dst", "rel", "paper_id")
    return e.withColumn("step", F.row_number().over(order)).select("survey_id", "step", F.coalesce("src_name", F.lit("?")).alias("src_name"), F.coalesce("dst_name", F.lit("?")).alias("dst_name"), "rel", "paper_id")
