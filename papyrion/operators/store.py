"""The stored entity graph and the keyed tables around it: replace, merge, move, drop, recount.

Every change is a set operation over whole tables: delete by key is an anti-join, an upsert an
aggregate over old and new rows, a recount an aggregate over both kinds of evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import norm_name
from papyrion.operators.graph import entity_id

#: Names that are no entities, kinds and relations that are known (fixed values; relations as the text patterns state them).
JUNK = ("our method", "the proposed method", "this work", "the model", "our approach", "the paper", "our system", "proposed approach", "the method", "deep learning", "machine learning", "neural network", "ai", "nlp")
KINDS = ("method", "dataset", "metric", "task", "model", "concept", "org")


def mentions(edges: DataFrame) -> DataFrame:
    """(entity_id, chunk_id, paper_id), each once: which passages name an entity."""
    ends = [edges.select(F.col(e).alias("entity_id"), "chunk_id", "paper_id") for e in ("src", "dst")]
    return ends[0].unionByName(ends[1]).distinct()


def recount(entity: DataFrame, mention: DataFrame, edge: DataFrame) -> DataFrame:
    """Entities with the number of distinct papers that mention them or state a relation of theirs; those of none go."""
    seen = mention.select("entity_id", "paper_id")
    for e in ("src", "dst"):
        seen = seen.unionByName(edge.select(F.col(e).alias("entity_id"), "paper_id"))
    n = seen.groupBy("entity_id").agg(F.count_distinct("paper_id").alias("papers"))
    return entity.drop("papers").join(n, entity.id == n.entity_id).drop("entity_id")


def merge_entities(rows: DataFrame) -> DataFrame:
    """(id, survey_id, norm, name, kind): one row an entity; its first name and its first kind that is not empty, by ``no``."""
    kind = F.min_by("kind", F.when(F.coalesce("kind", F.lit("")) != "", F.col("no")))
    return rows.groupBy("id", "survey_id", "norm").agg(F.min_by("name", "no").alias("name"), F.coalesce(kind, F.lit("")).alias("kind"))


def clean_entities(raw: DataFrame) -> DataFrame:
    """(survey_id, paper_id, norm, name, kind, chunks): what a paper names, of (survey_id, paper_id, no, name, kind, chunk).

    Junk and names of one letter go, unknown kinds become concepts, of the passages only three of the
    paper's own are kept, the first in order.
    """
    x = raw.withColumn("norm", norm_name(F.col("name"))).filter((F.length("norm") >= 2) & ~F.col("norm").isin(*JUNK))
    x = x.withColumn("kind", F.when(F.lower(F.trim("kind")).isin(*KINDS), F.lower(F.trim("kind"))).otherwise("concept"))
    own = F.when(F.startswith("chunk", F.col("paper_id")) & F.col("chunk").rlike("^[A-Za-z0-9]+$"), F.struct("no", "chunk"))
    g = x.groupBy("survey_id", "paper_id", "norm").agg(F.min_by("name", "no").alias("name"), F.min_by("kind", "no").alias("kind"), F.array_sort(F.collect_list(own)).alias("l"))
    return g.select("survey_id", "paper_id", "norm", "name", "kind", F.slice(F.array_distinct(F.transform("l", lambda s: s.chunk)), 1, 3).alias("chunks"))


def clean_edges(raw: DataFrame, entities: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """(survey_id, paper_id, src, dst, rel, chunk): relations whose both ends are entities of the paper, none to itself, each once (the first)."""
    x = raw.withColumn("s", norm_name(F.col("src"))).withColumn("t", norm_name(F.col("dst"))).filter((F.col("s") != F.col("t")) & F.col("rel").isin(*relations))
    own = entities.select("paper_id", "norm")
    x = x.join(own.withColumnRenamed("norm", "s"), ["paper_id", "s"], "left_semi").join(own.withColumnRenamed("norm", "t"), ["paper_id", "t"], "left_semi")
    chunk = F.when(F.startswith("chunk", F.col("paper_id")), F.col("chunk")).otherwise("")
    return x.groupBy("survey_id", "paper_id", F.col("s").alias("src"), F.col("t").alias("dst"), "rel").agg(F.min_by(chunk, "no").alias("chunk"))


def put_graph(entity: DataFrame, mention: DataFrame, edge: DataFrame, ents: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after papers' graphs were replaced: their edges and mentions go, the new come, entities are merged and counted.

    ``ents``: clean_entities(); ``rels``: clean_edges(). A kind that is stored stays unless it is empty.
    """
    papers = ents.select("paper_id").distinct()
    eid = entity_id(F.col("survey_id"), F.col("norm"))
    new = ents.select(eid.alias("id"), "survey_id", "norm", "name", "kind", F.lit(1).alias("no"))
    merged = merge_entities(entity.select("id", "survey_id", "norm", "name", "kind", F.lit(0).alias("no")).unionByName(new))
    m = mention.join(papers, "paper_id", "left_anti").unionByName(ents.select(eid.alias("entity_id"), F.explode("chunks").alias("chunk_id"), "paper_id").distinct())
    to = lambda c: entity_id(F.col("survey_id"), F.col(c)).alias(c)
    e = edge.join(papers, "paper_id", "left_anti").unionByName(rels.select("survey_id", to("src"), to("dst"), "rel", "paper_id", F.col("chunk").alias("chunk_id")))
    return recount(merged, m, e), m, e


def drop_papers(gone: DataFrame, entity: DataFrame, mention: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without some papers (paper_id); entities that no paper names any more go with them."""
    m, e = mention.join(gone, "paper_id", "left_anti"), edge.join(gone, "paper_id", "left_anti")
    return recount(entity, m, e), m, e


def move_papers(moved: DataFrame, entity: DataFrame, mention: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after papers (paper_id, to) changed their corpus: entities get the ids of the new corpus, edges and
    mentions follow, edges with an end that is no entity are lost, both corpora are counted again."""
    name = entity.select("id", "norm", "name", "kind")
    re = lambda df, c: df.join(name.select(F.col("id").alias(c), F.col("norm").alias(f"_{c}")), c)
    gone = moved.select("paper_id")
    e = re(re(edge.join(moved, "paper_id"), "src"), "dst")
    new_edges = e.groupBy(F.col("to").alias("survey_id"), entity_id(F.col("to"), F.col("_src")).alias("src"), entity_id(F.col("to"), F.col("_dst")).alias("dst"), "rel", "paper_id").agg(F.min("chunk_id").alias("chunk_id"))
    m = mention.join(moved, "paper_id").withColumnRenamed("entity_id", "id").join(name, "id")
    new_mentions = m.select(entity_id(F.col("to"), F.col("norm")).alias("entity_id"), "chunk_id", "paper_id").distinct()
    touched = m.select("to", "norm", "name", "kind", "id").unionByName(e.select("to", F.col("src").alias("id"), F.col("_src").alias("norm")).join(name.select("id", "name", "kind"), "id")).unionByName(e.select("to", F.col("dst").alias("id"), F.col("_dst").alias("norm")).join(name.select("id", "name", "kind"), "id"))
    new = touched.select(entity_id(F.col("to"), F.col("norm")).alias("id"), F.col("to").alias("survey_id"), "norm", "name", "kind", F.lit(1).alias("no"))
    merged = merge_entities(entity.select("id", "survey_id", "norm", "name", "kind", F.lit(0).alias("no")).unionByName(new))
    m2 = mention.join(gone, "paper_id", "left_anti").unionByName(new_mentions)
    e2 = edge.join(gone, "paper_id", "left_anti").unionByName(new_edges.select(*edge.columns))
    return recount(merged, m2, e2), m2, e2


def entities_of(mention: DataFrame, entity: DataFrame, passages: DataFrame) -> DataFrame:
    """(chunk_id, id, name, papers): the entities of stated passages."""
    return mention.join(passages.select("chunk_id"), "chunk_id", "left_semi").join(entity.select(F.col("id").alias("entity_id"), "name", "papers"), "entity_id").select("chunk_id", F.col("entity_id").alias("id"), "name", "papers")


def edge_line(src: Column, rel: Column, dst: Column, title: Column, note: Column, cite: Column, width: int) -> Column:
    """An edge as a line to read."""
    tail = lambda c, l, r: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(l), c, F.lit(r))).otherwise("")
    return F.concat(F.lit("- "), src, F.lit(" —"), rel, F.lit("→ "), dst, F.lit(" (theo "), F.left(F.coalesce(title, F.lit("")), F.lit(width)), F.lit(")"), tail(note, " — ", ""), tail(cite, " [", "]"))


def first_of(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
