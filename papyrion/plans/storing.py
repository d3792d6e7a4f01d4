"""Queries over the stored entity graph and over the keyed tables: put, move, drop, recount."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrion.operators import graph as G
from papyrion.operators import store as St
from papyrion.plans.graphs import _NORM, EDGES, _edges
from papyrion.plans.relational import CHUNKS, chunks, papers
from papyrion.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The stored graph: entities with a kind by their name's form, mentions, edges.
GRAPH = f"""{EDGES}, mention AS (SELECT DISTINCT entity_id, chunk_id, paper_id FROM (SELECT src AS entity_id, chunk_id, paper_id FROM e UNION ALL SELECT dst, chunk_id, paper_id FROM e)),
entity AS (SELECT id, survey_id, {_NORM.format("name")} AS norm, name, CASE WHEN regexp_matches(name, '-[A-Za-z0-9]+$') THEN 'model' ELSE '' END AS kind, papers FROM ent)"""


def _graph(spark, d):
    from papyrion.functions.text import norm_name

    e = _edges(spark, d)
    ent = G.entities(e).withColumn("norm", norm_name(F.col("name"))).withColumn("kind", F.when(F.col("name").rlike("-[A-Za-z0-9]+$"), "model").otherwise(""))
    return ent.select("id", "survey_id", "norm", "name", "kind", "papers"), St.mentions(e), e.drop("src_name", "dst_name")


def _count(m: str, e: str) -> str:
    return f"(SELECT entity_id, count(DISTINCT paper_id) AS papers FROM (SELECT entity_id, paper_id FROM {m} UNION ALL SELECT src, paper_id FROM {e} UNION ALL SELECT dst, paper_id FROM {e}) GROUP BY entity_id)"


@query(f"WITH {GRAPH}, q AS (SELECT id AS chunk_id FROM c WHERE ord % 3 = 0) SELECT m.chunk_id, n.id, n.name, n.papers FROM mention m JOIN entity n ON n.id = m.entity_id WHERE m.chunk_id IN (SELECT chunk_id FROM q)")
def entities_of_passages(spark, d):
    """JOIN-05: the entities of stated passages (every third place)."""
    n, m, _ = _graph(spark, d)
    return St.entities_of(m, n, chunks(spark, d).filter("ord % 3 = 0").select(F.col("id").alias("chunk_id")))


@query(f"WITH {GRAPH} SELECT DISTINCT id FROM (SELECT entity_id AS id FROM mention WHERE paper_id LIKE '%5' UNION SELECT src FROM e WHERE paper_id LIKE '%5' UNION SELECT dst FROM e WHERE paper_id LIKE '%5')")
def touched_entities(spark, d):
    """SET-01: distinct entities that some papers touch by mention or relation."""
    _, m, e = _graph(spark, d)
    own = lambda df, c: df.filter("paper_id like '%5'").select(F.col(c).alias("id"))
    return own(m, "entity_id").union(own(e, "src")).union(own(e, "dst")).distinct()


@query(f"WITH {GRAPH}, x AS (SELECT survey_id, id, name, papers, kind, row_number() OVER (PARTITION BY survey_id, kind ORDER BY papers DESC, name, id) AS r FROM entity) SELECT survey_id, kind, id, name, papers FROM x WHERE r <= 24")
def entities_by_kind(spark, d):
    """AGG-20, SORT-02: up to 24 entities of each kind of a corpus, most papers first."""
    n, _, _ = _graph(spark, d)
    return St.first_of(n, ["survey_id", "kind"], [F.desc("papers"), "name", "id"], 24).select("survey_id", "kind", "id", "name", "papers")


@query(f"""WITH {GRAPH}, l AS (SELECT e.survey_id, '- ' || src_name || ' —' || rel || '→ ' || dst_name || ' (theo ' || left(coalesce(p.title, ''), 50) || ')' || CASE WHEN coalesce(chunk_id, '') <> '' THEN ' [' || chunk_id || ']' ELSE '' END AS line,
row_number() OVER (PARTITION BY e.survey_id ORDER BY coalesce(p.year, 0) DESC, src, dst, rel, paper_id) AS r FROM e LEFT JOIN p ON p.id = e.paper_id) SELECT survey_id, string_agg(line, chr(10) ORDER BY r) AS text FROM l WHERE r <= 20 GROUP BY survey_id""")
def edge_lines(spark, d):
    """GRF-04, GRF-07: up to twenty edges of a corpus as lines to read."""
    e = _edges(spark, d).join(papers(spark, d).select(F.col("id").alias("paper_id"), "title", "year"), "paper_id", "left")
    line = St.edge_line(F.col("src_name"), F.col("rel"), F.col("dst_name"), F.col("title"), F.lit(""), F.col("chunk_id"), 50)
    e = St.first_of(e.withColumn("line", line).withColumn("y", -F.coalesce("year", F.lit(0))), ["survey_id"], ["y", "src", "dst", "rel", "paper_id"], 20)
    return e.groupBy("survey_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "src", "dst", "rel", "paper_id", "line"))), lambda x: x.line), "\n").alias("text"))


#: What a model would answer about a paper (its answers come in as tables): names of the relations, some of them junk, doubled or dangling.
_RAW_ENT = """re AS (SELECT survey_id, paper_id, no, CASE WHEN no % 11 = 0 THEN 'Our method' WHEN no % 5 = 0 THEN upper(name) ELSE name END AS name, CASE no % 4 WHEN 0 THEN ' Model' WHEN 1 THEN 'dataset' WHEN 2 THEN 'gadget' END AS kind, CASE WHEN no % 7 = 0 THEN 'x' || chunk_id ELSE chunk_id END AS chunk
 FROM (SELECT survey_id, paper_id, name, chunk_id, row_number() OVER (PARTITION BY survey_id, paper_id ORDER BY chunk_id, name, rel) AS no FROM (SELECT survey_id, paper_id, src_name AS name, chunk_id, rel FROM e UNION ALL SELECT survey_id, paper_id, dst_name, chunk_id, rel FROM e)))"""
_CLEAN_ENT = f"""{_RAW_ENT}, cx AS (SELECT *, {_NORM.format("name")} AS norm, CASE WHEN lower(trim(kind)) IN ({", ".join(f"'{k}'" for k in St.KINDS)}) THEN lower(trim(kind)) ELSE 'concept' END AS k FROM re),
ce AS (SELECT survey_id, paper_id, norm, arg_min(name, no) AS name, arg_min(k, no) AS kind, coalesce(list(chunk ORDER BY no) FILTER (WHERE starts_with(chunk, paper_id) AND regexp_matches(chunk, '^[A-Za-z0-9]+$')), []) AS l FROM cx WHERE length(norm) >= 2 AND norm NOT IN ({", ".join(f"'{k}'" for k in St.JUNK)}) GROUP BY ALL)"""


def _raw(spark, d):
    from pyspark.sql import Window

    e = _edges(spark, d)
    both = e.select("survey_id", "paper_id", F.col("src_name").alias("name"), "chunk_id", "rel").unionByName(e.select("survey_id", "paper_id", F.col("dst_name").alias("name"), "chunk_id", "rel"))
    no = F.row_number().over(Window.partitionBy("survey_id", "paper_id").orderBy("chunk_id", "name", "rel"))
    r = both.withColumn("no", no)
    name = F.when(F.col("no") % 11 == 0, "Our method").when(F.col("no") % 5 == 0, F.upper("name")).otherwise(F.col("name"))
    kind = F.when(F.col("no") % 4 == 0, " Model").when(F.col("no") % 4 == 1, "dataset").when(F.col("no") % 4 == 2, "gadget")
    chunk = F.when(F.col("no") % 7 == 0, F.concat(F.lit("x"), "chunk_id")).otherwise(F.col("chunk_id"))
    return e, r.select("survey_id", "paper_id", "no", name.alias("name"), kind.alias("kind"), chunk.alias("chunk"))


@query(f"""WITH {GRAPH}, {_CLEAN_ENT} SELECT survey_id, paper_id, norm, name, kind, list_transform(list_sort(list_distinct(list_transform(l, lambda x: [lpad(CAST(list_position(l, x) AS VARCHAR), 6, '0'), x]))), lambda x: x[2])[1:3] AS chunks FROM ce""")
def graph_cleaning(spark, d):
    """GRF-01, FLT-14: names cleaned, junk dropped, kinds closed, at most three passages of the paper."""
    _, raw = _raw(spark, d)
    return St.clean_entities(raw)


@query(f"""WITH {GRAPH}, {_CLEAN_ENT}, nr AS (SELECT survey_id, paper_id, {_NORM.format("src_name")} AS s, {_NORM.format("dst_name")} AS t, rel, chunk_id FROM e WHERE rel IN ('extends', 'builds_on', 'compares_with'))
SELECT survey_id, paper_id, s AS src, t AS dst, rel, min(CASE WHEN starts_with(chunk_id, paper_id) THEN chunk_id ELSE '' END) AS chunk FROM nr WHERE s <> t AND EXISTS (SELECT 1 FROM ce WHERE ce.paper_id = nr.paper_id AND norm = s) AND EXISTS (SELECT 1 FROM ce WHERE ce.paper_id = nr.paper_id AND norm = t) GROUP BY ALL""")
def graph_edge_cleaning(spark, d):
    """GRF-01: relations of a closed set between entities of the paper, none dangling, none to itself, each once."""
    e, raw = _raw(spark, d)
    rels = e.select("survey_id", "paper_id", F.lit(1).alias("no"), F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "rel", F.col("chunk_id").alias("chunk"))
    return St.clean_edges(rels, St.clean_entities(raw), ("extends", "builds_on", "compares_with"))


@query(f"""WITH {GRAPH}, up AS (SELECT DISTINCT survey_id, paper_id FROM e WHERE paper_id LIKE '%3'), ne AS (SELECT u.survey_id, u.paper_id, 'newly named system' AS norm, 'Newly Named System' AS name, 'model' AS kind, u.paper_id || 'c1' AS chunk FROM up u
 UNION ALL SELECT e.survey_id, e.paper_id, {_NORM.format("src_name")}, min(src_name), 'dataset', min(chunk_id) FROM e JOIN up USING (survey_id, paper_id) WHERE rel = 'extends' GROUP BY 1, 2, 3),
nx AS (SELECT 'e' || left(sha256(survey_id || '|' || norm), 14) AS id, * FROM ne), me AS (SELECT id, survey_id, norm, arg_min(name, no) AS name, coalesce(arg_min(kind, no) FILTER (WHERE kind <> ''), '') AS kind FROM (SELECT id, survey_id, norm, name, kind, 0 AS no FROM entity UNION ALL SELECT id, survey_id, norm, name, kind, 1 FROM nx) GROUP BY id, survey_id, norm),
m2 AS (SELECT * FROM mention WHERE paper_id NOT IN (SELECT paper_id FROM up) UNION SELECT id, chunk, paper_id FROM nx), e2 AS (SELECT src, dst, paper_id FROM e WHERE paper_id NOT IN (SELECT paper_id FROM up))
SELECT me.id, me.survey_id, me.norm, me.name, me.kind, n.papers FROM me JOIN {_count("m2", "e2")} n ON n.entity_id = me.id""")
def graph_put(spark, d):
    """UPS-03, UPS-04, UPS-05, GRF-02, SNK-04: graphs of papers replaced (here those whose id ends in 3), entities merged and counted."""
    n, m, e = _graph(spark, d)
    full = _edges(spark, d)
    from papyrion.functions.text import norm_name

    mine = full.filter("paper_id like '%3'")
    one = mine.select("survey_id", "paper_id").distinct().select("survey_id", "paper_id", F.lit("newly named system").alias("norm"), F.lit("Newly Named System").alias("name"), F.lit("model").alias("kind"), F.array(F.concat("paper_id", F.lit("c1"))).alias("chunks"))
    two = mine.filter("rel = 'extends'").groupBy("survey_id", "paper_id", norm_name(F.col("src_name")).alias("norm")).agg(F.min("src_name").alias("name"), F.lit("dataset").alias("kind"), F.array(F.min("chunk_id")).alias("chunks"))
    none = spark.createDataFrame([], "survey_id string, paper_id string, src string, dst string, rel string, chunk string")
    entity, _, _ = St.put_graph(n, m, e, one.unionByName(two), none)
    return entity.select("id", "survey_id", "norm", "name", "kind", "papers")


@query(f"""WITH {GRAPH}, gone AS (SELECT id FROM p WHERE status = 'failed' OR id LIKE '%7'), m2 AS (SELECT * FROM mention WHERE paper_id NOT IN (SELECT id FROM gone)), e2 AS (SELECT * FROM e WHERE paper_id NOT IN (SELECT id FROM gone))
SELECT n.id, n.name, k.papers FROM entity n JOIN {_count("m2", "e2")} k ON k.entity_id = n.id""")
def graph_after_drop(spark, d):
    """MUT-01: entities after papers were dropped; those that nothing names any more are gone."""
    n, m, e = _graph(spark, d)
    gone = papers(spark, d).filter("status = 'failed' or id like '%7'").select(F.col("id").alias("paper_id"))
    return St.drop_papers(gone, n, m, e)[0].select("id", "name", "papers")


_MOVE = """mv AS (SELECT id AS paper_id, 'sv001' AS dest FROM p WHERE survey_id = 'sv000' AND id LIKE '%4' AND (sha256 IS NULL OR sha256 NOT IN (SELECT sha256 FROM p WHERE survey_id = 'sv001' AND sha256 IS NOT NULL))),
te AS (SELECT e.*, mv.dest, s.norm AS sn2, s.name AS s_name, s.kind AS s_kind, t.norm AS tn2, t.name AS t_name, t.kind AS t_kind FROM e JOIN mv USING (paper_id) JOIN entity s ON s.id = e.src JOIN entity t ON t.id = e.dst),
ne AS (SELECT dest AS survey_id, 'e' || left(sha256(dest || '|' || sn2), 14) AS src, 'e' || left(sha256(dest || '|' || tn2), 14) AS dst, rel, paper_id, min(chunk_id) AS chunk_id FROM te GROUP BY ALL),
tm2 AS (SELECT m.*, mv.dest, n.norm, n.name, n.kind FROM mention m JOIN mv USING (paper_id) JOIN entity n ON n.id = m.entity_id), m2 AS (SELECT * FROM mention WHERE paper_id NOT IN (SELECT paper_id FROM mv) UNION SELECT 'e' || left(sha256(dest || '|' || norm), 14), chunk_id, paper_id FROM tm2),
e2 AS (SELECT survey_id, src, dst, rel, paper_id, chunk_id FROM e WHERE paper_id NOT IN (SELECT paper_id FROM mv) UNION ALL SELECT * FROM ne)"""


@query(f"""WITH {GRAPH}, {_MOVE}, al AS (SELECT id, survey_id, norm, name, kind, 0 AS no FROM entity UNION ALL SELECT 'e' || left(sha256(dest || '|' || norm), 14), dest, norm, name, kind, 1 FROM (SELECT dest, norm, name, kind FROM tm2 UNION ALL SELECT dest, sn2, s_name, s_kind FROM te UNION ALL SELECT dest, tn2, t_name, t_kind FROM te)),
me AS (SELECT id, survey_id FROM al GROUP BY id, survey_id) SELECT me.id, me.survey_id, k.papers FROM me JOIN {_count("m2", "e2")} k ON k.entity_id = me.id""")
def graph_after_move(spark, d):
    """MUT-02: entities after papers changed their corpus: ids of the new corpus, both counted again; the same file there stops a move."""
    n, m, e = _graph(spark, d)
    return St.move_papers(_moved(spark, d), n, m, e)[0].select("id", "survey_id", "papers")


def _moved(spark, d):
    p = papers(spark, d)
    there = p.filter("survey_id = 'sv001' and sha256 is not null").select("sha256")
    return cut(p.filter("survey_id = 'sv000' and id like '%4'").join(there, "sha256", "left_anti").select(F.col("id").alias("paper_id"), F.lit("sv001").alias("to")))


@query(f"WITH {GRAPH}, {_MOVE} SELECT survey_id, src, dst, rel, paper_id, chunk_id FROM e2")
def edges_after_move(spark, d):
    """MUT-02: edges after the move, remapped to the entities of the new corpus."""
    n, m, e = _graph(spark, d)
    return St.move_papers(_moved(spark, d), n, m, e)[2].select("survey_id", "src", "dst", "rel", "paper_id", "chunk_id")
