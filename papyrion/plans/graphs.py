"""Entity graph queries over relations that the passages state."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrion.operators import graph as G
from papyrion.plans.relational import CHUNKS, PAPERS, chunks, papers
from papyrion.session import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_N = G._NAME
_NORM = "left(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9À-ỹ ]+', ' ', 'g'), ' +', ' ', 'g')), 80)"
_RAW = " UNION ALL ".join(f"SELECT id AS chunk_id, paper_id, unnest(regexp_extract_all(text, '{pattern}', {s})) AS s, unnest(regexp_extract_all(text, '{pattern}', {t})) AS t, '{rel}' AS rel FROM c WHERE level = 0 AND text IS NOT NULL" for rel, pattern, s, t in G.RELATIONS)
EDGES = rf"""{PAPERS}, {CHUNKS},
raw AS ({_RAW}),
nm AS (SELECT raw.*, p.survey_id, {_NORM.format("s")} AS sn, {_NORM.format("t")} AS tn FROM raw JOIN p ON p.id = raw.paper_id WHERE p.survey_id IS NOT NULL),
e AS (SELECT survey_id, 'e' || left(sha256(survey_id || '|' || sn), 14) AS src, 'e' || left(sha256(survey_id || '|' || tn), 14) AS dst, rel, paper_id, min(chunk_id) AS chunk_id, min(s) AS src_name, min(t) AS dst_name
 FROM nm WHERE sn <> tn AND length(sn) > 2 AND length(tn) > 2 GROUP BY ALL),
ends AS (SELECT survey_id, src AS id, src_name AS name, paper_id FROM e UNION ALL SELECT survey_id, dst, dst_name, paper_id FROM e),
ent AS (SELECT id, survey_id, min(name) AS name, count(DISTINCT paper_id) AS papers FROM ends GROUP BY id, survey_id)"""


def _edges(spark, d):
    """The relations of the passages, found once: what follows reads them several times."""
    return cut(G.edges_from_text(chunks(spark, d), papers(spark, d)))


@query(f"WITH {EDGES} SELECT survey_id, src, dst, rel, paper_id, chunk_id FROM e")
def graph_edges(spark, d):
    """GRF-01, GRF-02: relations of the passages, cleaned, one row an edge and paper."""
    return _edges(spark, d).drop("src_name", "dst_name")


@query(f"WITH {EDGES} SELECT * FROM ent")
def entity_papers(spark, d):
    """AGG-05, UPS-03: distinct papers of each entity over both ends of the edges."""
    return G.entities(_edges(spark, d))


_ASKED = [("q1", "Kifokoth"), ("q2", "lite"), ("q3", "Kotreskel-13B"), ("q4", "%")]


@query(f"""WITH {EDGES}, asked(qid, q) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _ASKED)}),
k AS (SELECT qid, {_NORM.format("q")} AS k FROM asked), h AS (SELECT qid, k, ent.id, ent.name, ent.papers FROM k JOIN ent ON length(k) > 1 AND ({_NORM.format("name")} = k OR contains({_NORM.format("name")}, k))),
t AS (SELECT DISTINCT qid, id, name, papers FROM (SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY papers DESC, id) AS r FROM h) WHERE r <= 5)
SELECT qid, id, name, papers FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY papers DESC, id) AS r FROM t) WHERE r <= 12""")
def find_entities(spark, d):
    """FLT-08: entities by name, equal or containing, five a name."""
    return G.find(G.entities(_edges(spark, d)), spark.createDataFrame(_ASKED, "qid string, q string"))


_SEEDS = "seeds AS (SELECT survey_id AS qid, id FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY papers DESC, id) AS r FROM ent) WHERE r <= 3)"


def _seeds(ent):
    from pyspark.sql import Window

    return ent.withColumn("r", F.row_number().over(Window.partitionBy("survey_id").orderBy(F.desc("papers"), "id"))).filter("r <= 3").select(F.col("survey_id").alias("qid"), "id")


_NEAR = f"""{EDGES}, {_SEEDS},
nb AS (SELECT qid, survey_id, src, dst, rel, paper_id, min(chunk_id) AS chunk_id, count(DISTINCT w) = 2 AS both_ends FROM (
 SELECT s.qid, e.*, 1 AS w FROM e JOIN seeds s ON e.src = s.id UNION ALL SELECT s.qid, e.*, 2 FROM e JOIN seeds s ON e.dst = s.id) GROUP BY qid, survey_id, src, dst, rel, paper_id)"""


@query(f'WITH {_NEAR} SELECT qid, src, dst, rel, paper_id, chunk_id, both_ends FROM nb')
def neighbours(spark, d):
    """JOIN-06: edges that touch the most mentioned entities of each corpus."""
    e = _edges(spark, d)
    return G.neighbours(e, _seeds(G.entities(e))).drop("survey_id")


@query(f"""WITH {_NEAR}, o AS (SELECT nb.qid, nb.chunk_id, row_number() OVER (PARTITION BY nb.qid ORDER BY nb.both_ends DESC, coalesce(p.year, 0) DESC, nb.src, nb.dst, nb.rel, nb.paper_id) AS r FROM nb LEFT JOIN p ON p.id = nb.paper_id WHERE nb.chunk_id NOT LIKE '%c1'),
f AS (SELECT qid, chunk_id, min(r) AS r FROM o GROUP BY qid, chunk_id)
SELECT qid, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r) AS place FROM f) WHERE place <= 24""")
def graph_expand(spark, d):
    """GRF-03, SORT-04: passages one hop from the seeds that were not seen yet."""
    e = _edges(spark, d)
    seeds = _seeds(G.entities(e))
    seen = e.filter("chunk_id like '%c1'").select(F.col("survey_id").alias("qid"), "chunk_id").distinct()
    return G.expand(e, seeds, papers(spark, d), seen)


@query(f"""WITH {EDGES}, best AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY papers DESC, name, id) AS r FROM ent) WHERE r <= 20)
SELECT survey_id, src, dst, rel, count(DISTINCT paper_id) AS papers FROM e WHERE src IN (SELECT id FROM best) AND dst IN (SELECT id FROM best) GROUP BY ALL""")
def graph_overview(spark, d):
    """JOIN-07, GRF-05, SORT-02: edges between the top entities."""
    e = _edges(spark, d)
    return G.overview(e, G.entities(e), 20)


@query(f"""WITH {EDGES} SELECT survey_id, row_number() OVER (PARTITION BY survey_id ORDER BY coalesce(y, 0), src, dst, rel, paper_id) AS step, src_name, dst_name, rel, paper_id
FROM (SELECT e.*, p.year AS y FROM e LEFT JOIN p ON p.id = e.paper_id WHERE rel IN ({", ".join(f"'{r}'" for r in G.LINEAGE)}))""")
def lineage(spark, d):
    """JOIN-08, GRF-06: which system came from which, by year; four of the relations say so."""
    return G.lineage(_edges(spark, d), papers(spark, d))
