"""Queries of shapes: slides, lectures, cards, page regions, trees over trees (inputs are drawn from the stored tables)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrion.operators import blocks as B
from papyrion.operators import shaping as Sh
from papyrion.operators import verify as V
from papyrion.plans.checks import _lints, _norm, _nums
from papyrion.plans.decks import DECK, _deck
from papyrion.plans.editing import BOXES, _boxes
from papyrion.plans.relational import CHUNKS, PAPERS, chunks, papers
from papyrion.plans.structure import BLOCKS, blocks
from papyrion.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {DECK}, s AS (SELECT doc, no, kind, CASE WHEN figure IS NOT NULL THEN CASE WHEN length(headline) / 40.0 >= 1.9 THEN 'wide' WHEN length(headline) / 40.0 <= 0.85 THEN 'tall' ELSE 'square' END END AS shape, no % 4 = 2 AS drawn, no % 3 = 1 AS cards, len(bullets) > 1 AS bullets FROM deck)
SELECT doc, no, CASE WHEN kind IN ('title', 'agenda', 'section') THEN kind WHEN kind IN ('closing', 'thanks') THEN 'closing' WHEN cards AND (shape IS NOT NULL OR drawn) THEN 'figwide' WHEN shape = 'wide' THEN 'figwide' WHEN shape IS NOT NULL THEN CASE WHEN cards OR bullets THEN 'figside' ELSE 'figfull' END
WHEN drawn THEN CASE WHEN cards OR bullets THEN 'split' ELSE 'figfull' END WHEN cards THEN 'cards' ELSE 'list' END AS layout FROM s""")
def slide_layouts(spark, d):
    """DOC-30: layouts from what a slide holds and the shape of its picture (drawn from the headline's length)."""
    k = _deck(spark, d)
    shape = F.when(F.col("figure").isNotNull(), Sh.figure_shape(F.length("headline"), F.lit(40.0)))
    return k.select("doc", "no", Sh.slide_layout(F.col("kind"), shape, F.col("no") % 4 == 2, F.col("no") % 3 == 1, F.size("bullets") > 1).alias("layout"))


_NT = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH {PAPERS}, a AS (SELECT id, {_NT.format('title')} AS t FROM p), b AS (SELECT doc_id, {_NT.format('title')} AS t FROM documents), j AS (SELECT a.id, b.doc_id, a.t AS x, b.t AS y FROM a JOIN b ON string_split(a.t, ' ')[1:2] = string_split(b.t, ' ')[1:2] WHERE a.t <> '' AND b.t <> '')
SELECT DISTINCT id, doc_id FROM j WHERE contains(x, y) OR contains(y, x) OR len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' ')))) / greatest(1, least(len(list_distinct(string_split(x, ' '))), len(list_distinct(string_split(y, ' '))))) >= 0.6""")
def accepted_titles(spark, d):
    """SRC-18: hits of a fuzzy title search (here those that begin alike) that are the same work."""
    return Sh.accepted_pairs(papers(spark, d).select("id", "title"), table(spark, d, "documents").select("doc_id", "title"))


@query(f"WITH {BOXES} SELECT doc, box_id, page - 1 AS page, x0, 800.0 - y1 AS y0, x1, 800.0 - y0 AS y1 FROM box")
def boxes_top_left(spark, d):
    """SRC-19: boxes from the bottom left turned to the top left, pages counted from nought."""
    return Sh.to_top_left(_boxes(spark, d).withColumn("page_h", F.lit(800.0))).select("doc", "box_id", "page", "x0", "y0", "x1", "y1")


@query(f"""WITH {BOXES}, r AS (SELECT doc, page, x0, y0, greatest(x1, x0 + 2) AS x1, greatest(y1, y0 + 2) AS y1 FROM box WHERE hash(box_id) IS NOT NULL AND length(box_id) % 2 = 0),
g AS (SELECT *, CASE WHEN coalesce(y0 > max(y1) OVER (PARTITION BY doc, page ORDER BY y0, y1, x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 26, true) THEN 1 ELSE 0 END AS n FROM r), b AS (SELECT *, sum(n) OVER (PARTITION BY doc, page ORDER BY y0, y1, x0, x1 ROWS UNBOUNDED PRECEDING) AS band FROM g)
SELECT doc, page, band, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM b GROUP BY doc, page, band HAVING max(y1) - min(y0) >= 14 AND max(x1) - min(x0) >= 18""")
def graphic_clusters(spark, d):
    """DOC-22: drawings merged to clusters by one sweep over a page."""
    return Sh.graphic_clusters(_boxes(spark, d).filter(F.length("box_id") % 2 == 0))


_ITEMS = f"""{CHUNKS}, it AS (SELECT id, kind = 'figcap' AS heading, ord % 11 = 0 AS in_graphic, 9.0 + (ord % 5) * 0.5 AS size, 10.0 AS modal, 100.0 + (ord % 6) * 8 AS width, 120.0 AS modal_width, ord % 4 < 2 AS at_margin, ord % 7 = 0 AS centred, (ord % 8) / 16.0 AS wide_gaps, ord % 3 + 1 AS lines FROM c WHERE level = 0)"""


@query(f"""WITH {_ITEMS} SELECT id, CASE WHEN heading THEN true WHEN in_graphic THEN false WHEN size > modal + 0.4 AND (at_margin OR centred) THEN true WHEN size < modal - 0.6 THEN false WHEN wide_gaps >= 0.25 THEN false WHEN lines >= 2 AND abs(width - modal_width) <= 10 THEN true ELSE at_margin END AS body FROM it""")
def body_texts(spark, d):
    """DOC-21: blocks that are the text's own rather than a picture's (measures are drawn from the places)."""
    o = F.col("ord")
    it = chunks(spark, d, 0).select("id", F.coalesce(F.col("kind") == "figcap", F.lit(False)).alias("heading"), (o % 11 == 0).alias("in_graphic"), (9.0 + (o % 5) * 0.5).alias("size"), F.lit(10.0).alias("modal"), (100.0 + (o % 6) * 8).alias("width"), F.lit(120.0).alias("modal_width"), (o % 4 < 2).alias("at_margin"), (o % 7 == 0).alias("centred"), ((o % 8) / 16.0).alias("wide_gaps"), (o % 3 + 1).alias("lines"))
    return Sh.body_text(it).select("id", "body")


@query()
def captions_placed(spark, d):
    """JOIN-11: captions to regions by key, the others to the nearest free region of their page (regions are drawn from the places)."""
    b = blocks(spark, d)
    c = b.filter("type = 'caption'").select("doc", "page", "pos", "id", B.caption_key(F.col("text")).alias("key"), (F.col("pos") * 7.0).alias("y"))
    r = b.filter("type in ('caption', 'heading')").select("doc", "page", F.concat(F.lit("r"), "id").alias("region"), F.when(F.col("pos") % 2 == 0, B.caption_key(F.col("text"))).otherwise("").alias("key"), (F.col("pos") * 6.0).alias("y"))
    return Sh.captions_to_regions(c, r)


_LECT = f"""{CHUNKS}, ls AS (SELECT id AS doc, ord, text, CASE ord % 7 WHEN 0 THEN 'mechanism' WHEN 1 THEN 'prereq' WHEN 2 THEN 'compare' WHEN 3 THEN 'limits' WHEN 4 THEN 'check' WHEN 5 THEN 'evidence' ELSE 'problem' END AS name, string_split(text, '. ') AS parts FROM c WHERE level = 0 AND text IS NOT NULL),
le AS (SELECT doc, name, unnest(range(len(parts)))::INTEGER AS i, unnest(parts) AS x FROM ls)"""


@query(f"""WITH {_LECT} SELECT doc, name, i, CASE WHEN name = 'mechanism' THEN 'bước ' || CAST(i + 1 AS VARCHAR) ELSE left(x, 30) END AS label, CASE name WHEN 'mechanism' THEN x || ' vì ' || x WHEN 'prereq' THEN x WHEN 'compare' THEN x || ' ' || upper(left(x, 3)) ELSE x END AS text FROM le WHERE name IN ('mechanism', 'prereq', 'compare', 'limits') AND trim(CASE name WHEN 'mechanism' THEN x || ' vì ' || x WHEN 'compare' THEN x || ' ' || upper(left(x, 3)) ELSE x END) <> ''
UNION ALL SELECT doc, name, 0, '', text FROM ls WHERE name IN ('evidence', 'problem') AND trim(text) <> ''""")
def lecture_texts(spark, d):
    """LEC-01: the prose of each section of a lecture by its shape (sections are drawn from the passages)."""
    return Sh.lecture_texts(_lecture(spark, d))


def _lecture(spark, d):
    o = F.col("ord") % 7
    name = F.when(o == 0, "mechanism").when(o == 1, "prereq").when(o == 2, "compare").when(o == 3, "limits").when(o == 4, "check").when(o == 5, "evidence").otherwise("problem")
    c = chunks(spark, d, 0).filter("text is not null").withColumn("name", name)
    x = lambda s: F.create_map(F.lit("do"), s, F.lit("term"), s, F.lit("paper"), s, F.lit("point"), s, F.lit("why"), F.when(F.col("name") == "mechanism", F.concat(F.lit("vì "), s)).otherwise(s), F.lit("took"), s, F.lit("differs"), F.upper(F.left(s, F.lit(3))), F.lit("so_what"), s)
    return c.select(F.col("id").alias("doc"), "name", F.transform(F.split("text", r"\. "), x).alias("entries"), F.col("text").alias("body"))


@query(f"""WITH {CHUNKS}, w AS (SELECT paper_id AS doc, coalesce(section, '') AS section, ord * 1000 + length(id) AS pos, id AS msg, unnest({_lints('vi')}) AS kind FROM c WHERE level = 0 AND vi IS NOT NULL), g AS (SELECT doc, section, arg_min(msg, struct_pack(a := pos, b := msg)) AS msg, min(struct_pack(a := pos, b := msg)) AS pos FROM w WHERE kind IN ('filler', 'vague', 'no_mechanism') GROUP BY doc, section)
SELECT doc, section, msg FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS r FROM g) WHERE r <= 4""")
def first_shallow(spark, d):
    """AGG-15: the first warning of depth of each section, four sections a paper."""
    c = chunks(spark, d, 0).filter("vi is not null").select(F.col("paper_id").alias("doc"), F.coalesce("section", F.lit("")).alias("section"), F.struct((F.col("ord").cast("long") * 1000 + F.length("id")).alias("a"), F.col("id").alias("b")).alias("pos"), F.col("id").alias("msg"), F.explode(V.lints(F.col("vi"))).alias("kind"))
    return Sh.first_warnings(c, ["filler", "vague", "no_mechanism"])


@query(f"""WITH {PAPERS}, {CHUNKS}, f AS (SELECT paper_id, arg_min(id, ord) AS first FROM c WHERE level = 0 GROUP BY paper_id)
SELECT p.id, coalesce(p.title, '') AS title_vi, coalesce(p.card.tldr_vi, '') AS tldr_vi, coalesce(p.venue, '') AS domain, CASE WHEN coalesce(p.card.novelty, '') <> '' THEN [{{'claim': p.card.novelty, 'chunk': coalesce(f.first, '')}}] ELSE [] END AS results, true AS from_brief FROM p LEFT JOIN f ON f.paper_id = p.id""")
def cards_from_briefs(spark, d):
    """DOC-28, SRC-17: cards projected from briefs (here from what a paper's row holds), marked as such."""
    f = chunks(spark, d, 0).groupBy("paper_id").agg(F.min_by("id", "ord").alias("first"))
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    results = F.when(s("card.novelty") != "", F.array(F.struct(F.col("card.novelty").alias("claim"), s("first").alias("chunk")))).otherwise(F.array().cast("array<struct<claim:string,chunk:string>>"))
    return papers(spark, d).join(f, F.col("id") == F.col("paper_id"), "left").select("id", s("title").alias("title_vi"), s("card.tldr_vi").alias("tldr_vi"), s("venue").alias("domain"), results.alias("results"), F.lit(True).alias("from_brief"))


@query()
def summary_tree(spark, d):
    """DOC-25: summaries over summaries, at most three levels."""
    return Sh.summary_tree(chunks(spark, d, 0)).select("paper_id", "level", "id", F.size("children").alias("n"))


@query()
def reader_documents_ingested(spark, d):
    """SRC-17: stored reader blocks as passages with ids and the default context."""
    p = B.passages(blocks(spark, d))
    t = table(spark, d, "parse_cache").groupBy(F.col("sha256").alias("doc")).agg(F.max_by("title", F.struct("created_at", "title")).alias("title"))
    ctx = F.btrim(F.concat(F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("section", F.lit(""))), F.lit(" —"))
    return p.join(t, "doc", "left").select(F.concat(F.left("doc", F.lit(12)), F.lit("c"), F.col("ord").cast("string")).alias("id"), "doc", "ord", "kind", ctx.alias("ctx"), "text")


@query(f"""WITH {BLOCKS} SELECT 'survey' AS tbl, count(*) AS n FROM survey UNION ALL SELECT 'paper', count(DISTINCT id) FROM paper UNION ALL SELECT 'chunk', count(DISTINCT id) FROM chunk UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'block', count(*) FROM bl""")
def table_scans(spark, d):
    """SRC-15: the stored tables read whole, each record once."""
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
    parts = [n(table(spark, d, "survey"), "survey"), n(table(spark, d, "paper").select("id").distinct(), "paper"), n(table(spark, d, "chunk").select("id").distinct(), "chunk"), n(table(spark, d, "documents").select("doc_id").distinct(), "documents"), n(blocks(spark, d), "block")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query(rf"""WITH {_LECT}, tx AS (SELECT doc, name, CASE name WHEN 'compare' THEN x || ' ' || upper(left(x, 3)) ELSE x END AS text FROM le WHERE name IN ('prereq', 'compare', 'limits') UNION ALL SELECT doc, name, text FROM ls WHERE name = 'evidence'),
sp AS (SELECT tx.doc AS id, tx.name, regexp_replace(tx.text || CASE WHEN ls.ord % 5 = 0 THEN ' at 00:12:30 we saw 4321.5 of it' ELSE '' END, '\d{{1,3}}:\d{{2}}(?::\d{{2}})?(?:[.,]\d+)?', ' ', 'g') AS text FROM tx JOIN ls ON ls.doc = tx.doc),
cl AS (SELECT DISTINCT id, {_norm("num")} AS num FROM ({_nums("sp", "text")}) WHERE num <> ''), own AS (SELECT id, coalesce(text, '') || ' ' || coalesce(vi, '') AS body FROM c), sz AS (SELECT id, regexp_extract(tok, '^[0-9]+([.,][0-9]+)*', 0) AS num FROM (SELECT id, unnest(regexp_extract_all(body, '[\p{{L}}\p{{M}}\p{{N}}_.,]+')) AS tok FROM own) WHERE regexp_matches(tok, '^[0-9]')),
s1 AS (SELECT id, {_norm("num")} AS num FROM sz UNION SELECT id, regexp_replace(num, '[.,]', '', 'g') FROM sz WHERE contains(num, '.') OR contains(num, ','))
SELECT id AS doc, 'fabricated_number' AS kind, num AS ref FROM cl WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.id = cl.id AND s1.num = cl.num)
UNION ALL SELECT doc, 'unknown_source', doc || 'zz' FROM ls WHERE ord % 6 = 0""")
def lecture_checks(spark, d):
    """VER-11: a lecture's claims against its paper: figures it does not hold (times of day are none), sources that do not exist (some of both are put in)."""
    c = chunks(spark, d, 0).filter("text is not null")
    lec = _lecture(spark, d)
    claims = Sh.lecture_texts(lec).filter(F.col("name").isin("evidence", "compare", "limits", "prereq", "check")).join(c.select(F.col("id").alias("doc"), "ord"), "doc")
    spoilt = F.concat("text", F.when(F.col("ord") % 5 == 0, F.lit(" at 00:12:30 we saw 4321.5 of it")).otherwise(""))
    sources = chunks(spark, d).select("id", F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("vi", F.lit(""))).alias("source"))
    cited = c.select(F.col("id").alias("doc"), F.when(F.col("ord") % 6 == 0, F.concat("id", F.lit("zz"))).otherwise(F.col("id")).alias("cite"))
    return V.lecture_warnings(claims.select(F.col("doc").alias("id"), spoilt.alias("text")), sources, cited)


@query(f"""WITH {PAPERS}, {CHUNKS}, r AS (SELECT item_id, item_id % 24 AS k FROM eval_item WHERE item_id % 3 <> 0) SELECT s.id AS survey_id, (SELECT count(*) FROM p WHERE p.survey_id = s.id) AS papers, (SELECT count(*) FROM c JOIN p ON p.id = c.paper_id WHERE p.survey_id = s.id) AS chunks,
(SELECT count(*) FROM r WHERE r.k = CAST(substr(s.id, 3) AS BIGINT) % 24) AS runs, CAST(substr(s.id, 3) AS BIGINT) % 3 = 0 AS has_synth FROM survey s""")
def corpus_overview(spark, d):
    """AGG-02, AGG-03: papers, passages, runs and whether there is a synthesis, corpus by corpus (runs and syntheses are drawn from the test items)."""
    p = papers(spark, d).select(F.col("id").alias("paper_id"), "survey_id")
    n = chunks(spark, d).groupBy("paper_id").agg(F.count("*").alias("n"))
    per = p.join(n, "paper_id", "left").groupBy("survey_id").agg(F.count("*").alias("papers"), F.sum(F.coalesce("n", F.lit(0))).alias("chunks"))
    runs = table(spark, d, "eval_item").filter("item_id % 3 <> 0").groupBy((F.col("item_id") % 24).alias("k")).agg(F.count("*").alias("runs"))
    k = F.substring("survey_id", 3, 10).cast("long")
    s = table(spark, d, "survey").select(F.col("id").alias("survey_id")).withColumn("k", k % 24)
    return s.join(per, "survey_id", "left").join(runs, "k", "left").select("survey_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("papers", "chunks", "runs")), (k % 3 == 0).alias("has_synth"))
