"""Page geometry, edits of stored documents, small filters and the remaining windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrion.operators import corpus as C
from papyrion.operators import edits as Ed
from papyrion.operators import geometry as G
from papyrion.plans.graphs import EDGES, _edges
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


#: Boxes and runs drawn from the passages' places by arithmetic: no table holds glyphs.
BOXES = f"""{CHUNKS}, box AS (SELECT paper_id AS doc, coalesce(page, 0) AS page, id AS box_id, ((ord % 3) * 100)::DOUBLE AS x0, ((ord % 7) * 90)::DOUBLE AS y0, ((ord % 3) * 100 + 120)::DOUBLE AS x1, ((ord % 7) * 90 + 40 + ord % 50)::DOUBLE AS y1 FROM c WHERE level = 0),
span AS (SELECT paper_id AS doc, coalesce(page, 0) AS page, id || '_' || CAST(k AS VARCHAR) AS span_id, (k * 37 + ord % 11)::DOUBLE AS x0, (((ord + k) % 9) * 75)::DOUBLE AS y0, (k * 37 + ord % 11 + 30)::DOUBLE AS x1, (((ord + k) % 9) * 75 + 12)::DOUBLE AS y1, round((9 + (ord + k) % 4 * 0.5)::DOUBLE, 1) AS size, left(coalesce(text, ''), 5 + k) AS text FROM c, (SELECT unnest(range(8))::INTEGER AS k) WHERE level = 0)"""


def _boxes(spark, d):
    c = chunks(spark, d, 0)
    o = F.col("ord")
    return c.select(F.col("paper_id").alias("doc"), F.coalesce("page", F.lit(0)).alias("page"), F.col("id").alias("box_id"), ((o % 3) * 100.0).alias("x0"), ((o % 7) * 90.0).alias("y0"), ((o % 3) * 100.0 + 120).alias("x1"), ((o % 7) * 90.0 + 40 + o % 50).alias("y1"))


def _spans(spark, d):
    c = chunks(spark, d, 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    o, k = F.col("ord"), F.col("k")
    x, y = k * 37.0 + o % 11, ((o + k) % 9) * 75.0
    return c.select(F.col("paper_id").alias("doc"), F.coalesce("page", F.lit(0)).alias("page"), F.concat("id", F.lit("_"), k.cast("string")).alias("span_id"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 12).alias("y1"), F.round(9 + (o + k) % 4 * 0.5, 1).alias("size"), F.left(F.coalesce("text", F.lit("")), 5 + k).alias("text"))


_IN = "(s.x0 + s.x1) / 2 BETWEEN b.x0 AND b.x1 AND (s.y0 + s.y1) / 2 BETWEEN b.y0 AND b.y1"


@query(f"""WITH {BOXES}, j AS (SELECT s.doc, s.page, s.span_id, b.box_id, {_IN} AS i, (b.x1 - b.x0) * (b.y1 - b.y0) AS area,
round(greatest(0, least(s.x1, b.x1) - greatest(s.x0, b.x0)) * greatest(0, least(s.y1, b.y1) - greatest(s.y0, b.y0)) / ((s.x1 - s.x0) * (s.y1 - s.y0)), 9) AS share FROM span s JOIN box b ON s.doc = b.doc AND s.page = b.page)
SELECT doc, page, span_id, box_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, span_id ORDER BY CASE WHEN i THEN 0 ELSE 1 END, CASE WHEN i THEN area ELSE -share END, box_id) AS r FROM j WHERE i OR share >= 0.33) WHERE r = 1""")
def assign_spans(spark, d):
    """JOIN-12: runs to boxes by their centre, leftovers by the covered share."""
    return G.assign_spans(_spans(spark, d), _boxes(spark, d))


@query(f"WITH {BOXES} SELECT span_id FROM span s WHERE NOT EXISTS (SELECT 1 FROM box b WHERE s.doc = b.doc AND s.page = b.page AND {_IN})")
def uncovered_spans(spark, d):
    """JOIN-13, DOC-20: runs outside all boxes."""
    return G.uncovered(_spans(spark, d), _boxes(spark, d)).select("span_id")


@query(f"""WITH {BOXES}, w AS (SELECT *, CASE WHEN y0 > max(y1) OVER (PARTITION BY doc, page ORDER BY y0, y1, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 26 THEN 1 WHEN row_number() OVER (PARTITION BY doc, page ORDER BY y0, y1, box_id) = 1 THEN 1 ELSE 0 END AS st FROM box),
b AS (SELECT *, sum(st) OVER (PARTITION BY doc, page ORDER BY y0, y1, box_id) AS band FROM w) SELECT doc, page, band, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM b GROUP BY doc, page, band""")
def merged_bands(spark, d):
    """DOC-22: rectangles merged by one sweep."""
    return G.merged_bands(_boxes(spark, d))


@query(f"WITH {BOXES}, n AS (SELECT doc, size, sum(length(text)) AS n FROM span GROUP BY doc, size) SELECT doc, size FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, size) AS r FROM n) WHERE r = 1")
def body_font(spark, d):
    """AGG-09, AGG-10: mode of the font size, weighted by characters."""
    return G.body_size(_spans(spark, d))


@query(f"WITH {BOXES} SELECT doc, box_id, row_number() OVER (PARTITION BY doc ORDER BY page, CASE WHEN x0 >= 150 THEN 1 ELSE 0 END, round(y0, 1), x0, box_id) AS place FROM box")
def reading_order(spark, d):
    """SORT-03."""
    return G.reading_order(_boxes(spark, d), 150.0)


@query(f"""WITH {BOXES}, g AS (SELECT doc, page, round(y0, 0) AS line, round(x0 - lag(x1) OVER (PARTITION BY doc, page, round(y0, 0) ORDER BY x0, span_id), 6) AS gap FROM span), a AS (SELECT doc, page, line, list_sort(list(gap)) AS l FROM g WHERE gap IS NOT NULL GROUP BY doc, page, line)
SELECT doc, page, line, l[len(l) // 2 + 1] AS gap, len(l) AS n FROM a""")
def line_gaps(spark, d):
    """AGG-11: median gaps of lines."""
    return G.line_gaps(_spans(spark, d))


@query(f"""WITH {BLOCKS} SELECT doc, id, CASE WHEN pos % 6 = 1 THEN false WHEN pos % 6 = 4 THEN true ELSE translate END AS translate, CASE WHEN pos % 10 = 3 THEN true ELSE coalesce(hidden, false) END AS hidden FROM bl WHERE pos % 7 <> 5""")
def block_edits(spark, d):
    """MUT-05: drop, skip, keep and hide blocks by a table of edits."""
    b = blocks(spark, d)
    rules = (("drop", 7, 5), ("skip", 6, 1), ("keep", 6, 4), ("hide", 10, 3))
    e = None
    for no, (action, m, r) in enumerate(rules):
        x = b.filter(F.col("pos") % m == r).select("doc", "id", F.lit(action).alias("action"), F.lit(no).alias("no"))
        e = x if e is None else e.unionByName(x)
    return Ed.apply_flags(b, e).select("doc", "id", "translate", "hidden")


@query(rf"""WITH {BLOCKS}, m AS (SELECT *, CASE WHEN regexp_matches(ltrim(text), '^[a-zà-ỹ]') AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM bl WHERE type = 'para' WINDOW w AS (PARTITION BY doc ORDER BY pos)),
i AS (SELECT *, sum(1 - c) OVER (PARTITION BY doc ORDER BY pos) AS isle, lead(c, 1, 0) OVER (PARTITION BY doc ORDER BY pos) AS more, lead(text) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM m),
t AS (SELECT *, CASE WHEN c = 1 THEN ltrim(text) ELSE text END AS own FROM i)
SELECT doc, arg_min(id, pos) AS id, min(pos) AS pos, string_agg(CASE WHEN more = 0 THEN own WHEN regexp_matches(rtrim(own), '[A-Za-zÀ-ỹ]-$') AND regexp_matches(ltrim(nxt), '^[a-zà-ỹ]') THEN regexp_replace(rtrim(own), '-$', '') ELSE rtrim(own) || ' ' END, '' ORDER BY pos) AS text, count(*) AS n FROM t GROUP BY doc, isle""")
def block_merge(spark, d):
    """MUT-06: lower-case paragraphs joined to the block before."""
    b = blocks(spark, d).filter("type = 'para'")
    return Ed.merge_into_previous(b, F.ltrim("text").rlike("^[a-zà-ỹ]"))


@query(f"""WITH {BLOCKS}, t AS (SELECT doc, max(TRY_CAST(regexp_extract(id, '^b([0-9]+)$', 1) AS INTEGER)) AS top FROM bl GROUP BY doc), x AS (SELECT bl.doc, bl.pos, bl.id, bl.text, t.top, CASE WHEN pos % 5 = 2 AND length(text) > 40 THEN 1 ELSE 0 END AS c FROM bl JOIN t USING (doc)),
y AS (SELECT *, top + sum(c) OVER (PARTITION BY doc ORDER BY pos) AS fresh FROM x)
SELECT doc, pos, 0 AS part, id, CASE WHEN c = 1 THEN rtrim(left(text, 40)) ELSE text END AS text FROM y UNION ALL SELECT doc, pos, 1, 'b' || CAST(CAST(fresh AS BIGINT) AS VARCHAR), ltrim(substr(text, 41)) FROM y WHERE c = 1""")
def block_split(spark, d):
    """MUT-07, DOC-31: blocks cut at an offset, fresh ids after the highest."""
    b = blocks(spark, d)
    return Ed.split_at(b, b.filter("pos % 5 = 2").select("doc", "id", F.lit(40).alias("at")))


@query("SELECT p.sha256, CASE WHEN contains(lower(d.title), lower(p.title)) AND length(d.title) > length(p.title) AND trim(p.title) <> '' THEN d.title ELSE p.title END AS title FROM (SELECT sha256, arg_max(title, created_at) AS title FROM parse_cache WHERE title IS NOT NULL GROUP BY sha256 UNION ALL SELECT sha256, NULL FROM parse_cache GROUP BY sha256 HAVING count(title) = 0) p LEFT JOIN (SELECT sha256, min(title) AS title FROM paper WHERE sha256 IS NOT NULL GROUP BY sha256) d ON d.sha256 = p.sha256")
def title_repair(spark, d):
    """MUT-12: a longer title that holds the old one (the newest known) replaces it."""
    p = table(spark, d, "parse_cache").groupBy("sha256").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.struct("created_at", "title"))).alias("old"))
    n = table(spark, d, "paper").filter("sha256 is not null").groupBy("sha256").agg(F.min("title").alias("new"))
    return p.join(n, "sha256", "left").select("sha256", Ed.better_title(F.col("old"), F.col("new")).alias("title"))


@query(f"WITH {CHUNKS}, ch AS (SELECT paper_id, list(id) AS ids FROM c WHERE level = 0 AND ord % 4 = 0 GROUP BY paper_id) SELECT c.id FROM c JOIN ch USING (paper_id) WHERE c.level > 0 AND list_has_any(c.children, ch.ids)")
def stale_outputs(spark, d):
    """MUT-08: summaries that rest on a changed passage."""
    c = chunks(spark, d)
    out = c.filter("level > 0").select(F.col("paper_id").alias("doc"), "id", F.col("children").alias("sources"))
    return Ed.stale(out, c.filter("level = 0 and ord % 4 = 0").select(F.col("paper_id").alias("doc"), "id")).select("id")


@query(f"""WITH {EDGES}, terms AS (SELECT DISTINCT name AS term FROM ent), tk AS (SELECT term, left(trim(regexp_replace(regexp_replace(lower(term), '[^a-z0-9À-ỹ ]+', ' ', 'g'), ' +', ' ', 'g')), 80) AS k FROM terms),
w AS (SELECT paper_id AS doc, ord AS pos, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9À-ỹ ]+', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM c WHERE level = 0 AND text IS NOT NULL),
g AS (SELECT doc, pos, unnest(w) AS k FROM w UNION SELECT doc, pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2 UNION SELECT doc, pos, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) >= 3),
h AS (SELECT g.doc, tk.term, min(g.pos) AS pos FROM g JOIN tk ON tk.k = g.k WHERE tk.k <> '' GROUP BY g.doc, tk.term)
SELECT doc, term, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc, pos ORDER BY length(term) DESC, term) AS r FROM h) WHERE r = 1""")
def attach_terms(spark, d):
    """JOIN-16, WIN-08: glossary terms at their first passage, one a passage, the longest first."""
    from papyrion.operators.graph import entities

    c = chunks(spark, d, 0).filter("text is not null").select(F.col("paper_id").alias("doc"), F.col("ord").alias("pos"), "text")
    return Ed.first_mentions(c, entities(_edges(spark, d)).select(F.col("name").alias("term")).distinct())


@query()
def wrap_fit(spark, d):
    """DOC-30, SORT-09: wrapped lines of a card and the largest scale at which it fits."""
    c = chunks(spark, d).filter("level > 0 and text is not null")
    lines = Ed.wrapped_lines(F.col("text"), 60)
    return c.select("id", lines.alias("lines"), Ed.largest_scale(lines * 1.0, 6.0).alias("scale"))


@query(f"WITH {PAPERS} SELECT id, regexp_full_match(id, '[\\p{{L}}\\p{{N}}]+') AS ok, doi IS NOT NULL AND lower(doi) IN (SELECT regexp_extract(lower(text), '10\\.[0-9]{{4,5}}/[a-z]+\\.[0-9]+', 0) FROM documents WHERE text IS NOT NULL) AS known, url IS NULL AND status = 'abstract_only' AS abstract_only FROM p")
def paper_flags(spark, d):
    """FLT-01, FLT-10, FLT-13: id shape, membership by identifier, abstract-only rows."""
    known = table(spark, d, "documents").filter("text is not null").select(F.regexp_extract(F.lower("text"), r"10\.[0-9]{4,5}/[a-z]+\.[0-9]+", 0).alias("k")).filter("k <> ''").distinct()
    p = papers(spark, d).join(known, F.lower("doi") == F.col("k"), "left")
    return p.select("id", F.col("id").rlike(r"^[\p{L}\p{N}]+$").alias("ok"), F.col("k").isNotNull().alias("known"), (F.col("url").isNull() & (F.col("status") == "abstract_only")).alias("abstract_only"))


@query(f"WITH {CHUNKS} SELECT id, left(text, 600) AS hit, left(text, 400) AS short FROM c WHERE id IN (SELECT chunk_id FROM emb WHERE model = 'enc-mini')")
def slim_hits(spark, d):
    """FLT-05, FLT-07: a batch of ids looked up by a semi-join, texts cut for display."""
    ids = table(spark, d, "emb").filter("model = 'enc-mini'").select(F.col("chunk_id").alias("id"))
    return chunks(spark, d).join(ids, "id", "left_semi").select("id", F.left("text", F.lit(600)).alias("hit"), F.left("text", F.lit(400)).alias("short"))


@query(f"WITH {CHUNKS}, l AS (SELECT id, paper_id, list_transform(children, lambda x: left(x, length(x) - 1)) AS l FROM c WHERE level > 0) SELECT paper_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS kept, id FROM l")
def plan_repair(spark, d):
    """FLT-14, SET-03: lists without repeats in first order, cut to a cap."""
    return chunks(spark, d).filter("level > 0").select("paper_id", F.slice(F.array_distinct(F.transform("children", lambda x: F.left(x, F.length(x) - 1))), 1, 5).alias("kept"), "id")



@query(f"""WITH {CHUNKS}, k AS (SELECT kind, coalesce(section, '') AS section, count(*) AS n FROM c GROUP BY ALL) SELECT kind, section, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, section) AS r FROM k) WHERE r <= 24""")
def top_by_kind(spark, d):
    """The 24 most frequent sections of each kind of passage (AGG-20 itself: entities_by_kind)."""
    k = chunks(spark, d).groupBy("kind", F.coalesce("section", F.lit("")).alias("section")).agg(F.count("*").alias("n"))
    return k.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "section"))).filter("r <= 24").drop("r")


@query(f"""WITH {CHUNKS}, o AS (SELECT * FROM c WHERE level = 0 AND ord <= 3), n AS (SELECT id, 'new' AS text FROM c WHERE level = 0 AND ord = 2 UNION ALL SELECT id, 'new' FROM c WHERE level = 0 AND ord = 4)
SELECT id, text FROM n UNION ALL SELECT id, text FROM o WHERE id NOT IN (SELECT id FROM n)""")
def keyed_replace(spark, d):
    """SNK-01: rows replaced by key, others kept, new ones added."""
    c = chunks(spark, d, 0)
    new = c.filter("ord = 2 or ord = 4").select("id", F.lit("new").alias("text"))
    return C.replace_by_key(c.filter("ord <= 3").select("id", "text"), new, "id")


@query("SELECT sha256, max(created_at) AS newest, count(*) AS n FROM parse_cache GROUP BY sha256")
def newest_parse(spark, d):
    """SRC-16, MEM-01: newest stored parse of each file."""
    return table(spark, d, "parse_cache").groupBy("sha256").agg(F.max("created_at").alias("newest"), F.count("*").alias("n"))


@query(f"""WITH {BLOCKS}, s AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS sec FROM bl), f AS (SELECT doc, sec, arg_min(id, pos) AS fig FROM s WHERE type IN ('caption', 'equation') GROUP BY doc, sec)
SELECT h.doc, h.sec, f.fig, max(h.sec) OVER (PARTITION BY h.doc) AS total FROM (SELECT DISTINCT doc, sec FROM s WHERE type = 'heading') h LEFT JOIN f ON f.doc = h.doc AND f.sec = h.sec""")
def section_figures(spark, d):
    """WIN-09, WIN-10: numbered sections and the first figure after each divider."""
    w = Window.partitionBy("doc").orderBy("pos")
    s = blocks(spark, d).withColumn("sec", F.sum((F.col("type") == "heading").cast("int")).over(w))
    fig = s.filter("type in ('caption', 'equation')").groupBy("doc", "sec").agg(F.min_by("id", "pos").alias("fig"))
    h = s.filter("type = 'heading'").select("doc", "sec").distinct().withColumn("total", F.max("sec").over(Window.partitionBy("doc")))
    return h.join(fig, ["doc", "sec"], "left").select("doc", "sec", "fig", "total")


@query(f"WITH {BLOCKS} SELECT doc, pos FROM (SELECT doc, pos, row_number() OVER (PARTITION BY doc, lower(regexp_extract(text, '^(\\w+ \\d+|.{{0,12}})', 1)) ORDER BY pos) AS r FROM bl WHERE type IN ('caption', 'heading')) WHERE r > 1")
def repeated_figures(spark, d):
    """WIN-11: figures and headings whose label came earlier in the document."""
    w = Window.partitionBy("doc", F.lower(F.regexp_extract("text", r"^(\w+ \d+|.{0,12})", 1))).orderBy("pos")
    return blocks(spark, d).filter("type in ('caption', 'heading')").withColumn("r", F.row_number().over(w)).filter("r > 1").select("doc", "pos")


@query(rf"""WITH {BLOCKS}, n AS (SELECT doc, pos, TRY_CAST(regexp_extract(text, '^(\d+)\.?\s+[A-Z]', 1) AS INTEGER) AS k FROM bl WHERE type = 'heading'), l AS (SELECT *, lag(k) OVER (PARTITION BY doc ORDER BY pos) AS p FROM n WHERE k IS NOT NULL) SELECT doc, pos, k, coalesce(k = p + 1, false) AS follows FROM l""")
def heading_numbers(spark, d):
    """Numbered headings that follow the one before (WIN-12 itself: list_items)."""
    n = blocks(spark, d).filter("type = 'heading'").select("doc", "pos", F.expr(r"try_cast(regexp_extract(text, '^(\\d+)\\.?\\s+[A-Z]', 1) AS int)").alias("k")).filter("k is not null")
    return n.select("doc", "pos", "k", F.coalesce(F.col("k") == F.lag("k").over(Window.partitionBy("doc").orderBy("pos")) + 1, F.lit(False)).alias("follows"))


@query(f"""WITH RECURSIVE {CHUNKS}, e AS (SELECT DISTINCT id AS parent, unnest(children) AS child FROM c WHERE level > 0), t(id, depth) AS (SELECT id, 0 FROM (SELECT DISTINCT parent AS id FROM e) x WHERE id NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN e ON e.parent = t.id WHERE t.depth < 6)
SELECT id, max(depth) AS depth FROM t GROUP BY id""")
def tree_levels(spark, d):
    """DOC-29: longest-path levels over the tree's edges, at most six joins."""
    e = chunks(spark, d).filter("level > 0").select(F.col("id").alias("parent"), F.explode("children").alias("child")).distinct()
    front = e.select(F.col("parent").alias("id")).distinct().join(e.select(F.col("child").alias("id")), "id", "left_anti").withColumn("depth", F.lit(0))
    every = front
    for _ in range(6):
        front = front.join(e, F.col("id") == F.col("parent")).select(F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"))
        every = every.unionByName(front)
    return every.groupBy("id").agg(F.max("depth").alias("depth"))
