"""Document structure: blocks of parsed documents, passages, the summary tree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrion.operators import blocks as B
from papyrion.operators import corpus as C
from papyrion.operators import tree as Tr
from papyrion.plans.relational import CHUNKS, chunks
from papyrion.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

BLOCKS = """b0 AS (SELECT sha256 AS doc, arg_max(blocks, created_at) AS j FROM parse_cache GROUP BY sha256),
b1 AS (SELECT doc, from_json(j, '[{"id":"VARCHAR","type":"VARCHAR","text":"VARCHAR","section":"VARCHAR","level":"INTEGER","page":"INTEGER","translate":"BOOLEAN","marker":"VARCHAR","cont":"BOOLEAN","hidden":"BOOLEAN"}]') AS l FROM b0),
b AS (SELECT doc, unnest(range(len(l)))::INTEGER AS pos, unnest(l, recursive := false) AS x FROM b1),
bl AS (SELECT doc, pos, x.id, x.type, x.text, x.section, x.level, x.page, x.translate, x.hidden FROM b)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def blocks(spark, d):
    return B.blocks_of(table(spark, d, "parse_cache"))


@query(f"WITH {BLOCKS} SELECT doc, count(*) AS blocks, count(*) FILTER (WHERE translate AND NOT coalesce(hidden, false)) AS translatable, sum(length(text)) AS chars FROM bl GROUP BY doc")
def doc_listing(spark, d):
    """AGG-04, FLT-04: blocks and visible translatable blocks of each document."""
    b = blocks(spark, d)
    return b.groupBy("doc").agg(F.count("*").alias("blocks"), F.count_if(F.col("translate") & ~F.coalesce("hidden", F.lit(False))).alias("translatable"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {BLOCKS} SELECT type, count(*) AS n FROM bl GROUP BY type")
def block_histogram(spark, d):
    """AGG-19."""
    return blocks(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {BLOCKS} SELECT doc, pos, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) AS sec FROM bl")
def sticky_section(spark, d):
    """WIN-01."""
    return B.sticky_section(blocks(spark, d)).select("doc", "pos", "sec")


@query(rf"""WITH {BLOCKS}, ev AS (SELECT *, CASE WHEN type = 'heading' AND regexp_matches(text, '(?i)^\s*(\d+\s*\.?\s*)?(references?|bibliography|tài liệu tham khảo)\s*$') THEN 1 WHEN type = 'heading' AND regexp_matches(text, '(?i)^\s*(appendix|phụ lục|\d*\s*[a-z]\b)') THEN 0 END AS v FROM bl)
SELECT doc, pos, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), 0) AS in_refs FROM ev""")
def ref_latch(spark, d):
    """WIN-02: set at the references, cleared at an appendix."""
    return B.ref_latch(blocks(spark, d)).select("doc", "pos", "in_refs")


@query(rf"""WITH {BLOCKS}, o AS (SELECT doc, pos, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS t FROM bl), n AS (SELECT *, row_number() OVER (PARTITION BY doc, t ORDER BY pos) AS occ FROM o),
r AS (SELECT doc, t, pos AS old_pos, row_number() OVER (PARTITION BY doc, t ORDER BY pos) AS occ FROM o WHERE pos % 3 <> 0)
SELECT n.doc, n.pos, r.old_pos FROM n LEFT JOIN r ON r.doc = n.doc AND r.t = n.t AND r.occ = n.occ""")
def occurrence_merge(spark, d):
    """JOIN-10, WIN-03: blocks of a new parse joined to the old ones, k-th equal text to k-th (here the old parse lacks every third block)."""
    from papyrion.functions.text import collapse

    o = blocks(spark, d).select("doc", "pos", collapse(F.col("text")).alias("t"))
    n = C.occurrence(o, "doc", "t", "pos")
    r = C.occurrence(o.filter("pos % 3 <> 0"), "doc", "t", "pos").withColumnRenamed("pos", "old_pos")
    return n.join(r, ["doc", "t", "occ"], "left").select("doc", "pos", "old_pos")


@query(rf"""WITH {BLOCKS}, k AS (SELECT doc, page, lower(trim(regexp_replace(text, '\d+', '#', 'g'))) AS key FROM bl WHERE type IN ('para', 'meta'))
SELECT doc, key, count(DISTINCT page) AS pages FROM k WHERE length(key) > 3 AND length(key) < 90 GROUP BY doc, key HAVING count(DISTINCT page) >= 2""")
def running_headers(spark, d):
    """AGG-12: digit-masked lines on several pages."""
    return B.running_headers(blocks(spark, d))


_REFS = {"venue": r"(in proceedings|in european conference|in international conference|advances in neural|arxiv:|arxiv preprint|springer|journal of|transactions on|\bpp\.\s*\d|\b\d+:\s*\d+[-–]\d+)", "authors": r"[A-Z][a-zÀ-ỹ]+,\s*[A-Z]\.", "year": r"\b(19|20)\d{2}\b"}


def _refs(c: str) -> str:
    v, a, y = (f"len(regexp_extract_all({c}, '{'(?i)' if k == 'venue' else ''}{_REFS[k]}'))" for k in ("venue", "authors", "year"))
    ln = f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: length(x) > 25)"
    hit = f"len(list_filter({ln}, lambda x: regexp_matches(x, '{_REFS['year']}') AND (regexp_matches(x, '{B.REF_LINE_MARKS}') OR regexp_matches(x, '^{_REFS['authors']}'))))"
    return f"(length({c}) >= 120 AND ((len({ln}) >= 3 AND {hit} >= 3 AND {hit} / len({ln}) >= 0.6) OR ({v} >= 3 AND {y} >= 3) OR {a} >= 6))"


@query(f"SELECT doc_id, coalesce({_refs('text')}, false) AS refs FROM documents WHERE text IS NOT NULL")
def reference_lists(spark, d):
    """DOC-06: texts that are lists of references."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", B.looks_like_refs(F.col("text")).alias("refs"))


@query(rf"""WITH {BLOCKS} SELECT doc, pos FROM bl WHERE length(text) >= 60 AND regexp_matches(text, '{_REFS["year"]}') AND len(regexp_extract_all(text, '(?i){_REFS["venue"]}')) >= 1
AND (regexp_matches(text, '^\s*\[\d+\]') OR regexp_matches(text, '{_REFS["authors"]}') OR len(regexp_extract_all(text, '(?i){_REFS["venue"]}')) >= 2)
UNION ALL SELECT CAST(doc_id AS VARCHAR), pos FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS pos, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL) WHERE length(text) >= 60 AND regexp_matches(text, '{_REFS["year"]}')
 AND len(regexp_extract_all(text, '(?i){_REFS["venue"]}')) >= 1 AND (regexp_matches(text, '^\s*\[\d+\]') OR regexp_matches(text, '{_REFS["authors"]}') OR len(regexp_extract_all(text, '(?i){_REFS["venue"]}')) >= 2)""")
def ref_block_filter(spark, d):
    """DOC-05: single bibliographic entries among blocks and document lines."""
    b = blocks(spark, d).select("doc", "pos", "text")
    lines = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return b.unionByName(lines).filter(B.is_ref_block(F.col("text"))).select("doc", "pos")


_BARE = r"trim(regexp_replace(regexp_replace(trim(text), '[\^_]\{([^}]*)\}', '\1', 'g'), '^[\s\d*†‡§¶.)\]]+', ''))"


@query(rf"""WITH {BLOCKS}, x AS (SELECT doc, pos, {_BARE} AS bare FROM bl WHERE type IN ('para', 'meta') AND translate AND trim(text) <> '')
SELECT doc, pos FROM x WHERE {_refs("bare")} OR length(bare) < 12 OR regexp_matches(bare, '^[\s\d.,%()\[\]{{}}·•±+\-–—*/:;''"^_~$#@&|\\<>=]+$') OR (regexp_matches(bare, '[\w.+-]+@[\w-]+\.[\w.]{{2,}}') AND length(bare) < 220)
OR regexp_matches(bare, '\b\d{{4}}-\d{{4}}-\d{{4}}-\d{{3}}[\dX]\b') OR (regexp_matches(bare, '(?i)\b(University|Institute|Laborator|Academy|College|School of|Department of|Corresponding author|equal contribution|Our code|available at)\b') AND length(bare) < 200)""")
def mark_noise(spark, d):
    """DOC-08: blocks not worth translating."""
    return blocks(spark, d).filter("type in ('para', 'meta') and translate and trim(text) <> ''").filter(B.is_noise(F.col("text"))).select("doc", "pos")


@query(rf"""WITH {BLOCKS} SELECT doc, pos, CASE WHEN regexp_matches(text, '(?i)^\s*(figure|fig\.?|table|algorithm|listing)\s*\d+\s*([:.)\-–—]|$)') THEN
CASE WHEN lower(text) LIKE 'fig%' THEN 'fig' ELSE lower(regexp_extract(text, '(?i)^\s*(figure|fig\.?|table|algorithm|listing)\s*\d+', 1)) END || regexp_extract(text, '(\d+)', 1) ELSE '' END AS key FROM bl WHERE type = 'caption'""")
def caption_key(spark, d):
    """DOC-18."""
    return blocks(spark, d).filter("type = 'caption'").select("doc", "pos", B.caption_key(F.col("text")).alias("key"))


@query(rf"""WITH {BLOCKS}, x AS (SELECT *, max(CASE WHEN type = 'para' THEN pos END) OVER w AS pp, max(CASE WHEN type NOT IN ('para', 'caption', 'equation', 'figure', 'table') THEN pos END) OVER w AS wall FROM bl WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT x.doc, x.pos, x.text, CASE WHEN x.pp IS NOT NULL AND NOT coalesce(q.hidden, false) AND regexp_matches(rtrim(q.text), '[A-Za-zÀ-ỹ]{{2}}-$') AND regexp_matches(ltrim(x.text), '^[a-zà-ỹ]') AND x.pos - x.pp - 1 <= 4 AND coalesce(x.wall < x.pp, true) THEN 1 ELSE 0 END AS c
 FROM x LEFT JOIN bl q ON q.doc = x.doc AND q.pos = x.pp WHERE x.type = 'para' AND NOT coalesce(x.hidden, false)),
i AS (SELECT *, sum(1 - c) OVER (PARTITION BY doc ORDER BY pos) AS isle FROM j), l AS (SELECT *, lead(c, 1, 0) OVER (PARTITION BY doc ORDER BY pos) AS more FROM i)
SELECT doc, min(pos) AS pos, string_agg(CASE WHEN more = 1 THEN regexp_replace(rtrim(CASE WHEN c = 1 THEN ltrim(text) ELSE text END), '-$', '') ELSE CASE WHEN c = 1 THEN ltrim(text) ELSE text END END, '' ORDER BY pos) AS text, count(*) AS parts FROM l GROUP BY doc, isle""")
def stitch_runs(spark, d):
    """DOC-09: paragraphs broken within a word, joined over captions and equations."""
    return B.stitch_hyphenated(blocks(spark, d))


@query(rf"""WITH {BLOCKS}, q0 AS (SELECT doc, pos, CASE WHEN pos % 5 = 2 THEN 'equation' ELSE type END AS type, CASE WHEN pos % 5 = 1 THEN regexp_replace(text, '[.!?]+\s*$', '') WHEN pos % 5 = 3 THEN lower(text) ELSE text END AS text FROM bl), x AS (SELECT *, lag(type) OVER (PARTITION BY doc ORDER BY pos) AS before, max(CASE WHEN type <> 'equation' THEN pos END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp FROM q0)
SELECT x.doc, x.pos FROM x JOIN q0 q ON q.doc = x.doc AND q.pos = x.pp WHERE x.type = 'para' AND regexp_matches(ltrim(x.text), '^[a-zà-ỹ]') AND x.before = 'equation' AND q.type = 'para' AND trim(q.text) <> '' AND NOT regexp_matches(rtrim(q.text), '[.!?:;)\]"''’”]\s*$')""")
def mark_continuations(spark, d):
    """WIN-14: paragraphs that go on after an equation (equations are put between paragraphs here)."""
    pos = F.col("pos") % 5
    text = F.when(pos == 1, F.regexp_replace("text", r"[.!?]+\s*$", "")).when(pos == 3, F.lower("text")).otherwise(F.col("text"))
    b = blocks(spark, d)
    return B.continuations(b.withColumn("type", F.when(pos == 2, "equation").otherwise(F.col("type"))).withColumn("text", text))


@query(f"""WITH {BLOCKS} SELECT doc, pos, last_value(CASE WHEN type IN ('para', 'caption') THEN id END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before,
first_value(CASE WHEN type IN ('para', 'caption') THEN id END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS after FROM bl""")
def neighbour_blocks(spark, d):
    """WIN-04: nearest paragraph or caption within four blocks on both sides."""
    w = Window.partitionBy("doc").orderBy("pos")
    near = F.when(F.col("type").isin("para", "caption"), F.col("id"))
    return blocks(spark, d).select("doc", "pos", F.last(near, True).over(w.rowsBetween(-4, -1)).alias("before"), F.first(near, True).over(w.rowsBetween(1, 4)).alias("after"))


@query(f"""WITH {BLOCKS}, s AS (SELECT *, sum(CASE WHEN type = 'heading' AND coalesce(level, 1) <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS sec FROM bl)
SELECT doc, sec, count(*) AS blocks, sum(length(text)) AS chars, count(*) FILTER (WHERE translate) AS translatable FROM s GROUP BY doc, sec""")
def section_sums(spark, d):
    """AGG-06, WIN-09: blocks and characters by running section; 0 is what stands before the first heading."""
    s = blocks(spark, d).withColumn("sec", F.sum(F.when((F.col("type") == "heading") & (F.coalesce("level", F.lit(1)) <= 1), 1).otherwise(0)).over(Window.partitionBy("doc").orderBy("pos")))
    return s.groupBy("doc", "sec").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.count_if("translate").alias("translatable"))


@query(f"""WITH RECURSIVE {BLOCKS}, v AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k, pos, length(text) AS n, type = 'heading' AND coalesce(level, 1) <= 1 AS h FROM bl WHERE translate AND NOT coalesce(hidden, false)),
f(doc, k, pos, n, size, batch) AS (SELECT doc, k, pos, n, n, 1 FROM v WHERE k = 1 UNION ALL
 SELECT v.doc, v.k, v.pos, v.n, CASE WHEN f.size > 0 AND (f.size + v.n > 1500 OR (v.h AND f.size > 600)) THEN v.n ELSE f.size + v.n END, CASE WHEN f.size > 0 AND (f.size + v.n > 1500 OR (v.h AND f.size > 600)) THEN f.batch + 1 ELSE f.batch END FROM f JOIN v ON v.doc = f.doc AND v.k = f.k + 1)
SELECT doc, batch, min(pos) AS first, max(pos) AS last, count(*) AS n, sum(n) AS chars FROM f GROUP BY doc, batch""")
def batch_plan(spark, d):
    """DOC-01, AGG-23: greedy batches (here of 1,500 characters) as a fold inside the row of a document."""
    return B.batches(blocks(spark, d), 1500)


@query()
def passage_split(spark, d):
    """DOC-02, DOC-03, DOC-04, SRC-17: stored blocks as passages for search."""
    return B.passages(blocks(spark, d))


@query(f"""WITH {CHUNKS}, o AS (SELECT id, paper_id, level, ord FROM c), w AS (SELECT id, lag(id) OVER (PARTITION BY paper_id, level ORDER BY ord, id) AS before, lead(id) OVER (PARTITION BY paper_id, level ORDER BY ord, id) AS after FROM o) SELECT * FROM w""")
def chunk_neighbours(spark, d):
    """WIN-05: passages before and after on the same level."""
    w = Window.partitionBy("paper_id", "level").orderBy("ord", "id")
    return chunks(spark, d).select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


_RUNS = f"""{CHUNKS}, a AS (SELECT id, paper_id, ord, text, coalesce(section, '') AS s FROM c WHERE level = 0), r0 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR s <> lag(s) OVER w THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY paper_id ORDER BY ord, id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY paper_id ORDER BY ord, id) AS run FROM r0)"""
_CLUSTERS = f"""{_RUNS}, n AS (SELECT *, count(*) OVER (PARTITION BY paper_id, run) AS n FROM r),
g0 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (n >= 2 AND coalesce(lag(run) OVER w, 0) <> run) THEN 1 ELSE 0 END AS st FROM n WINDOW w AS (PARTITION BY paper_id ORDER BY ord, id)),
g AS (SELECT *, sum(st) OVER (PARTITION BY paper_id ORDER BY ord, id) AS grp FROM g0), k AS (SELECT paper_id, id, ord, text, grp AS run, ((row_number() OVER (PARTITION BY paper_id, grp ORDER BY ord, id)) - 1) // 6 AS cluster FROM g)"""


@query(f"WITH {_RUNS} SELECT id, run FROM r")
def section_runs(spark, d):
    """WIN-06: runs of equal sections."""
    return Tr.section_runs(chunks(spark, d, 0)).select("id", "run")


@query(f"WITH {_CLUSTERS} SELECT paper_id, id, run, cluster FROM k")
def tree_clusters(spark, d):
    """DOC-24 without vectors: section runs cut every six passages."""
    return Tr.fixed_clusters(chunks(spark, d, 0))


@query()
def tree_clusters_similar(spark, d):
    """DOC-24, WIN-07, TRE-01 with vectors: long runs cut where neighbours are least alike."""
    e = table(spark, d, "emb").filter("model = 'enc-base' and vec is not null and size(vec) = dim").groupBy("chunk_id").agg(F.min("vec").alias("vec"))
    return Tr.similar_clusters(chunks(spark, d, 0), e)


@query(f"WITH {_CLUSTERS} SELECT paper_id, run, cluster, count(*) AS n, left(string_agg(left(coalesce(text, ''), 220), ' ' ORDER BY ord, id), 1200) AS text FROM k GROUP BY paper_id, run, cluster")
def summary_fallback(spark, d):
    """DOC-25, DOC-26: summaries from the starts of the children."""
    c = chunks(spark, d, 0)
    return Tr.summaries(c, Tr.fixed_clusters(c))
