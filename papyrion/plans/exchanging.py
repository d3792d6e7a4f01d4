"""Queries of sources and sinks: services' answers (written out here from the tables, read back), exports, replacements, edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrion.functions import text as T
from papyrion.operators import biblio as Bib
from papyrion.operators import corpus as C
from papyrion.operators import exchange as X
from papyrion.operators import memo as M
from papyrion.plans.relational import CHUNKS, MEMO, PAPERS, chunks, memo, papers
from papyrion.plans.structure import BLOCKS, blocks
from papyrion.session import table
from papyrion.sources import readers as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WS = r"trim(regexp_replace({0}, '[ \t\n\r\f]+', ' ', 'g'))"


@query(r"""WITH x AS (SELECT doc_id, 'https://preprints.example/abs/' || lpad(CAST(doc_id % 9999 AS VARCHAR), 4, '1') || '.' || lpad(CAST(doc_id % 77777 AS VARCHAR), 5, '0') || CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE '' END || ' ' || left(coalesce(text, ''), 20) AS t FROM documents)
SELECT doc_id, regexp_extract(t, '(\d{4}\.\d{4,5}(?:v\d+)?)', 1) AS pid FROM x""")
def preprint_ids(spark, d):
    """SRC-05: identifiers of a preprint server in addresses (written out here)."""
    i = F.col("doc_id")
    t = F.concat(F.lit("https://preprints.example/abs/"), F.lpad((i % 9999).cast("string"), 4, "1"), F.lit("."), F.lpad((i % 77777).cast("string"), 5, "0"), F.when(i % 3 == 0, "v2").otherwise(""), F.lit(" "), F.left(F.coalesce("text", F.lit("")), F.lit(20)))
    return table(spark, d, "documents").select("doc_id", F.regexp_extract(t, X.PREPRINT_ID, 1).alias("pid"))


@query(f"WITH {PAPERS} SELECT {_WS.format('title')} AS title, {_WS.format('authors')} AS summary, year, url FROM p WHERE title IS NOT NULL AND authors IS NOT NULL AND url IS NOT NULL AND NOT contains(title || authors, '<')")
def atom_scan(spark, d):
    """SRC-06: entries of Atom feeds as bibliographic rows."""
    p = papers(spark, d).filter("title is not null and authors is not null and url is not null and not contains(concat(title, authors), '<')")
    entry = F.concat(F.lit("<entry><id>"), "url", F.lit("</id><published>"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("-02-03T00:00:00Z</published><title>"), "title", F.lit("</title><summary type='text'>\n  "), "authors", F.lit("\n</summary></entry>"))
    feed = p.groupBy("survey_id").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</feed>")).alias("x"))
    return R.atom_entries(feed, "x").select("title", "summary", "year", "url")


@query(f"""WITH {PAPERS}, {CHUNKS}, a AS (SELECT paper_id, min(text) AS text FROM c WHERE kind = 'abstract' AND trim(coalesce(text, '')) <> '' GROUP BY paper_id)
SELECT lower(doi) AS doi, title, year, coalesce(cites, 0) AS cites, left({_WS.format('a.text')}, 1500) AS abstract FROM p LEFT JOIN a ON a.paper_id = p.id""")
def open_index_scan(spark, d):
    """SRC-07, SRC-08: JSON rows of an open index, abstracts rebuilt from their inverted indexes."""
    a = chunks(spark, d).filter("kind = 'abstract' and trim(coalesce(text, '')) <> ''").groupBy("paper_id").agg(F.min("text").alias("text"))
    w = a.select("paper_id", F.posexplode(F.split(T.collapse(F.col("text")), " ")).alias("i", "w")).groupBy("paper_id", "w").agg(F.collect_list("i").alias("ps"))
    idx = w.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("abstract_inverted_index"))
    p = papers(spark, d).join(idx, F.col("id") == F.col("paper_id"), "left")
    j = p.select(F.to_json(F.struct("doi", "title", F.col("year").alias("publication_year"), F.coalesce("cites", F.lit(0)).alias("cited_by_count"), "abstract_inverted_index")).alias("j"))
    r = j.select(F.from_json("j", X.OPEN_INDEX).alias("r"))
    text = F.when(F.col("r.abstract_inverted_index").isNotNull(), Bib.rebuild_inverted(F.col("r.abstract_inverted_index")))
    return r.select(F.lower("r.doi").alias("doi"), F.col("r.title").alias("title"), F.col("r.publication_year").alias("year"), F.coalesce("r.cited_by_count", F.lit(0)).alias("cites"), text.alias("abstract"))


@query(f"WITH {PAPERS} SELECT lower(doi) AS doi, title, {_WS.format('authors')} AS abstract, coalesce(cites, 0) AS cites, year FROM p WHERE doi IS NOT NULL AND NOT contains(coalesce(authors, ''), '<')")
def registry_scan(spark, d):
    """SRC-09: JSON rows of a registry, tags out of abstracts, years out of date parts."""
    p = papers(spark, d).filter("doi is not null and not contains(coalesce(authors, ''), '<')")
    parts = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year", F.lit(1))).alias("date-parts")))
    j = p.select(F.to_json(F.struct(F.col("doi").alias("DOI"), F.when(F.col("title").isNotNull(), F.array("title")).alias("title"), F.concat(F.lit("<jats:p>"), F.replace("authors", F.lit(" "), F.lit(" <i/> ")), F.lit("</jats:p>")).alias("abstract"), F.col("cites").alias("is-referenced-by-count"), parts.alias("issued"))).alias("j"))
    return R.registry_rows(j, "j").select("doi", "title", "abstract", "cites", "year")


_WEB = f"""{PAPERS}, w AS (SELECT left(coalesce(title, ''), 300) AS title, coalesce(url, '') || CASE CAST(right(id, 1) AS INTEGER) % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '/pdf/x' ELSE '' END AS url, left(coalesce(authors, ''), 1000) AS abstract FROM p WHERE regexp_matches(id, '[0-9]$'))"""


def _web(spark, d):
    p = papers(spark, d).filter(F.col("id").rlike("[0-9]$")).withColumn("k", F.right("id", F.lit(1)).cast("int"))
    u = F.concat(F.coalesce("url", F.lit("")), F.when(F.col("k") % 3 == 0, ".PDF").when(F.col("k") % 3 == 1, "/pdf/x").otherwise(""))
    p = p.select("k", "title", u.alias("url"), "authors")
    out = None
    for provider, digits in (("brave", (0, 1, 2, 3)), ("tavily", (4, 5, 6)), ("serper", (7, 8, 9))):
        own = p.filter(F.col("k").isin(*digits))
        row = {"brave": F.struct(F.struct(F.array(F.struct("title", "url", F.col("authors").alias("description"))).alias("results")).alias("web")), "tavily": F.struct(F.array(F.struct("title", "url", F.col("authors").alias("content"))).alias("results")), "serper": F.struct(F.array(F.struct("title", F.col("url").alias("link"), F.col("authors").alias("snippet"))).alias("organic"))}[provider]
        rows = X.web_rows(own.select(F.to_json(row).alias("j")), provider, "j").withColumn("provider", F.lit(provider))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_WEB} SELECT title, url, CASE WHEN suffix(lower(url), '.pdf') OR contains(lower(url), '/pdf/') THEN url ELSE '' END AS pdf_url, abstract FROM w")
def web_scan(spark, d):
    """SRC-10: answers of three web search services as rows, files told by their address."""
    return _web(spark, d).drop("provider")


@query(f"""WITH {PAPERS}, a AS (SELECT id, title, authors, venue, doi, cites, year, url, source FROM p UNION ALL SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), title, authors, NULL, NULL, NULL, year, NULL, 'web' FROM documents WHERE title IS NOT NULL),
k AS (SELECT *, CASE WHEN trim(lower(coalesce(doi, ''))) <> '' THEN trim(lower(doi)) ELSE trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) END AS k FROM a),
g AS (SELECT k, arg_min(title, CASE WHEN coalesce(title, '') <> '' THEN id END) AS title, arg_min(year, CASE WHEN year IS NOT NULL THEN id END) AS year, arg_min(url, CASE WHEN coalesce(url, '') <> '' THEN id END) AS url, max(coalesce(cites, 0)) AS cites FROM k WHERE k <> '' GROUP BY k),
s AS (SELECT k, title, round(0.55 * ln(1 + cites) + 0.30 * CASE WHEN coalesce(year, 0) > 0 THEN greatest(0.0, (year - 2015) / 10.0) ELSE 0 END + CASE WHEN coalesce(url, '') <> '' THEN 0.35 ELSE 0 END, 6) AS score FROM g)
SELECT k, title, score, r FROM (SELECT *, row_number() OVER (ORDER BY score DESC, k) AS r FROM s) WHERE r <= 40""")
def find_works(spark, d):
    """SRC-11: several sources as one, copies merged, the best forty by citations, recency and access (the limit is the feature)."""
    p = papers(spark, d).select("id", "title", "authors", "venue", "doi", "cites", "year", "url", "source")
    w = table(spark, d, "documents").filter("title is not null").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"), "title", "authors", "year", F.lit("web").alias("source"))
    m = Bib.dedup(R.union_sources(p, w), "id", ["title", "year", "url"]).withColumn("score", F.round(Bib.rank_score(), 6))
    best = m.orderBy(F.desc("score"), "k").limit(40)
    return best.select("k", "title", "score", F.row_number().over(Window.orderBy(F.desc("score"), "k")).alias("r"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE props END AS props FROM events WHERE props IS NOT NULL""")
def json_extract_shapes(spark, d):
    """SRC-12: JSON by itself, in a fence, within prose with brackets around; cut off it is none."""
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.concat(F.lit("  "), "props", F.lit("\n"))).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("As asked [sic] (see {below}): "), "props", F.lit(" That is all }]."))).otherwise(F.expr("left(props, length(props) - 1)"))
    return table(spark, d, "events").filter("props is not null").select("event_id", t.alias("t")).select("event_id", R.json_in_text("t").alias("props"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, title FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'old ' || title FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 = 0""")
def legacy_load(spark, d):
    """SRC-14: rows of an older store are taken in where their id is not stored yet."""
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "title", "doc_id")
    stored = x.filter("doc_id % 2 = 0")
    old = x.filter("doc_id % 3 = 0").select("id", "doc_id", F.to_json(F.struct("id", F.concat(F.lit("old "), "title").alias("title"))).alias("j"))
    new = old.select(F.from_json("j", "struct<id:string,title:string>").alias("r")).select("r.id", "r.title").join(stored, "id", "left_anti")
    return stored.select("id", "title").unionByName(new)


@query(f"WITH {CHUNKS}, n AS (SELECT DISTINCT paper_id FROM c WHERE paper_id LIKE '%6') SELECT id, level, text FROM c WHERE paper_id NOT IN (SELECT paper_id FROM n) UNION ALL SELECT id, level, upper(text) FROM c WHERE paper_id IN (SELECT paper_id FROM n) AND level = 0 AND ord <= 2")
def leaves_put(spark, d):
    """SNK-02: the leaves of some papers replaced, their trees wiped."""
    c = chunks(spark, d).select("id", "paper_id", "level", "text", "ord")
    new = c.filter("paper_id like '%6' and level = 0 and ord <= 2").withColumn("text", F.upper("text"))
    return X.put_leaves(c, new).select("id", "level", "text")


@query(f"WITH {CHUNKS}, n AS (SELECT paper_id, paper_id || 's1' AS id, count(*) AS k FROM c WHERE paper_id LIKE '%6' AND level = 0 GROUP BY paper_id) SELECT id, level, text FROM c WHERE level = 0 OR paper_id NOT IN (SELECT paper_id FROM n) UNION ALL SELECT id, 1, CAST(k AS VARCHAR) || ' passages' FROM n")
def summaries_put(spark, d):
    """SNK-02: the summaries of some papers replaced, leaves stay."""
    c = chunks(spark, d).select("id", "paper_id", "level", "text")
    new = c.filter("paper_id like '%6' and level = 0").groupBy("paper_id").agg(F.count("*").alias("k")).select(F.concat("paper_id", F.lit("s1")).alias("id"), "paper_id", F.lit(1).alias("level"), F.concat(F.col("k").cast("string"), F.lit(" passages")).alias("text"))
    return X.put_summaries(c, new).select("id", "level", "text")


@query("""WITH v AS (SELECT chunk_id, model, max(len(vec)) AS n FROM emb GROUP BY ALL) SELECT chunk_id, model, CASE WHEN chunk_id LIKE '%2' AND model = 'enc-mini' THEN 3 ELSE n END AS n FROM v UNION ALL SELECT chunk_id, 'enc-new', 3 FROM v WHERE chunk_id LIKE '%2' AND model = 'enc-mini'""")
def vectors_put(spark, d):
    """SNK-04: vectors replaced by passage and model, new models added."""
    v = table(spark, d, "emb").groupBy("chunk_id", "model").agg(F.max(F.size("vec")).alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))
    mini = v.filter("chunk_id like '%2' and model = 'enc-mini'").withColumn("n", F.lit(3))
    new = mini.unionByName(mini.withColumn("model", F.lit("enc-new"))).withColumn("k", F.concat_ws("|", "chunk_id", "model"))
    return C.replace_by_key(v.withColumn("k", F.concat_ws("|", "chunk_id", "model")), new, "k").select("chunk_id", "model", "n")


_FP = """f AS (SELECT survey_id, sha256(string_agg(x, '|' ORDER BY x)) AS fp FROM (SELECT survey_id, id || ':' || CAST(epoch_us(updated_at) AS VARCHAR) || ':' || coalesce(status, '') AS x FROM p) GROUP BY survey_id)"""
_ASKED = rf"""{PAPERS}, {_FP}, cur AS (SELECT survey_id, item_id, sha256(fp || '|' || lower(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')))) AS k FROM f JOIN eval_item ON item_id % 24 = CAST(substr(survey_id, 3) AS BIGINT) % 24)"""


@query(f"WITH {_ASKED} SELECT survey_id, item_id, CASE WHEN item_id % 3 <> 0 AND CAST(substr(survey_id, 3) AS BIGINT) % 2 = 0 THEN 'answer ' || CAST(item_id AS VARCHAR) END AS answer FROM cur")
def question_lookup(spark, d):
    """MEM-03, SNK-04: stored answers looked up by the corpus' present state and the question (an older state finds nothing)."""
    cur, stored = _questions(spark, d)
    return cur.join(stored, "k", "left").select("survey_id", "item_id", "answer")


def _questions(spark, d):
    f = C.fingerprint(papers(spark, d)).withColumn("b", F.substring("survey_id", 3, 10).cast("long"))
    e = table(spark, d, "eval_item")
    cur = f.withColumn("m", F.col("b") % 24).join(e.withColumn("m", F.col("item_id") % 24), "m").select("survey_id", "item_id", "b", M.question_key(F.col("fp"), F.col("text")).alias("k"), M.question_key(F.concat("fp", F.lit("old")), F.col("text")).alias("old"))
    stored = cur.filter("item_id % 3 <> 0").select(F.when(F.col("b") % 2 == 0, F.col("k")).otherwise(F.col("old")).alias("k"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"))
    return cur.select("survey_id", "item_id", "k"), stored


@query(f"WITH {PAPERS}, {_FP} SELECT survey_id, CAST(substr(survey_id, 3) AS BIGINT) % 3 = 0 AS stale FROM f WHERE survey_id IS NOT NULL")
def stale_syntheses(spark, d):
    """MEM-04: syntheses made under another state of the corpus (every third is)."""
    f = C.fingerprint(papers(spark, d)).filter("survey_id is not null")
    stored = f.select("survey_id", F.when(F.substring("survey_id", 3, 10).cast("long") % 3 == 0, F.concat("fp", F.lit("old"))).otherwise(F.col("fp")).alias("then"))
    return f.join(stored, "survey_id").select("survey_id", (F.col("fp") != F.col("then")).alias("stale"))


def _csv(c: str) -> str:
    return f"""'"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '"', '""') || '"'"""


@query(f"WITH {PAPERS} SELECT {_csv('id')} || ',' || {_csv('title')} || ',' || {_csv('year')} || ',' || {_csv('card.tldr_vi')} AS line FROM p UNION ALL SELECT chr(65279) || '\"id\",\"title\",\"year\",\"tldr\"'")
def matrix_csv(spark, d):
    """SNK-05: the facet table as CSV lines, the heading with the byte order mark that spreadsheets ask for."""
    p = papers(spark, d).select("id", "title", "year", F.col("card.tldr_vi").alias("tldr"))
    head = spark.range(1).select(F.lit('﻿"id","title","year","tldr"').alias("line"))
    return p.select(X.csv_rows(p, ["id", "title", "year", "tldr"]).alias("line")).unionByName(head)


@query(f"WITH {PAPERS} SELECT id, title, year, card.novelty AS novelty FROM p")
def matrix_json(spark, d):
    """SNK-05: the facet table as JSON, read back."""
    j = papers(spark, d).select(F.to_json(F.struct("id", "title", "year", F.col("card.novelty").alias("novelty"))).alias("j"))
    return j.select(F.from_json("j", "struct<id:string,title:string,year:int,novelty:string>").alias("r")).select("r.*")


@query(f"""WITH {PAPERS}, l AS (SELECT survey_id, year, '- **' || coalesce(title, '') || '**' || CASE WHEN coalesce(card.tldr_vi, '') <> '' THEN ' — ' || card.tldr_vi ELSE '' END || CASE WHEN coalesce(card.novelty, '') <> '' THEN chr(10) || '  > ' || card.novelty ELSE '' END AS line, id FROM p WHERE survey_id IS NOT NULL AND year IS NOT NULL),
y AS (SELECT survey_id, year, '## ' || CAST(year AS VARCHAR) || chr(10) || string_agg(line, chr(10) ORDER BY id) AS part FROM l GROUP BY survey_id, year)
SELECT y.survey_id, '# ' || any_value(coalesce(s.name, '')) || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY year) AS md FROM y JOIN survey s ON s.id = y.survey_id GROUP BY y.survey_id""")
def synthesis_markdown(spark, d):
    """SNK-07: a corpus' approaches (here by year) with their papers as Markdown."""
    some = lambda c, l: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(l), c)).otherwise("")
    p = papers(spark, d).filter("survey_id is not null and year is not null")
    line = F.concat(F.lit("- **"), F.coalesce("title", F.lit("")), F.lit("**"), some(F.col("card.tldr_vi"), " — "), some(F.col("card.novelty"), "\n  > "))
    y = p.groupBy("survey_id", "year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x.l), "\n").alias("body"))
    part = F.concat(F.lit("## "), F.col("year").cast("string"), F.lit("\n"), "body")
    g = y.groupBy("survey_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", part.alias("t")))), lambda x: x.t), "\n\n").alias("body"))
    s = table(spark, d, "survey").select(F.col("id").alias("survey_id"), "name")
    return g.join(s, "survey_id").select("survey_id", F.concat(F.lit("# "), F.coalesce("name", F.lit("")), F.lit("\n\n"), "body").alias("md"))


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {\"id\":' || CAST(event_id AS VARCHAR) || ',\"user\":' || CAST(user_id AS VARCHAR) || '}' || chr(10) || chr(10) AS frame FROM events")
def event_frames(spark, d):
    """SNK-09: progress as frames of an event stream."""
    e = table(spark, d, "events")
    return e.select("event_id", X.event_frame(F.col("event_type"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user")))).alias("frame"))


@query(f"SELECT id, coalesce(nullif(name, ''), 'Kho chưa đặt tên') AS name, coalesce(topic, '') AS topic, [{', '.join(repr(f) for f in X.FACETS)}] AS facets FROM survey UNION ALL SELECT id || 'n', upper(name), '', [{', '.join(repr(f) for f in X.FACETS)}] FROM survey WHERE id LIKE '%5'")
def corpora_put(spark, d):
    """SNK-10: corpora with their nine facets; new ones are added, stored ones replaced by key."""
    facets = F.array(*map(F.lit, X.FACETS)).alias("facets")
    s = table(spark, d, "survey").select("id", F.coalesce(F.nullif("name", F.lit("")), F.lit("Kho chưa đặt tên")).alias("name"), F.coalesce("topic", F.lit("")).alias("topic"), facets)
    new = s.filter("id like '%5'").select(F.concat("id", F.lit("n")).alias("id"), F.upper("name").alias("name"), F.lit("").alias("topic"), "facets")
    return C.replace_by_key(s, new, "id")


@query(f"WITH {BLOCKS}, s AS (SELECT doc, id FROM bl WHERE type IN ('caption', 'equation') AND regexp_full_match(id, '[A-Za-z0-9]+')) SELECT doc || 'new' AS doc, id FROM s WHERE NOT (id LIKE '%5') UNION ALL SELECT doc || 'new', id FROM s WHERE id LIKE '%5'")
def pictures_copied(spark, d):
    """SNK-11: pictures of a stored document taken over by block id; those cut anew (ids that end in 5) are skipped and stay."""
    s = blocks(spark, d).filter(F.col("type").isin("caption", "equation") & F.col("id").rlike("^[A-Za-z0-9]+$")).select(F.concat("doc", F.lit("new")).alias("doc"), "id")
    own = s.filter("id like '%5'")
    return s.join(own, ["doc", "id"], "left_anti").unionByName(own)


@query(f"WITH {PAPERS}, {CHUNKS} SELECT c.id, c.level FROM c JOIN p ON p.id = c.paper_id WHERE p.survey_id = 'sv003' AND c.level = 0")
def corpus_scope(spark, d):
    """FLT-02, FLT-03: leaves of one corpus."""
    return C.in_corpus(chunks(spark, d, 0), papers(spark, d), "sv003").select("id", "level")


@query(f"""WITH {PAPERS} SELECT id, CASE WHEN id LIKE '%1' THEN 'T ' || id ELSE title END AS title, CASE WHEN id LIKE '%2' THEN NULL ELSE venue END AS venue, doi FROM p""")
def paper_patch(spark, d):
    """FLT-06: a patch reaches allowed fields only (the identifier is none of them)."""
    p = papers(spark, d).select("id", "title", "venue", "doi")
    at = lambda end, field, v, no: p.filter(F.col("id").endswith(end)).select("id", F.lit(no).alias("no"), F.lit(field).alias("field"), v.alias("value"))
    patch = at("1", "title", F.lit("earlier"), 1).unionByName(at("1", "title", F.concat(F.lit("T "), F.col("id")), 2)).unionByName(at("2", "venue", F.lit(None).cast("string"), 1)).unionByName(at("3", "doi", F.lit("changed"), 1))
    return X.whitelisted(p, patch, "id", ["title", "venue"])


@query(f"""WITH {PAPERS}, {CHUNKS}, q AS (SELECT id AS paper_id, CASE WHEN id LIKE '%4' THEN 'sv000' ELSE survey_id END AS asked FROM p UNION ALL SELECT 'nobody', 'sv000') SELECT q.paper_id, q.asked, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.survey_id IS DISTINCT FROM q.asked THEN 'elsewhere' ELSE 'ok' END AS state FROM q LEFT JOIN p ON p.id = q.paper_id""")
def paper_needed(spark, d):
    """FLT-09: a paper must exist and belong to the corpus that is asked."""
    p = papers(spark, d).select("id", "survey_id")
    q = p.select(F.col("id").alias("paper_id"), F.when(F.col("id").endswith("4"), F.lit("sv000")).otherwise(F.col("survey_id")).alias("asked")).unionByName(spark.createDataFrame([("nobody", "sv000")], "paper_id string, asked string"))
    return q.join(p, q.paper_id == p.id, "left").select("paper_id", "asked", F.when(F.col("id").isNull(), "missing").when(~F.col("survey_id").eqNullSafe(F.col("asked")), "elsewhere").otherwise("ok").alias("state"))


@query(f"""WITH {PAPERS}, {CHUNKS}, a AS (SELECT paper_id, min(trim(text)) AS abstract FROM c WHERE kind = 'abstract' AND trim(coalesce(text, '')) <> '' GROUP BY paper_id)
SELECT p.id, 'abstract_only' AS status, sha256(coalesce(nullif(doi, ''), nullif(url, ''), title, '')) AS sha, p.id || 'c1' AS chunk_id, a.abstract FROM p JOIN a ON a.paper_id = p.id WHERE p.sha256 IS NULL""")
def abstracts_kept(spark, d):
    """FLT-10: works without a file are kept by their abstract and marked; without one they are not."""
    a = chunks(spark, d).filter("kind = 'abstract' and trim(coalesce(text, '')) <> ''").groupBy("paper_id").agg(F.min(F.trim("text")).alias("abstract"))
    p = papers(spark, d).filter("sha256 is null").join(a, F.col("id") == F.col("paper_id"))
    key = F.coalesce(F.nullif("doi", F.lit("")), F.nullif("url", F.lit("")), F.col("title"), F.lit(""))
    return p.select("id", F.lit("abstract_only").alias("status"), F.sha2(key, 256).alias("sha"), F.concat("id", F.lit("c1")).alias("chunk_id"), "abstract")


@query("""WITH x AS (SELECT item_id, trim(text) AS q, string_split(trim(answer), ' ') AS w FROM eval_item) SELECT item_id AS id, CASE WHEN item_id % 4 = 0 THEN 1 ELSE least(7, 5) END AS n_subs, least(8, CASE WHEN item_id % 3 = 0 THEN 9 ELSE 10 END) AS n_queries, CASE WHEN item_id % 3 = 0 AND item_id % 5 <> 0 THEN 'query 1' ELSE q END AS first_query, CASE WHEN item_id % 5 = 0 THEN 0 ELSE 12 END AS n_terms
FROM (SELECT * FROM x WHERE item_id % 5 <> 0) UNION ALL SELECT item_id, 1, 1, trim(text), 0 FROM eval_item WHERE item_id % 5 = 0""")
def plans_cleaned(spark, d):
    """FLT-14: plans put into shape: empty questions out, the question itself among the queries, caps; broken JSON is an empty plan."""
    e = table(spark, d, "eval_item").select("item_id", F.trim("text").alias("q"))
    i = F.col("item_id")
    subs = F.when(i % 4 == 0, F.array(F.struct(F.lit("").alias("id"), F.lit("  ").alias("ask"), F.lit("").alias("need")))).otherwise(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.struct(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.concat(F.lit("ask "), k.cast("string")).alias("ask"), F.lit("").alias("need"))))
    other = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.struct(F.concat(F.lit("query "), k.cast("string")).alias("q"), F.lit("q1").alias("for")))
    queries = F.when(i % 3 == 0, F.concat(F.slice(other, 1, 1), F.array(F.struct(F.upper("q").alias("q"), F.lit("q1").alias("for"))), F.slice(other, 2, 7))).otherwise(other)
    terms = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda k: F.concat(F.lit("t"), k.cast("string")))
    j = F.when(i % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(subs.alias("sub_questions"), queries.alias("queries"), terms.alias("must_terms_en"))))
    c = X.clean_plan(e.select("item_id", "q", j.alias("j")), "item_id", "q", "j")
    return c.select("id", F.size("subs").alias("n_subs"), F.size("queries").alias("n_queries"), F.element_at("queries", 1).alias("first_query"), F.size("terms").alias("n_terms"))


@query("""SELECT item_id AS id, 10 + len(list_filter(string_split(trim(answer), ' '), lambda w: w <> '')) AS n FROM eval_item WHERE answer IS NOT NULL""")
def used_terms(spark, d):
    """RNK-10: what a round has asked already: its queries and its terms, as the next must bring others."""
    e = table(spark, d, "eval_item").filter("answer is not null")
    queries = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat(F.lit("query "), k.cast("string")))
    terms = F.filter(F.split(F.trim("answer"), " "), lambda w: w != "")
    return e.select(F.col("item_id").alias("id"), F.size(F.concat(queries, terms)).cast("long").alias("n"))


@query(f"""WITH {BLOCKS}, f AS (SELECT *, CASE WHEN type IN ('caption', 'equation', 'figure') OR pos % 9 = 0 THEN id END AS fig FROM bl) SELECT doc, fig AS id, page, CASE WHEN pos % 2 = 0 THEN 'bản dịch ' || id ELSE coalesce(text, '') END AS caption FROM f WHERE fig IS NOT NULL AND type <> 'equation' AND regexp_full_match(fig, '[A-Za-z0-9]+')""")
def figure_catalogue(spark, d):
    """FLT-15: pictures that can be shown, formulas left out, with their captions, translated where there is a translation."""
    b = blocks(spark, d)
    fig = F.when(F.col("type").isin("caption", "equation", "figure") | (F.col("pos") % 9 == 0), F.col("id"))
    tr = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("bản dịch "), "id"))
    return b.withColumn("fig", fig).filter(F.col("fig").isNotNull() & (F.col("type") != "equation") & F.col("fig").rlike("^[A-Za-z0-9]+$")).select("doc", F.col("fig").alias("id"), "page", F.coalesce(tr, "text", F.lit("")).alias("caption"))


@query("""WITH m AS (SELECT id, CASE WHEN id LIKE '%1' THEN 'lab/fast-1' WHEN id LIKE '%2' THEN '' WHEN id LIKE '%3' THEN 'no such model' END AS own FROM survey) SELECT id, coalesce(nullif(own, ''), 'lab/default') AS model, regexp_matches(coalesce(nullif(own, ''), 'lab/default'), '^[A-Za-z0-9._-]+/[A-Za-z0-9._:-]+$') AS ok FROM m""")
def models_of(spark, d):
    """FLT-16: the model of a corpus, else the default; whether it looks like one."""
    i = F.col("id")
    own = F.when(i.endswith("1"), "lab/fast-1").when(i.endswith("2"), "").when(i.endswith("3"), "no such model")
    model = F.coalesce(F.nullif(own, F.lit("")), F.lit("lab/default"))
    return table(spark, d, "survey").select("id", model.alias("model"), model.rlike(r"^[A-Za-z0-9._-]+/[A-Za-z0-9._:-]+$").alias("ok"))


@query("""SELECT doc_id, left(CASE WHEN doc_id % 3 = 0 THEN '%PDF-1.7 ' ELSE '' END || coalesce(text, ''), 5) = '%PDF-' OR suffix(lower(coalesce(title, '') || CASE WHEN doc_id % 4 = 0 THEN '.PDF' ELSE '' END), '.pdf') AS taken FROM documents""")
def upload_gate(spark, d):
    """FLT-17: files are taken by their first bytes or their name."""
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("%PDF-1.7 ")).otherwise(""), F.coalesce("text", F.lit("")))
    name = F.concat(F.coalesce("title", F.lit("")), F.when(F.col("doc_id") % 4 == 0, F.lit(".PDF")).otherwise(""))
    return table(spark, d, "documents").select("doc_id", ((F.left(t, F.lit(5)) == "%PDF-") | F.lower(name).endswith(".pdf")).alias("taken"))


_LINE_NORM = _WS.format("x")


@query(rf"""WITH {CHUNKS}, ln AS (SELECT id, paper_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS i, unnest(string_split(text, chr(10))) AS x FROM c WHERE text IS NOT NULL), n AS (SELECT *, {_LINE_NORM} AS k FROM ln),
b AS (SELECT paper_id, k, max('dịch: ' || k) AS vi FROM n WHERE k <> '' AND length(k) % 3 <> 0 GROUP BY ALL) SELECT n.id, string_agg(b.vi, chr(10) ORDER BY n.i) AS vi FROM n JOIN b ON b.paper_id = n.paper_id AND b.k = n.k GROUP BY n.id""")
def translations_attached(spark, d):
    """JOIN-09: translations of blocks put to the passages that hold them, line by line, by normalised text."""
    c = chunks(spark, d)
    line = c.filter("text is not null").select("paper_id", F.explode(F.split("text", "\n")).alias("x")).withColumn("k", T.collapse(F.col("x"))).filter("k <> '' and length(k) % 3 <> 0")
    return X.translations_of(c, line.select("paper_id", F.concat(F.lit("  "), "k", F.lit("\n ")).alias("text"), F.concat(F.lit("dịch: "), "k").alias("vi")))


@query(rf"""WITH {PAPERS}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\. ([^.\n]+)\. [^.\n]+, (?:19|20)[0-9]{{2}}\.', 1)) AS t FROM documents), k AS (SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM p WHERE title IS NOT NULL)
SELECT DISTINCT r.doc_id, k.id FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM r UNION ALL SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) FROM documents) r JOIN k ON k.t = r.t WHERE k.t <> ''""")
def references_in_corpus(spark, d):
    """JOIN-14: works that documents are or cite, found in the corpora by normalised title."""
    docs = table(spark, d, "documents")
    pat = F.lit(r"\. ([^.\n]+)\. [^.\n]+, (?:19|20)[0-9]{2}\.")
    cited = docs.filter("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", pat, F.lit(1))).alias("t"))
    r = cited.unionByName(docs.select("doc_id", F.col("title").alias("t"))).select("doc_id", T.norm_title(F.col("t")).alias("t")).filter("t <> ''").distinct()
    k = papers(spark, d).filter("title is not null").select("id", T.norm_title(F.col("title")).alias("t"))
    return r.join(k, "t").select("doc_id", "id").distinct()


@query("""SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS lines, CASE WHEN translations IS NULL THEN 0 ELSE len(json_keys(translations)) END AS translated FROM documents""")
def translated_counts(spark, d):
    """AGG-04: translated blocks of each document."""
    m = F.from_json("translations", "map<string,string>")
    return table(spark, d, "documents").select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"), F.when(F.col("translations").isNull(), 0).otherwise(F.size(F.map_keys(m))).alias("translated"))


_SECT = f"""{BLOCKS}, sc AS (SELECT *, sum(CASE WHEN type = 'heading' AND coalesce(level, 1) <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS sec FROM bl)"""


@query(f"""WITH {_SECT} SELECT doc, sec, CASE WHEN sec = 0 THEN '(mở đầu)' ELSE max(CASE WHEN type = 'heading' THEN text END) END AS name, count(*) FILTER (WHERE translate) AS blocks, count(*) FILTER (WHERE translate AND pos % 3 = 0) AS done, coalesce(sum(length(text)) FILTER (WHERE translate AND pos % 3 <> 0), 0) AS left_chars FROM sc GROUP BY doc, sec""")
def sections_done(spark, d):
    """AGG-06: blocks of each section, how many are done and how many characters are left; what stands first is a section by itself."""
    s = blocks(spark, d).withColumn("sec", F.sum(F.when((F.col("type") == "heading") & (F.coalesce("level", F.lit(1)) <= 1), 1).otherwise(0)).over(Window.partitionBy("doc").orderBy("pos")))
    todo = F.col("translate") & (F.col("pos") % 3 != 0)
    return s.groupBy("doc", "sec").agg(F.when(F.col("sec") == 0, "(mở đầu)").otherwise(F.max(F.when(F.col("type") == "heading", F.col("text")))).alias("name"), F.count_if("translate").alias("blocks"), F.count_if(F.col("translate") & (F.col("pos") % 3 == 0)).alias("done"), F.coalesce(F.sum(F.when(todo, F.length("text"))), F.lit(0)).alias("left_chars"))


@query(f"""WITH {_SECT}, g AS (SELECT doc, sec, count(*) FILTER (WHERE translate) AS n, count(*) FILTER (WHERE translate AND pos % 3 <> 0) AS todo, sum(length(text)) AS chars FROM sc GROUP BY doc, sec)
SELECT doc, sum(todo) AS todo, round(sum(chars * (todo / greatest(n, 1))), 4) AS share FROM g WHERE sec % 2 = 0 GROUP BY doc""")
def sections_picked(spark, d):
    """AGG-24: untranslated blocks of the picked sections (every other one) and their pro-rated size."""
    s = blocks(spark, d).withColumn("sec", F.sum(F.when((F.col("type") == "heading") & (F.coalesce("level", F.lit(1)) <= 1), 1).otherwise(0)).over(Window.partitionBy("doc").orderBy("pos")))
    g = s.groupBy("doc", "sec").agg(F.count_if("translate").alias("n"), F.count_if(F.col("translate") & (F.col("pos") % 3 != 0)).alias("todo"), F.sum(F.length("text")).alias("chars"))
    return g.filter("sec % 2 = 0").groupBy("doc").agg(F.sum("todo").alias("todo"), F.round(F.sum(F.col("chars") * (F.col("todo") / F.greatest("n", F.lit(1)))), 4).alias("share"))


@query(f"""WITH {BLOCKS}, g AS (SELECT doc, count(*) AS blocks, count(*) FILTER (WHERE translate) AS todo, coalesce(sum(length(text)) FILTER (WHERE translate), 0) AS src, sum(length(text)) AS whole FROM bl GROUP BY doc), h AS (SELECT *, greatest(1, CAST(ceil(src / 12000.0) AS INTEGER)) AS batches FROM g)
SELECT doc, blocks, todo, src AS source_chars, batches, CAST(round(whole / 3.6 * batches + src / 3.6) AS BIGINT) AS prompt_tokens, CAST(round(src / 3.6 * 1.25 * 2.15 + 3000) AS BIGINT) AS output_tokens FROM h""")
def work_estimate(spark, d):
    """AGG-07: how much there is to do and how many tokens it takes (no prices); batches are counted by size here, batch_plan cuts them."""
    g = blocks(spark, d).groupBy("doc").agg(F.count("*").alias("blocks"), F.count_if("translate").alias("todo"), F.coalesce(F.sum(F.when(F.col("translate"), F.length("text"))), F.lit(0)).alias("source_chars"), F.sum(F.length("text")).alias("whole"))
    n = F.greatest(F.lit(1), F.ceil(F.col("source_chars") / 12000.0).cast("int"))
    g = g.withColumn("batches", n)
    return g.select("doc", "blocks", "todo", "source_chars", "batches", F.round(F.col("whole") / 3.6 * F.col("batches") + F.col("source_chars") / 3.6).cast("long").alias("prompt_tokens"), F.round(F.col("source_chars") / 3.6 * 1.25 * 2.15 + 3000).cast("long").alias("output_tokens"))


@query(f"""WITH {PAPERS}, {CHUNKS}, gone AS (SELECT id FROM p WHERE survey_id = 'sv004') SELECT (SELECT count(*) FROM survey WHERE id <> 'sv004') AS surveys, (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM gone)) AS papers, (SELECT count(*) FROM c WHERE paper_id NOT IN (SELECT id FROM gone)) AS chunks""")
def corpus_deleted(spark, d):
    """MUT-03: a corpus goes with its papers and passages."""
    p = papers(spark, d)
    gone = p.filter("survey_id = 'sv004'").select(F.col("id").alias("paper_id"))
    one = [x.agg(F.count("*").alias(n)).withColumn("_1", F.lit(1)) for x, n in ((table(spark, d, "survey").filter("id <> 'sv004'"), "surveys"), (p.join(gone, p.id == gone.paper_id, "left_anti"), "papers"), (chunks(spark, d).join(gone, "paper_id", "left_anti"), "chunks"))]
    return one[0].join(one[1], "_1").join(one[2], "_1").drop("_1")


@query(f"""WITH {PAPERS}, {CHUNKS}, n AS (SELECT id AS paper_id, 'Renamed ' || id AS title FROM p WHERE id LIKE '%8') SELECT c.id, coalesce(n.title, c.title) AS title FROM c LEFT JOIN n ON n.paper_id = c.paper_id""")
def title_propagated(spark, d):
    """MUT-04: a paper's new title reaches its passages (their index terms follow, as the index is built from them)."""
    n = papers(spark, d).filter("id like '%8'").select(F.col("id").alias("paper_id"), F.concat(F.lit("Renamed "), "id").alias("new"))
    return chunks(spark, d).join(n, "paper_id", "left").select("id", F.coalesce("new", "title").alias("title"))


@query(f"""WITH {BLOCKS}, ch AS (SELECT DISTINCT doc, id FROM bl WHERE pos % 6 = 1), o AS (SELECT doc, pos, id, list_filter([lag(id) OVER w, id, lead(id) OVER w], lambda x: x IS NOT NULL) AS rests FROM bl WINDOW w AS (PARTITION BY doc ORDER BY pos)) SELECT o.doc, o.id FROM o LEFT JOIN (SELECT doc, list(id) AS ids FROM ch GROUP BY doc) h ON h.doc = o.doc WHERE NOT list_has_any(o.rests, coalesce(h.ids, []))""")
def notes_kept(spark, d):
    """MUT-08: notes that rest on edited blocks are forgotten; these stay."""
    b = blocks(spark, d)
    w = Window.partitionBy("doc").orderBy("pos")
    o = b.select("doc", "id", F.array_compact(F.array(F.lag("id").over(w), F.col("id"), F.lead("id").over(w))).alias("rests"))
    ch = b.filter("pos % 6 = 1").groupBy("doc").agg(F.collect_set("id").alias("ids"))
    return o.join(ch, "doc", "left").filter(F.col("ids").isNull() | ~F.arrays_overlap("rests", "ids")).select("doc", "id")


@query(f"""WITH {MEMO} SELECT key, CASE WHEN key LIKE '%1|%' THEN 'sửa ' || coalesce(vi, '') ELSE vi END AS vi, plain FROM t""")
def translation_edited(spark, d):
    """MUT-09: an edited translation is written to the memory, too; what was not edited stays."""
    t = memo(spark, d).select("key", "vi", "plain", "hits")
    new = t.filter("key like '%1|%'").select("key", F.concat(F.lit("sửa "), F.coalesce("vi", F.lit(""))).alias("vi"), F.lit("").alias("plain"))
    return C.keep_old_if_empty(t, new, "key", ["vi", "plain"])


_MARKS = f"""{BLOCKS}, mk AS (SELECT doc, id AS block, 'h' || CAST(pos + 1 AS VARCHAR) AS id, CASE pos % 3 WHEN 0 THEN 'vi' WHEN 1 THEN 'en' ELSE 'gl' END AS col, pos % 5 AS start, pos % 5 + 4 AS "end", '' AS note, pos FROM bl WHERE pos % 2 = 0),
top AS (SELECT doc, max(TRY_CAST(substr(id, 2) AS INTEGER)) AS t FROM mk GROUP BY doc), ad AS (SELECT bl.doc, bl.id AS block, 'h' || CAST(coalesce(t, 0) + row_number() OVER (PARTITION BY bl.doc ORDER BY pos) AS VARCHAR) AS id, CASE WHEN pos % 4 = 3 THEN 'vi' ELSE 'en' END AS col, 1 AS start, 3 AS "end", 'new' AS note FROM bl LEFT JOIN top ON top.doc = bl.doc WHERE pos % 4 IN (1, 3) AND pos % 8 <> 7)"""


@query(f"""WITH {_MARKS}, k AS (SELECT doc, block, id, col, start, "end", CASE WHEN pos % 6 = 4 THEN 'seen' ELSE note END AS note FROM mk WHERE pos % 6 <> 2), a AS (SELECT * FROM k UNION ALL SELECT doc, block, id, col, start, "end", note FROM ad)
SELECT doc, block, id, col, start, "end" AS stop, note, row_number() OVER (PARTITION BY doc, block ORDER BY col, start, id) AS place FROM a""")
def highlights_edited(spark, d):
    """MUT-10, SORT-05: marks added, noted and dropped, in the order of column and start; empty ranges are refused."""
    b = blocks(spark, d)
    pos = F.col("pos")
    col = F.when(pos % 3 == 0, "vi").when(pos % 3 == 1, "en").otherwise("gl")
    marks = b.filter("pos % 2 = 0").select("doc", F.col("id").alias("block"), F.concat(F.lit("h"), (pos + 1).cast("string")).alias("id"), col.alias("col"), (pos % 5).alias("start"), (pos % 5 + 4).alias("end"), F.lit("").alias("note"), "pos")
    add = b.filter("pos % 4 in (1, 3)").select("doc", pos.alias("no"), F.lit("add").alias("action"), F.lit(None).cast("string").alias("id"), F.col("id").alias("block"), F.when(pos % 4 == 3, "??").otherwise("en").alias("col"), F.lit(1).alias("start"), F.when(pos % 8 == 7, 1).otherwise(3).alias("end"), F.lit("new").alias("note"))
    up = marks.filter("pos % 6 = 4").select("doc", pos.alias("no"), F.lit("update").alias("action"), "id", "block", "col", "start", "end", F.lit("seen").alias("note"))
    drop = marks.filter("pos % 6 = 2").select("doc", pos.alias("no"), F.lit("drop").alias("action"), "id", "block", "col", "start", "end", "note")
    out = X.highlights_after(marks.drop("pos"), add.unionByName(up).unionByName(drop))
    return out.withColumnRenamed("end", "stop")


@query(f"""WITH {BLOCKS}, j AS (SELECT doc, id, CASE WHEN pos % 7 = 2 THEN pos + 2 - 0.5 ELSE pos END AS ps, CASE WHEN pos % 5 = 1 THEN [0, 1] ELSE [0] END AS k FROM bl WHERE type = 'para' AND pos % 9 <> 4), x AS (SELECT doc, id, ps, unnest(k) AS k FROM j)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ps, id, k) AS place, CASE WHEN k = 1 THEN id || 'x' ELSE id END AS id FROM x""")
def slides_edited(spark, d):
    """MUT-11, DOC-31: slides dropped, doubled and moved, renumbered."""
    k = blocks(spark, d).filter("type = 'para'").select("doc", "pos", "id")
    at = lambda cond, action, to: k.filter(cond).select("doc", "id", F.lit(action).alias("action"), to.cast("int").alias("to"))
    e = at("pos % 9 = 4", "drop", F.lit(None)).unionByName(at("pos % 5 = 1", "duplicate", F.lit(None))).unionByName(at("pos % 7 = 2", "move", F.col("pos") + 2))
    return X.slides_after(k, e)


@query("""SELECT sha256, arg_max(title, created_at) AS title, max(created_at) AS created_at, arg_max(layout_model, created_at) AS layout_model FROM (SELECT sha256, coalesce(title, '') AS title, created_at, layout_model FROM parse_cache) GROUP BY sha256""")
def newest_parse_row(spark, d):
    """SRC-16, MEM-01: the newest stored parse of each file, the whole row."""
    c = table(spark, d, "parse_cache").select("sha256", F.coalesce("title", F.lit("")).alias("title"), "created_at", "layout_model")
    return c.groupBy("sha256").agg(F.max_by(F.struct("title", "created_at", "layout_model"), "created_at").alias("r")).select("sha256", "r.*")
