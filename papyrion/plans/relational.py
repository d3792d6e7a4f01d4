"""Text functions and the relational core over the corpus tables; keys carry the operator ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.functions import text as T
from papyrion.operators import corpus as C
from papyrion.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Current papers and distinct passages, as the queries below see them.
PAPERS = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, n_pages DESC, title) AS rn FROM (SELECT DISTINCT * FROM paper)) WHERE rn = 1)"
CHUNKS = "c AS (SELECT DISTINCT * FROM chunk)"
MEMO = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, hits DESC) AS rn FROM tm) WHERE rn = 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def papers(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(table(spark, d, "paper"), "id", "updated_at")


def chunks(spark: SparkSession, d: str, level: int | None = None) -> DataFrame:
    return C.leaves(table(spark, d, "chunk"), level)


def memo(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(table(spark, d, "tm"), "key", "created_at")


@query(r"SELECT DISTINCT id, sha256(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS h FROM chunk WHERE text IS NOT NULL")
def text_norm_hash(spark, d):
    """2.9 norm, sha: content hash of the collapsed text."""
    return table(spark, d, "chunk").filter("text is not null").select("id", T.sha(T.collapse(F.col("text"))).alias("h")).distinct()


@query(r"""SELECT DISTINCT model, sha256(trim(regexp_replace(src, '[ \t\n\r\f]+', ' ', 'g'))) || '|' || model AS k FROM tm WHERE src IS NOT NULL AND model IS NOT NULL""")
def memo_keys(spark, d):
    """2.9 tm_key: key of a source text and a model."""
    return table(spark, d, "tm").filter("src is not null and model is not null").select("model", T.memo_key(F.col("src"), F.col("model")).alias("k")).distinct()


@query(r"""SELECT DISTINCT id, left(trim(regexp_replace(regexp_replace(lower(coalesce(authors, '')), '[^a-z0-9À-ỹ ]+', ' ', 'g'), ' +', ' ', 'g')), 80) AS name FROM paper""")
def name_norm(spark, d):
    """2.9 norm_name over author lists."""
    return table(spark, d, "paper").select("id", T.norm_name(F.col("authors")).alias("name")).distinct()


@query(r"""SELECT DISTINCT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM documents""")
def title_norm(spark, d):
    """2.9 title key of bibliographic rows."""
    return table(spark, d, "documents").select("doc_id", T.norm_title(F.col("title")).alias("t")).distinct()


@query(r"""SELECT doc_id, length(t) >= 16 AND len(string_split(t, ' ')) >= 3 AS usable FROM (SELECT doc_id, trim(regexp_replace(coalesce(title, ''), '[ \t\n\r\f]+', ' ', 'g')) AS t FROM documents)""")
def usable_titles(spark, d):
    """FLT-12."""
    return table(spark, d, "documents").select("doc_id", T.usable_title(F.col("title")).alias("usable"))


@query(r"""SELECT DISTINCT id, regexp_replace(text, '\*\*([^*]+)\*\*|`([^`]+)`|\*([^*\s][^*]*)\*', '\1\2\3', 'g') AS plain FROM chunk WHERE text IS NOT NULL""")
def strip_markup(spark, d):
    """2.9 strip_md: marks go, the text inside stays."""
    return table(spark, d, "chunk").filter("text is not null").select("id", T.strip_markup(F.col("text")).alias("plain")).distinct()


@query(r"""WITH n AS (SELECT DISTINCT id, unnest(regexp_extract_all(regexp_replace(text, '[^0-9A-Za-zÀ-ỹ_.,%+-]+', ' ', 'g'), '[^ ]+')) AS tok FROM chunk WHERE text IS NOT NULL),
m AS (SELECT id, regexp_replace(regexp_replace(tok, '[.,%]+$', ''), '^[%+-]+', '') AS tok FROM n)
SELECT id, count(*) AS n FROM (SELECT DISTINCT id, tok FROM m WHERE regexp_full_match(tok, '[0-9]+([.,][0-9]+)*')) GROUP BY id""")
def number_extract(spark, d):
    """2.9 numbers of a passage of any kind: tokens of a superset class, then an anchored filter (no look-around needed)."""
    c = table(spark, d, "chunk").filter("text is not null").select("id", "text").distinct()
    tok = F.explode(F.regexp_extract_all(F.regexp_replace("text", "[^0-9A-Za-zÀ-ỹ_.,%+-]+", " "), F.lit("[^ ]+"), F.lit(0)))
    t = c.select("id", tok.alias("tok")).withColumn("tok", F.regexp_replace(F.regexp_replace("tok", "[.,%]+$", ""), "^[%+-]+", ""))
    return t.filter(F.col("tok").rlike(r"^[0-9]+([.,][0-9]+)*$")).distinct().groupBy("id").agg(F.count("*").alias("n"))


@query(r"""SELECT DISTINCT doc_id, regexp_extract(text, '10\.[0-9]{4,5}/[a-z]+\.[0-9]+', 0) AS doi FROM documents WHERE text IS NOT NULL""")
def identifier_extract(spark, d):
    """SRC-05 identifiers by pattern."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.regexp_extract("text", r"10\.[0-9]{4,5}/[a-z]+\.[0-9]+", 0).alias("doi")).distinct()


@query(f"""WITH {PAPERS}, {CHUNKS} SELECT s.id AS survey_id, count(DISTINCT p.id) AS papers, count(DISTINCT CASE WHEN p.status IN ('indexed', 'carded') THEN p.id END) AS indexed,
count(DISTINCT CASE WHEN p.card IS NOT NULL THEN p.id END) AS carded, count(DISTINCT c.id) AS chunks
FROM survey s LEFT JOIN p ON p.survey_id = s.id LEFT JOIN c ON c.paper_id = p.id GROUP BY s.id""")
def corpus_stats(spark, d):
    """AGG-02, AGG-03: counts of every corpus; chunks are counted per paper before they meet the corpus."""
    p = papers(spark, d)
    n = chunks(spark, d).groupBy("paper_id").agg(F.count("*").alias("chunks"))
    per = p.join(n, p.id == n.paper_id, "left").groupBy("survey_id").agg(
        F.count("*").alias("papers"), F.count_if(F.col("status").isin("indexed", "carded")).alias("indexed"), F.count_if(F.col("card").isNotNull()).alias("carded"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks")
    )
    s = table(spark, d, "survey").select(F.col("id").alias("survey_id"))
    return s.join(per, "survey_id", "left").na.fill(0)


@query(f"WITH {MEMO} SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(DISTINCT sha256) FROM parse_cache) AS cached, (SELECT count(*) FROM t) AS entries, (SELECT coalesce(sum(hits), 0) FROM t) AS hits")
def store_stats(spark, d):
    """AGG-01: one-row totals of the store."""
    docs = table(spark, d, "documents").agg(F.count("*").alias("docs"))
    cached = table(spark, d, "parse_cache").agg(F.count_distinct("sha256").alias("cached"))
    t = memo(spark, d).agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    one = [x.withColumn("_1", F.lit(1)) for x in (docs, cached, t)]
    return one[0].join(one[1], "_1").join(one[2], "_1").drop("_1")


@query(f"WITH {CHUNKS} SELECT c.id AS chunk_id FROM c WHERE c.level = 0 AND NOT EXISTS (SELECT 1 FROM emb e WHERE e.chunk_id = c.id AND e.model = 'enc-base')")
def missing_vectors_anti(spark, d):
    """JOIN-04: left anti on passage and model."""
    return C.missing_vectors(chunks(spark, d, 0), table(spark, d, "emb"), "enc-base").select(F.col("id").alias("chunk_id"))


@query(f"WITH {PAPERS}, {CHUNKS} SELECT c.id AS chunk_id, p.survey_id, p.title AS paper_title, p.year FROM c JOIN p ON p.id = c.paper_id WHERE c.level = 0")
def chunk_paper_join(spark, d):
    """JOIN-01, JOIN-02 metadata of passages."""
    p = papers(spark, d).select(F.col("id").alias("paper_id"), "survey_id", F.col("title").alias("paper_title"), "year")
    return chunks(spark, d, 0).join(p, "paper_id").select(F.col("id").alias("chunk_id"), "survey_id", "paper_title", "year")


@query(f"WITH {PAPERS}, {CHUNKS} SELECT e.chunk_id, c.paper_id, p.survey_id FROM (SELECT DISTINCT chunk_id, model FROM emb) e JOIN c ON c.id = e.chunk_id JOIN p ON p.id = c.paper_id WHERE e.model = 'enc-mini'")
def vectors_of_model(spark, d):
    """JOIN-03: vectors of one model with their passages and papers."""
    e = table(spark, d, "emb").filter("model = 'enc-mini'").select(F.col("chunk_id").alias("id")).distinct()
    p = papers(spark, d).select(F.col("id").alias("paper_id"), "survey_id")
    return e.join(chunks(spark, d), "id").join(p, "paper_id").select(F.col("id").alias("chunk_id"), "paper_id", "survey_id")


@query(f"""WITH {PAPERS}, f AS (SELECT survey_id, id, sha256 FROM p UNION ALL SELECT survey_id, id || 'b', sha256 FROM p WHERE id LIKE '%9' OR id LIKE '%4')
SELECT survey_id, sha256, min(id) AS first_id, count(*) AS n FROM f WHERE sha256 IS NOT NULL GROUP BY survey_id, sha256 HAVING count(*) > 1""")
def dup_by_sha(spark, d):
    """REL-31: the same file under several papers of a corpus (some are put in again here under a new id)."""
    p = papers(spark, d).select("survey_id", "id", "sha256")
    f = p.unionByName(p.filter("id like '%9' or id like '%4'").withColumn("id", F.concat("id", F.lit("b"))))
    return f.filter("sha256 is not null").groupBy("survey_id", "sha256").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


@query(r"""WITH w AS (SELECT DISTINCT sha256(trim(regexp_replace(src, '[ \t\n\r\f]+', ' ', 'g'))) || '|' || 'lingua-mini' AS key FROM tm WHERE src IS NOT NULL),
m AS (SELECT DISTINCT sha256(trim(regexp_replace(src, '[ \t\n\r\f]+', ' ', 'g'))) || '|' || model AS key, vi FROM tm WHERE src IS NOT NULL AND vi IS NOT NULL AND vi <> '')
SELECT w.key, EXISTS (SELECT 1 FROM m WHERE m.key = w.key) AS reused FROM w""")
def tm_lookup_split(spark, d):
    """MEM-02: which texts the memory already holds for a model, and which are to do."""
    t = table(spark, d, "tm").filter("src is not null")
    have = t.filter("vi is not null and vi <> ''").select(T.memo_key(F.col("src"), F.col("model")).alias("key"), "vi").dropDuplicates(["key"])
    return C.memo_split(t.select("src", F.lit("lingua-mini").alias("model")), have).select("key", "reused")


@query(f"""WITH {MEMO}, o AS (SELECT * FROM t WHERE model <> 'verbo-2'), x AS (SELECT src, min(key) AS k FROM o GROUP BY src),
n AS (SELECT x.k AS key, coalesce(max(t.vi), '') AS vi, max(t.plain) AS plain, sum(coalesce(t.hits, 0)) AS hits FROM t JOIN x ON x.src = t.src WHERE t.model = 'verbo-2' GROUP BY x.k)
SELECT coalesce(o.key, n.key) AS key, coalesce(nullif(n.vi, ''), o.vi) AS vi, coalesce(nullif(n.plain, ''), o.plain) AS plain, coalesce(o.hits, 0) + coalesce(n.hits, 0) AS hits
FROM o FULL JOIN n ON o.key = n.key""")
def tm_upsert_merge(spark, d):
    """UPS-01, UPS-02: merge into the memory, an empty new value keeps the old, hits add up."""
    t = memo(spark, d)
    o = t.filter("model <> 'verbo-2'")
    x = o.groupBy("src").agg(F.min("key").alias("k"))
    n = t.filter("model = 'verbo-2'").join(x, "src").groupBy(F.col("k").alias("key")).agg(F.coalesce(F.max("vi"), F.lit("")).alias("vi"), F.max("plain").alias("plain"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits"))
    return C.keep_old_if_empty(o, n, "key", ["vi", "plain"], "hits")


@query(f"""WITH {PAPERS} SELECT survey_id, sha256(string_agg(x, '|' ORDER BY x)) AS fp FROM (SELECT survey_id, id || ':' || CAST(epoch_us(updated_at) AS VARCHAR) || ':' || coalesce(status, '') AS x FROM p) GROUP BY survey_id""")
def corpus_fingerprint(spark, d):
    """AGG-17: changes when any paper of the corpus does."""
    return C.fingerprint(papers(spark, d))


@query(f"WITH {CHUNKS} SELECT kind, level, count(*) AS n FROM c GROUP BY kind, level")
def kind_histogram(spark, d):
    """AGG-19."""
    return chunks(spark, d).groupBy("kind", "level").agg(F.count("*").alias("n"))


@query(f"WITH {PAPERS} SELECT id, title, year, row_number() OVER (PARTITION BY survey_id ORDER BY created_at NULLS FIRST, id) AS r FROM p")
def paper_listing(spark, d):
    """SORT-01: every paper of each corpus, r its place by created_at (equal times by id)."""
    w = Window.partitionBy("survey_id").orderBy("created_at", "id")
    return papers(spark, d).select("id", "title", "year", F.row_number().over(w).alias("r"))


@query(f"WITH {PAPERS} SELECT id, 'P' || CAST(row_number() OVER (PARTITION BY survey_id ORDER BY id) AS VARCHAR) AS label FROM p")
def paper_labels(spark, d):
    """JOIN-17: short stable labels by id order."""
    return papers(spark, d).select("id", F.concat(F.lit("P"), F.row_number().over(Window.partitionBy("survey_id").orderBy("id")).cast("string")).alias("label"))


@query(f"""WITH {CHUNKS} SELECT id, (length(lower(text)) - length(replace(lower(text), 'memory', ''))) // 6 AS in_text, (length(lower(coalesce(vi, ''))) - length(replace(lower(coalesce(vi, '')), 'bộ nhớ', ''))) // 6 AS in_vi
FROM c WHERE contains(lower(coalesce(text, '')), 'memory') OR contains(lower(coalesce(vi, '')), 'bộ nhớ')""")
def page_find(spark, d):
    """FLT-11: case-insensitive find over columns, with the number of hits."""
    hits = lambda c, q: (F.length(F.lower(c)) - F.length(F.replace(F.lower(c), F.lit(q), F.lit("")))) / len(q)
    c = chunks(spark, d).filter(F.lower(F.coalesce("text", F.lit(""))).contains("memory") | F.lower(F.coalesce("vi", F.lit(""))).contains("bộ nhớ"))
    return c.select("id", hits(F.col("text"), "memory").cast("long").alias("in_text"), hits(F.coalesce("vi", F.lit("")), "bộ nhớ").cast("long").alias("in_vi"))


@query(f"WITH {PAPERS} SELECT id, coalesce(replace(replace(card.tldr_vi, '|', '\\|'), chr(10), ' '), '') AS tldr, coalesce(replace(replace(card.novelty, '|', '\\|'), chr(10), ' '), '') AS novelty FROM p")
def facet_matrix(spark, d):
    """AGT-04, SNK-05: paper by facet, whole cells escaped for a table, empty without a card."""
    cell = lambda c: F.coalesce(F.replace(F.replace(F.col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(""))
    return papers(spark, d).select("id", cell("card.tldr_vi").alias("tldr"), cell("card.novelty").alias("novelty"))


@query(f"""WITH {PAPERS}, {CHUNKS} SELECT 'chunk without paper' AS problem, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = c.paper_id)
UNION ALL SELECT 'vector without chunk', count(*) FROM (SELECT DISTINCT chunk_id FROM emb) e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = e.chunk_id)
UNION ALL SELECT 'child without chunk', count(*) FROM (SELECT DISTINCT unnest(children) AS k FROM c) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = x.k)
UNION ALL SELECT 'paper without survey', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM survey s WHERE s.id = p.survey_id)""")
def integrity(spark, d):
    """MEM-05: dangling references between the tables, by anti-joins both ways."""
    c, p = chunks(spark, d), papers(spark, d)
    e = table(spark, d, "emb").select("chunk_id").distinct()
    kids = c.select(F.explode("children").alias("k")).distinct()
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("problem"), "n")
    ids = c.select("id")
    return (
        n(c.join(p, c.paper_id == p.id, "left_anti"), "chunk without paper")
        .unionByName(n(e.join(ids, e.chunk_id == ids.id, "left_anti"), "vector without chunk"))
        .unionByName(n(kids.join(ids, kids.k == ids.id, "left_anti"), "child without chunk"))
        .unionByName(n(p.join(table(spark, d, "survey").select(F.col("id").alias("sid")), F.col("survey_id") == F.col("sid"), "left_anti"), "paper without survey"))
    )


@query(f"""WITH {PAPERS}, {CHUNKS}, gone AS (SELECT id FROM p WHERE status = 'failed'), left_c AS (SELECT * FROM c WHERE paper_id NOT IN (SELECT id FROM gone))
SELECT (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM gone)) AS papers, (SELECT count(*) FROM left_c) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT chunk_id, model FROM emb) e WHERE EXISTS (SELECT 1 FROM left_c l WHERE l.id = e.chunk_id)) AS vectors""")
def drop_cascade(spark, d):
    """MUT-01: dropping papers takes their passages and vectors along (their entities: graph_after_drop)."""
    p = papers(spark, d)
    gone = p.filter("status = 'failed'").select(F.col("id").alias("paper_id"))
    kept = p.join(gone, p.id == gone.paper_id, "left_anti")
    c = chunks(spark, d).join(gone, "paper_id", "left_anti")
    e = table(spark, d, "emb").select("chunk_id", "model").distinct().join(c.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    one = [x.agg(F.count("*").alias(n)).withColumn("_1", F.lit(1)) for x, n in ((kept, "papers"), (c, "chunks"), (e, "vectors"))]
    return one[0].join(one[1], "_1").join(one[2], "_1").drop("_1")


@query(f"""WITH {PAPERS} SELECT id, substr(sha256('sv001' || '|' || id), 1, 14) AS new_id FROM p WHERE survey_id = 'sv002' AND (sha256 IS NULL OR sha256 NOT IN (SELECT sha256 FROM p WHERE survey_id = 'sv001' AND sha256 IS NOT NULL))""")
def move_rekey(spark, d):
    """Ids for papers of another corpus; the same file there stops a move (MUT-02 itself: graph_after_move, edges_after_move)."""
    p = papers(spark, d)
    there = p.filter("survey_id = 'sv001' and sha256 is not null").select("sha256")
    moved = p.filter("survey_id = 'sv002'").join(there, "sha256", "left_anti")
    return moved.select("id", F.left(F.sha2(F.concat(F.lit("sv001|"), F.col("id")), 256), F.lit(14)).alias("new_id"))


@query(f"""WITH {CHUNKS}, n AS (SELECT paper_id, ord, 'changed' AS new_ctx FROM c WHERE level = 0 AND ord = 1), o AS (SELECT * FROM c WHERE level = 0)
SELECT o.id, CASE WHEN n.new_ctx IS NOT NULL AND n.new_ctx <> coalesce(o.ctx, '') THEN n.new_ctx ELSE o.ctx END AS ctx FROM o LEFT JOIN n ON o.paper_id = n.paper_id AND o.ord = n.ord""")
def set_context(spark, d):
    """SNK-03: conditional update, only where the new context is given and different."""
    c = chunks(spark, d, 0)
    n = c.filter("ord = 1").select("paper_id", "ord", F.lit("changed").alias("new_ctx"))
    return c.join(n, ["paper_id", "ord"], "left").select("id", F.when(F.col("new_ctx").isNotNull() & (F.col("new_ctx") != F.coalesce("ctx", F.lit(""))), F.col("new_ctx")).otherwise(F.col("ctx")).alias("ctx"))


@query(f"""WITH {CHUNKS} SELECT id, trim(coalesce(title, '') || ' — ' || coalesce(section, ''), ' —') AS ctx FROM c WHERE level = 0 AND ctx IS NULL""")
def context_fallback(spark, d):
    """DOC-27: title and section where no context was written."""
    return chunks(spark, d, 0).filter("ctx is null").select("id", F.btrim(F.concat(F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("section", F.lit(""))), F.lit(" —")).alias("ctx"))


@query(f"""WITH {PAPERS}, x AS (SELECT survey_id, id, '[P' || CAST(row_number() OVER (PARTITION BY survey_id ORDER BY id) AS VARCHAR) || '] ' || coalesce(title, '') || ' (' || CASE WHEN coalesce(year, 0) <> 0 THEN CAST(year AS VARCHAR) ELSE 'n.d.' END
 || CASE WHEN coalesce(venue, '') <> '' THEN ', ' || venue ELSE '' END || ')' || CASE WHEN coalesce(card.tldr_vi, '') <> '' THEN chr(10) || '  Chốt: ' || card.tldr_vi ELSE '' END || CASE WHEN coalesce(card.novelty, '') <> '' THEN chr(10) || '  Điểm mới: ' || card.novelty ELSE '' END AS t, card IS NOT NULL AS has FROM p)
SELECT survey_id, sha256(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY id) FILTER (WHERE has), '')) AS digest FROM x GROUP BY survey_id""")
def corpus_digest(spark, d):
    """AGG-18: deterministic ordered text of a corpus (hashed here): the whole card of each paper in id order.

    Labels count all papers of the corpus, as in the reference; its constant head is left out, novelty is added. A corpus
    without cards has the hash of the empty text.
    """
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    line = lambda c, label: F.when(filled(c), F.concat(F.lit(f"\n  {label}: "), c)).otherwise(F.lit(""))
    year = F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).otherwise(F.lit("n.d."))
    head = F.concat(F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), year, F.when(filled(F.col("venue")), F.concat(F.lit(", "), F.col("venue"))).otherwise(F.lit("")), F.lit(")"))
    part = F.when(F.col("card").isNotNull(), F.concat(head, line(F.col("card.tldr_vi"), "Chốt"), line(F.col("card.novelty"), "Điểm mới")))
    parts = papers(spark, d).groupBy("survey_id").agg(F.array_sort(F.collect_list(F.struct("id", part.alias("t")))).alias("l"))
    labelled = F.transform("l", lambda s, i: F.concat(F.lit("[P"), (i + 1).cast("string"), s.t))
    return parts.select("survey_id", F.sha2(F.array_join(labelled, "\n\n"), 256).alias("digest"))
