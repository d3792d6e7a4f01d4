"""Queries over decks, outlines and syntheses that are drawn from the stored documents, and over answers and findings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrion.functions import text as T
from papyrion.operators import deck as D
from papyrion.operators import verify as V
from papyrion.plans.checks import _norm, _nums
from papyrion.plans.relational import CHUNKS, MEMO, PAPERS, chunks, memo, papers
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


#: A deck of four blocks a slide; some headlines, figures and sources are spoilt so that the rules have something to find.
DECK = f"""{BLOCKS}, s0 AS (SELECT doc, pos // 4 AS no, list(text ORDER BY pos) AS t, list(id ORDER BY pos) AS ids FROM bl GROUP BY doc, pos // 4),
deck AS (SELECT doc, no, CASE no % 8 WHEN 0 THEN 'title' WHEN 1 THEN 'agenda' WHEN 2 THEN 'section' WHEN 7 THEN 'closing' ELSE 'content' END AS kind, CASE no % 6 WHEN 3 THEN 'Results' WHEN 4 THEN t[1] || ':' WHEN 5 THEN t[1] || ' 98765' ELSE t[1] END AS headline,
 t[2:] AS bullets, CASE WHEN no % 3 = 0 THEN 'f' || CAST(no % 4 AS VARCHAR) END AS figure, array_to_string(t, ' ') AS notes, CASE WHEN no % 5 = 4 THEN [] ELSE ids END AS sources FROM s0),
figs AS (SELECT DISTINCT doc, 'f' || CAST(pos % 3 AS VARCHAR) AS figure FROM bl)"""


def _deck(spark, d):
    b = blocks(spark, d).withColumn("no", F.floor(F.col("pos") / 4).cast("int"))
    g = b.groupBy("doc", "no").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "id"))).alias("l"))
    t = F.transform("l", lambda x: x.text)
    n, first = F.col("no"), F.element_at(t, 1)
    kind = F.when(n % 8 == 0, "title").when(n % 8 == 1, "agenda").when(n % 8 == 2, "section").when(n % 8 == 7, "closing").otherwise("content")
    head = F.when(n % 6 == 3, "Results").when(n % 6 == 4, F.concat(first, F.lit(":"))).when(n % 6 == 5, F.concat(first, F.lit(" 98765"))).otherwise(first)
    sources = F.when(n % 5 == 4, F.array().cast("array<string>")).otherwise(F.transform("l", lambda x: x.id))
    return g.select("doc", "no", kind.alias("kind"), head.alias("headline"), F.slice(t, 2, 1000).alias("bullets"), F.when(n % 3 == 0, F.concat(F.lit("f"), (n % 4).cast("string"))).alias("figure"), F.array_join(t, " ").alias("notes"), sources.alias("sources"))


def _figures(spark, d):
    return blocks(spark, d).select("doc", F.concat(F.lit("f"), (F.col("pos") % 3).cast("string")).alias("figure")).distinct()


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _head(c: str) -> str:
    t = f"trim(coalesce({c}, ''))"
    return f"CASE WHEN {t} = '' THEN 'missing' END, CASE WHEN lower(trim(regexp_replace({t}, '[:.]+$', ''))) IN ({_in(D.EMPTY_HEADLINES)}) THEN 'topic' END, CASE WHEN suffix({t}, ':') THEN 'label' END, CASE WHEN suffix({t}, '?') THEN 'question' END"


def _nwords(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"


@query(f"""WITH {DECK}, k AS (SELECT deck.*, figs.figure IS NOT NULL AS known FROM deck LEFT JOIN figs USING (doc, figure)), a AS (SELECT *, known AND figure IS NOT NULL AND row_number() OVER (PARTITION BY doc, figure, known ORDER BY no) > 1 AS again FROM k)
SELECT doc, no, list_filter([{_head('headline')}, CASE WHEN length(trim(headline)) > {D.MOST_HEADLINE} THEN 'long_headline' END, CASE WHEN {_nwords("headline || ' ' || array_to_string(bullets, ' ')")} > {D.MOST_WORDS} AND kind NOT IN ({_in(D.QUIET)}) THEN 'words' END,
CASE WHEN len(bullets) > {D.MOST_BULLETS} THEN 'bullets' END, CASE WHEN kind = 'content' AND {_nwords('notes')} < {D.NOTES[0]} THEN 'short_notes' END, CASE WHEN kind = 'content' AND {_nwords('notes')} > {D.NOTES[1]} THEN 'long_notes' END, CASE WHEN figure IS NOT NULL AND NOT known THEN 'unknown_figure' END,
CASE WHEN again THEN 'figure_again' END, CASE WHEN kind = 'content' AND (figure IS NULL OR NOT known) THEN 'nothing_to_see' END, CASE WHEN len(sources) = 0 AND kind NOT IN ({_in(D.QUIET)}, 'agenda') THEN 'no_source' END, CASE WHEN kind = 'section' AND len(bullets) > 0 THEN 'divider_with_bullets' END], lambda x: x IS NOT NULL) AS codes FROM a""")
def slide_checks(spark, d):
    """VER-12, WIN-11: rules and budgets of slides, figures that exist and are used once."""
    return D.slide_codes(_deck(spark, d), _figures(spark, d))


@query(rf"""WITH {DECK}, f AS (SELECT doc || '/' || CAST(no AS VARCHAR) AS id, headline || ' ' || array_to_string(bullets, ' ') AS text FROM deck WHERE kind NOT IN ({_in(D.QUIET)}) AND len(sources) > 0), n AS (SELECT DISTINCT id, num AS raw, {_norm("num")} AS num FROM ({_nums("f", "text")}) WHERE num <> ''),
src AS (SELECT x.doc || '/' || CAST(x.no AS VARCHAR) AS id, bl.text FROM (SELECT doc, no, unnest(sources) AS b FROM deck WHERE kind NOT IN ({_in(D.QUIET)})) x JOIN bl ON bl.doc = x.doc AND bl.id = x.b),
s0 AS (SELECT id, regexp_extract(tok, '^[0-9]+([.,][0-9]+)*', 0) AS num FROM (SELECT id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_.,]+')) AS tok FROM src) WHERE regexp_matches(tok, '^[0-9]')),
s1 AS (SELECT id, {_norm("num")} AS num FROM s0 UNION SELECT id, regexp_replace(num, '[.,]', '', 'g') FROM s0 WHERE contains(num, '.') OR contains(num, ','))
SELECT DISTINCT string_split(id, '/')[1] AS doc, CAST(string_split(id, '/')[2] AS INTEGER) AS no, num FROM n WHERE NOT (regexp_full_match(raw, '[0-9]+') AND coalesce(TRY_CAST(raw AS BIGINT) <= 12, false)) AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.id = n.id AND s1.num = n.num)""".replace("s0 AS (SELECT id, regexp_extract", "sz AS (SELECT id, regexp_extract").replace("FROM s0 UNION", "FROM sz UNION").replace("FROM s0 WHERE contains", "FROM sz WHERE contains"))
def slide_numbers(spark, d):
    """VER-12, VER-11: figures of a slide that its source blocks do not hold."""
    return D.orphan_numbers(_deck(spark, d), blocks(spark, d))


@query(f"""WITH {DECK}, it AS (SELECT doc, no, kind, headline AS message, CASE WHEN no % 7 = 3 THEN bullets[1:1] WHEN no % 7 = 5 THEN [] ELSE bullets END AS points, 'S' || CAST(no // 5 AS VARCHAR) AS section, CASE WHEN figure IS NULL THEN 'none' ELSE 'figure' END AS evidence, sources FROM deck)
SELECT doc, no, list_filter([{_head('message')}, CASE WHEN kind = 'content' AND len(points) = 0 THEN 'no_points' END, CASE WHEN kind = 'content' AND len(points) > 0 AND len(points) < 3 THEN 'few_points' END, CASE WHEN kind = 'content' AND section NOT IN ('S0', 'S1') THEN 'unknown_section' END,
CASE WHEN kind = 'content' AND evidence = 'none' THEN 'no_evidence' END, CASE WHEN len(sources) = 0 AND kind NOT IN ('title', 'agenda', 'section', 'closing') THEN 'no_source' END], lambda x: x IS NOT NULL) AS codes FROM it""")
def outline_checks(spark, d):
    """VER-13: rules of outlines: statements, points, known sections, evidence, sources."""
    k = _deck(spark, d)
    points = F.when(F.col("no") % 7 == 3, F.slice("bullets", 1, 1)).when(F.col("no") % 7 == 5, F.array().cast("array<string>")).otherwise(F.col("bullets"))
    it = k.select("doc", "no", "kind", F.col("headline").alias("message"), points.alias("points"), F.concat(F.lit("S"), F.floor(F.col("no") / 5).cast("string")).alias("section"), F.when(F.col("figure").isNull(), "none").otherwise("figure").alias("evidence"), "sources")
    names = k.select("doc").distinct().select("doc", F.explode(F.array(F.lit("S0"), F.lit("S1"))).alias("name"))
    return D.outline_codes(it, names)


@query(f"""WITH {DECK}, g AS (SELECT doc, arg_min(bullets, no) FILTER (WHERE kind = 'agenda') AS items, count(*) FILTER (WHERE kind = 'section') AS n FROM deck GROUP BY doc), i AS (SELECT doc, n, list_filter(items, lambda b: trim(b) <> '') AS items FROM g)
SELECT doc, list_filter([CASE WHEN items IS NULL AND n > 0 THEN 'no_agenda' END, CASE WHEN len(items) < 3 THEN 'few_entries' END, CASE WHEN len(list_filter(items, lambda b: list_contains([{_in(D.BARE_AGENDA)}], lower(regexp_replace(trim(b), '\\.+$', ''))))) > 0 THEN 'bare_entries' END, CASE WHEN n > len(items) THEN 'more_dividers' END], lambda x: x IS NOT NULL) AS codes FROM i""")
def agenda_checks(spark, d):
    """VER-13: the agenda against the dividers."""
    return D.agenda_codes(_deck(spark, d))


def _walks(c: str) -> str:
    n = lambda ws: f"len(list_filter([{_in(ws)}], lambda w: contains(lower(coalesce({c}, '')), w)))"
    return f"({n(D.STEPS)} >= 2 AND {n(D.STRICT_CAUSAL)} >= 2)"


@query(f"WITH {CHUNKS} SELECT paper_id, count(*) AS slides, count(*) FILTER (WHERE {_walks('vi')}) AS walking, count(*) >= 6 AND count(*) FILTER (WHERE {_walks('vi')}) = 0 AS shallow FROM c WHERE level = 0 GROUP BY paper_id")
def deck_depth(spark, d):
    """VER-13: decks of six slides or more none of which follows a mechanism."""
    c = chunks(spark, d, 0).withColumn("w", D.walks_mechanism(F.col("vi")))
    return c.groupBy("paper_id").agg(F.count("*").alias("slides"), F.count_if("w").alias("walking")).withColumn("shallow", (F.col("slides") >= 6) & (F.col("walking") == 0))


@query(f"""WITH {BLOCKS}, h AS (SELECT doc, list(text ORDER BY pos) AS names FROM bl WHERE type = 'heading' GROUP BY doc), k AS (SELECT doc, list(text ORDER BY pos) AS cards FROM bl WHERE type = 'caption' GROUP BY doc)
SELECT doc, unnest(range(len(names)))::INTEGER AS i, unnest(names) AS title, unnest(list_transform(range(1, len(names) + 1), lambda i: cards[i])) AS card FROM h LEFT JOIN k USING (doc)""")
def agenda_titles(spark, d):
    """SLD-01: section names overwrite the titles of an agenda's cards by position."""
    b = blocks(spark, d)
    lists = lambda kind, name: b.filter(F.col("type") == kind).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text).alias(name))
    j = lists("heading", "names").join(lists("caption", "cards"), "doc", "left")
    return j.select("doc", F.posexplode(D.agenda_titles(F.col("names"), F.coalesce("cards", F.array().cast("array<string>")))).alias("i", "x")).select("doc", "i", "x.title", "x.card")


@query(f"""WITH {BLOCKS}, o AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) AS no, id AS oid FROM bl WHERE type = 'para'), s AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos DESC) AS place, CASE WHEN pos % 3 = 0 THEN id END AS oid, 'slide of ' || id AS slide FROM bl WHERE type = 'para')
SELECT o.doc, o.no, o.oid, coalesce(a.slide, b.slide) AS slide FROM o LEFT JOIN s a ON a.doc = o.doc AND a.oid = o.oid LEFT JOIN s b ON b.doc = o.doc AND b.place = o.no""")
def deck_of_outline(spark, d):
    """JOIN-15: slides to outline items by id, by position where the id is missing."""
    b = blocks(spark, d).filter("type = 'para'")
    w = Window.partitionBy("doc")
    o = b.select("doc", F.row_number().over(w.orderBy("pos")).alias("no"), F.col("id").alias("oid"))
    s = b.select("doc", F.row_number().over(w.orderBy(F.desc("pos"))).alias("place"), F.when(F.col("pos") % 3 == 0, F.col("id")).alias("oid"), F.concat(F.lit("slide of "), "id").alias("slide"))
    return D.slides_of_outline(o, s)


@query(f"WITH {CHUNKS} SELECT DISTINCT paper_id AS id, id AS src, unnest(children) AS dst FROM c WHERE level > 0")
def flowchart_edges(spark, d):
    """DOC-29: flowchart texts (the summary trees, written out here) read back as edges."""
    e = chunks(spark, d).filter("level > 0 and size(children) > 0").select("paper_id", "id", F.explode("children").alias("k")).distinct()
    line = F.concat("id", F.lit('["a --> b | c"] -->|has| '), "k", F.lit("(leaf)"))
    t = e.groupBy("paper_id").agg(F.concat(F.lit("flowchart TD\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("t"))
    return D.flowchart(t, "paper_id", "t")


@query(f"""WITH {MEMO}, g AS (SELECT key, plain, coalesce(CAST(hits AS BIGINT), 0) % 3 AS open FROM t WHERE plain IS NOT NULL) SELECT key FROM g WHERE open > 0 AND NOT regexp_matches(plain, '{V.GAP}')""")
def hidden_gaps(spark, d):
    """VER-08: answers with open questions (drawn from the hits) that do not own up to it."""
    m = memo(spark, d).filter("plain is not null").withColumn("open", F.coalesce(F.col("hits").cast("long"), F.lit(0)) % 3)
    return m.filter(V.hides_gap(F.col("plain"), F.col("open"))).select("key")


def _content(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[0-9A-Za-zÀ-ỹ]+'), lambda w: length(w) > 1 AND w NOT IN ({_in(V.STOP)})))"


@query(f"""WITH {MEMO}, x AS (SELECT key, {_content('src')} AS a, {_content('plain')} AS b FROM t WHERE src IS NOT NULL AND plain IS NOT NULL) SELECT key, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / greatest(len(a), 1) >= 0.6 AND len(b) <= 2.5 * len(a) AS circular FROM x""")
def circular_explanations(spark, d):
    """DEP-04: explanations that hardly say more than what they explain."""
    m = memo(spark, d).filter("src is not null and plain is not null")
    return m.select("key", F.coalesce(V.circular(F.col("src"), F.col("plain")), F.lit(False)).alias("circular"))


@query()
def sentence_lints(spark, d):
    """VER-01, VER-05: kinds of shallow writing sentence by sentence."""
    s = V.sentences(memo(spark, d), "key", "plain").withColumn("kinds", V.lints(F.col("text")))
    return s.filter("size(kinds) > 0").select("id", "i", "kinds")


@query(f"""WITH {CHUNKS}, s AS (SELECT x.id, x.i, k.id AS cite, k.text FROM (SELECT id, unnest(range(len(children))) AS i, unnest(children) AS k FROM c WHERE level > 0) x JOIN c k ON k.id = x.k WHERE length(k.text) > 40), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, cite) AS n FROM s)
SELECT id, cite, CASE (length(text) + i) % 3 WHEN 0 THEN 'unsupported' ELSE 'weak' END AS warning FROM r WHERE n <= 40 AND (length(text) + i) % 3 < 2""")
def entailment_warnings(spark, d):
    """VER-09: cited sentences of more than 40 characters, at most forty an answer, with the verdicts given for them (drawn from their lengths)."""
    c = chunks(spark, d)
    s = c.filter("level > 0").select("id", F.posexplode("children").alias("i", "cite")).join(c.select(F.col("id").alias("cite"), "text"), "cite").filter("length(text) > 40")
    r = s.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("i", "cite"))).filter("n <= 40")
    verdict = (F.length("text") + F.col("i")) % 3
    return r.withColumn("v", verdict).filter("v < 2").select("id", "cite", F.when(F.col("v") == 0, "unsupported").otherwise("weak").alias("warning"))


_LABEL = r"(?m)^[ \t]*(?:<{2,4}[ \t]*b3[ \t]*>{2,4}|#{1,6}[ \t]*b3_?[ \t]*|\*\*[ \t]*b3[ \t]*\*\*|\[[ \t]*b3[ \t]*\])[ \t]*:?[ \t]*$"


@query(rf"""WITH {MEMO}, x AS (SELECT key, src, coalesce(vi, '') || ' ' || coalesce(plain, '') || CASE WHEN length(src) % 7 = 0 THEN chr(10) || '### b3' ELSE '' END AS body FROM t WHERE src IS NOT NULL)
SELECT key FROM x WHERE len(list_filter(list_distinct(regexp_extract_all(body, '[^{V.ALLOWED}]')), lambda ch: NOT contains(src, ch))) = 0 AND NOT regexp_matches(body, '{_LABEL}')""")
def memo_gate(spark, d):
    """VER-15: answers that may enter the memory: no strange script, no label of another block (put into some here)."""
    m = memo(spark, d).filter("src is not null")
    body = F.concat(F.coalesce("vi", F.lit("")), F.lit(" "), F.coalesce("plain", F.lit("")), F.when(F.length("src") % 7 == 0, F.lit("\n### b3")).otherwise(""))
    m = m.select("key", "src", body.alias("body"))
    return m.filter((F.size(V.script_leak(F.col("body"), F.col("src"))) == 0) & ~F.col("body").rlike(_LABEL)).select("key")


_FINDINGS = """fd AS (SELECT paper_id, CASE WHEN ord % 4 = 0 THEN 'zz' || id ELSE id END AS chunk, 'q' || CAST(ord % 3 + 1 AS VARCHAR) AS sub, CASE WHEN ord % 5 = 0 THEN ' ' ELSE trim(left(coalesce(text, ''), 100)) END AS finding, left(trim(coalesce(text, '')), 400) AS quote FROM c WHERE level = 0),
gate AS (SELECT * FROM fd WHERE chunk IN (SELECT id FROM c WHERE level = 0 AND ord <= 12) AND trim(finding) <> '')"""


def _findings(spark, d):
    c = chunks(spark, d, 0)
    f = c.select("paper_id", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("zz"), "id")).otherwise(F.col("id")).alias("chunk"), F.concat(F.lit("q"), (F.col("ord") % 3 + 1).cast("string")).alias("sub"), F.when(F.col("ord") % 5 == 0, F.lit(" ")).otherwise(F.trim(F.left(F.coalesce("text", F.lit("")), F.lit(100)))).alias("finding"), F.left(F.trim(F.coalesce("text", F.lit(""))), F.lit(400)).alias("quote"))
    return V.read_gate(f, c.filter("ord <= 12").select(F.col("id").alias("chunk")))


@query(f"WITH {CHUNKS}, {_FINDINGS} SELECT paper_id, chunk, sub, finding, quote FROM gate")
def findings_gate(spark, d):
    """VER-16: findings that rest on a passage of the batch and say something (a passage of no batch is put under some here)."""
    return _findings(spark, d)


@query(f"WITH {CHUNKS}, {_FINDINGS} SELECT paper_id, sub, count(*) AS n, string_agg('- ' || finding || ' [' || chunk || ']', chr(10) ORDER BY chunk, finding) AS text FROM gate GROUP BY paper_id, sub")
def findings_by_question(spark, d):
    """AGG-16, AGT-03: findings grouped by the question they answer, as text for an answer."""
    f = _findings(spark, d).groupBy("paper_id", "sub").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("chunk", "finding"))).alias("l"))
    return f.select("paper_id", "sub", "n", F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x.finding, F.lit(" ["), x.chunk, F.lit("]"))), "\n").alias("text"))


@query(f"WITH {CHUNKS}, {_FINDINGS} SELECT paper_id, list_sort(list_distinct(list(sub))) AS covered, list_sort(list_distinct(list(chunk))) AS seen FROM gate GROUP BY paper_id")
def covered_and_seen(spark, d):
    """AGG-21: sets of what is covered and what was seen."""
    return _findings(spark, d).groupBy("paper_id").agg(F.sort_array(F.collect_set("sub")).alias("covered"), F.sort_array(F.collect_set("chunk")).alias("seen"))


#: A synthesis of each corpus: one approach a year, its papers, a cited claim of each; some ids are spoilt.
_SYNTH = f"""{PAPERS}, {CHUNKS}, ap AS (SELECT survey_id, year, id FROM p WHERE year IS NOT NULL AND survey_id IS NOT NULL AND id NOT LIKE '%2' UNION ALL SELECT survey_id, year, 'x' || survey_id FROM p WHERE year % 2 = 0 AND survey_id IS NOT NULL GROUP BY survey_id, year),
ev AS (SELECT ap.survey_id, ap.id || 'c' || CAST(1 + ap.year % 3 AS VARCHAR) AS cite, p.card.tldr_vi AS claim FROM ap JOIN p ON p.id = ap.id WHERE p.card.tldr_vi IS NOT NULL), own AS (SELECT c.id, p.survey_id, coalesce(c.text, '') || ' ' || coalesce(c.vi, '') AS body FROM c JOIN p ON p.id = c.paper_id),
j AS (SELECT ev.survey_id || '/' || ev.cite AS id, ev.claim, own.body FROM ev JOIN own ON own.id = ev.cite AND own.survey_id = ev.survey_id)"""


@query(rf"""WITH {_SYNTH}, cl AS (SELECT DISTINCT id, {_norm("num")} AS num FROM ({_nums("j", "claim")}) WHERE num <> ''), sz AS (SELECT id, regexp_extract(tok, '^[0-9]+([.,][0-9]+)*', 0) AS num FROM (SELECT id, unnest(regexp_extract_all(body, '[\p{{L}}\p{{M}}\p{{N}}_.,]+')) AS tok FROM j) WHERE regexp_matches(tok, '^[0-9]')),
s1 AS (SELECT id, {_norm("num")} AS num FROM sz UNION SELECT id, regexp_replace(num, '[.,]', '', 'g') FROM sz WHERE contains(num, '.') OR contains(num, ','))
SELECT DISTINCT survey_id, 'unknown_chunk' AS kind, cite AS ref FROM ev WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.id = ev.cite AND own.survey_id = ev.survey_id)
UNION ALL SELECT DISTINCT string_split(id, '/')[1], 'fabricated_number', string_split(id, '/')[2] || ' ' || num FROM cl WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.id = cl.id AND s1.num = cl.num)
UNION ALL SELECT DISTINCT survey_id, 'unknown_paper', id FROM ap WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = ap.id AND p.survey_id = ap.survey_id)
UNION ALL SELECT survey_id, 'forgotten_paper', id FROM p WHERE survey_id IS NOT NULL AND card IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ap WHERE ap.id = p.id AND ap.survey_id = p.survey_id)
UNION ALL SELECT survey_id, 'no_falsifier', CAST(year AS VARCHAR) FROM ap WHERE year % 3 = 0 GROUP BY survey_id, year
UNION ALL SELECT survey_id, 'not_grouped', '' FROM (SELECT survey_id, year, count(DISTINCT id) AS n FROM ap GROUP BY survey_id, year) GROUP BY survey_id HAVING count(*) >= 3 AND max(n) <= 1""")
def synthesis_checks(spark, d):
    """VER-10: a synthesis against its corpus: passages, figures and papers that exist, none forgotten, approaches that can fail and group."""
    p, c = papers(spark, d).filter("survey_id is not null"), chunks(spark, d)
    odd = p.filter("year % 2 = 0").select("survey_id", "year", F.concat(F.lit("x"), "survey_id").alias("id")).distinct()
    ap = p.filter("year is not null and id not like '%2'").select("survey_id", "year", "id").unionByName(odd).withColumn("falsify", F.when(F.col("year") % 3 != 0, F.lit("given")))
    ev = ap.join(p.select("id", F.col("card.tldr_vi").alias("claim")), "id").filter("claim is not null").select("survey_id", F.concat("id", F.lit("c"), (1 + F.col("year") % 3).cast("string")).alias("cite"), "claim")
    own = c.join(p.select(F.col("id").alias("paper_id"), "survey_id"), "paper_id").select("survey_id", F.col("id").alias("cite"), F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("vi", F.lit(""))).alias("body"))
    return V.synthesis_warnings(ap.withColumn("name", F.col("year").cast("string")), ev, own, p.select("survey_id", "id", F.col("card").isNotNull().alias("carded")))


_ANSWER = """an AS (SELECT CAST(survey_id AS VARCHAR) || '/' || right(id, 1) AS aid, survey_id, string_agg(coalesce(title, '') || ' (' || CAST(coalesce(year, 0) + CASE WHEN n_pages % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) || '). ' || repeat('And so on. ', 8), '' ORDER BY id) AS answer FROM p WHERE survey_id IS NOT NULL GROUP BY ALL)"""


@query(rf"""WITH {PAPERS}, {_ANSWER}, h AS (SELECT an.aid, p.id, p.year, left(trim(p.title), 40) AS head, an.answer FROM an JOIN p ON p.survey_id = an.survey_id AND CAST(p.survey_id AS VARCHAR) || '/' || right(p.id, 1) = an.aid WHERE length(trim(p.title)) >= 12 AND coalesce(p.year, 0) <> 0),
n AS (SELECT *, strpos(answer, head) AS ps FROM h WHERE contains(answer, head)), y AS (SELECT aid, id, year, list_distinct(list_transform(regexp_extract_all(substr(answer, greatest(ps - 60, 1), length(head) + ps - greatest(ps - 60, 1) + 60), '\b((?:19|20)\d{{2}})\b', 1), lambda x: CAST(x AS INTEGER))) AS years FROM n)
SELECT aid, id, year, list_sort(years) AS said FROM y WHERE len(years) > 0 AND NOT list_contains(years, year)""")
def year_mismatch(spark, d):
    """VER-06: years within sixty characters of a paper's title that are not its own (the answers are written from the papers, some years spoilt)."""
    p = papers(spark, d).filter("survey_id is not null").withColumn("aid", F.concat_ws("/", "survey_id", F.right("id", F.lit(1))))
    said = (F.coalesce("year", F.lit(0)) + F.when(F.col("n_pages") % 3 == 0, 1).otherwise(0)).cast("string")
    part = F.concat(F.coalesce("title", F.lit("")), F.lit(" ("), said, F.lit("). "), F.lit("And so on. " * 8))
    a = p.groupBy("aid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", part.alias("t")))), lambda x: x.t), "").alias("answer"))
    return V.year_conflicts(a, p.select("aid", "id", "title", "year"))
