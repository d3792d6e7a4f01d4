"""Grounding checks, memo, sources and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrion.functions import text as T
from papyrion.operators import memo as M
from papyrion.operators import verify as V
from papyrion.operators.biblio import rebuild_inverted
from papyrion.operators.corpus import fingerprint
from papyrion.plans.relational import CHUNKS, MEMO, PAPERS, chunks, memo, papers
from papyrion.plans.structure import BLOCKS, blocks
from papyrion.session import table
from papyrion.sources import readers as R
from papyrion.sources import sinks as Snk
from papyrion.streaming.ingest import sessions, windowed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Numbers of a text without look-around: tokens of a superset class, then anchored patterns.
def _nums(src: str, c: str) -> str:
    return rf"""SELECT id, CASE WHEN regexp_full_match(tok, '[0-9]+([.,][0-9]+)*([.,].*)?') THEN regexp_extract(tok, '^[0-9]+([.,][0-9]+)*', 0) ELSE regexp_extract(tok, '^([0-9]+([.,][0-9]+)*)[.,][0-9]+[\p{{L}}_]', 1) END AS num
FROM (SELECT id, unnest(regexp_extract_all({c}, '[\p{{L}}\p{{M}}\p{{N}}_.,]+')) AS tok FROM {src}) WHERE regexp_matches(tok, '^[0-9]')"""


def _norm(n: str) -> str:
    return f"CASE WHEN contains({n}, '.') OR contains({n}, ',') THEN regexp_replace(regexp_replace(replace({n}, ',', '.'), '0+$', ''), '\\.+$', '') ELSE {n} END"


@query(rf"""WITH {CHUNKS}, v AS (SELECT id, text, vi FROM c WHERE vi IS NOT NULL AND text IS NOT NULL), cl AS (SELECT DISTINCT id, {_norm("num")} AS num FROM ({_nums("v", "vi")}) WHERE num <> ''),
s0 AS (SELECT id, regexp_extract(tok, '^[0-9]+([.,][0-9]+)*', 0) AS num FROM (SELECT id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_.,]+')) AS tok FROM v) WHERE regexp_matches(tok, '^[0-9]')),
s AS (SELECT id, {_norm("num")} AS num FROM s0 UNION SELECT id, regexp_replace(num, '[.,]', '', 'g') FROM s0 WHERE contains(num, '.') OR contains(num, ','))
SELECT id, num FROM cl WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = cl.id AND s.num = cl.num)""")
def ungrounded_numbers(spark, d):
    """VER-04, VER-11: figures of a translation that its passage does not hold."""
    c = chunks(spark, d).filter("vi is not null and text is not null")
    return V.ungrounded_numbers(c.select("id", F.col("vi").alias("text")), c.select("id", F.col("text").alias("source")))


@query(f"WITH {CHUNKS} SELECT x.id, x.cite FROM (SELECT id, paper_id, unnest(children) AS cite FROM c WHERE level > 0) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.paper_id = x.paper_id AND c.id = x.cite AND c.kind = 'para')")
def unknown_citations(spark, d):
    """VER-02, JOIN-18: what a summary cites that is no paragraph of its paper."""
    c = chunks(spark, d)
    s = c.filter("level > 0").select("id", "paper_id", F.explode("children").alias("cite"))
    allowed = c.filter("kind = 'para'").select("paper_id", F.col("id").alias("cite"))
    return s.join(allowed, ["paper_id", "cite"], "left_anti").select("id", "cite")


@query()
def uncited_numbers(spark, d):
    """VER-01, VER-03: sentences of explanations with figures and no citation."""
    return V.uncited_numbers(V.sentences(memo(spark, d), "key", "plain"))


@query(rf"""WITH {CHUNKS}, x AS (SELECT id, list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(vi, ''), '[^{V.ALLOWED}]')), lambda ch: NOT contains(coalesce(text, ''), ch))) AS leak FROM c WHERE vi IS NOT NULL OR text IS NOT NULL)
SELECT id, leak FROM x WHERE len(leak) > 0 UNION ALL SELECT id, list_sort(list_distinct(regexp_extract_all(text, '[^{V.ALLOWED}]'))) FROM c WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[^{V.ALLOWED}]')) > 0""")
def script_leak(spark, d):
    """VER-07, SET-04: characters of strange scripts in a translation, and in passages against an empty source."""
    c = chunks(spark, d)
    a = c.filter("vi is not null or text is not null").select("id", V.script_leak(F.col("vi"), F.col("text")).alias("leak"))
    b = c.filter("text is not null").select("id", V.script_leak(F.col("text"), F.lit("")).alias("leak"))
    return a.unionByName(b).filter(F.size("leak") > 0)


def _list(x) -> str:
    return "[" + ", ".join(f"'{i}'" for i in x) + "]"


def _lints(c: str) -> str:
    causal = f"len(list_filter({_list(V.CAUSAL)}, lambda x: contains(lower({c}), x))) > 0"
    vague = f"(len(list_filter({_list(V.VAGUE)}, lambda x: contains(lower({c}), x))) > 0 AND NOT {causal})"
    bare = f"(NOT {vague} AND len(regexp_extract_all(lower({c}), '[0-9A-Za-zÀ-ỹ]+')) >= 12 AND NOT {causal} AND NOT regexp_matches({c}, '[0-9]'))"
    return f"list_filter([CASE WHEN len(list_filter({_list(V.FILLER)}, lambda x: contains(lower({c}), x))) > 0 THEN 'filler' END, CASE WHEN {vague} THEN 'vague' END, CASE WHEN {bare} THEN 'no_mechanism' END], lambda x: x IS NOT NULL)"


@query(f"WITH {CHUNKS} SELECT id, {_lints('vi')} AS kinds FROM c WHERE vi IS NOT NULL")
def depth_lints(spark, d):
    """DEP-01 to DEP-03, DEP-05, VER-05: kinds of shallow writing."""
    return chunks(spark, d).filter("vi is not null").select("id", V.lints(F.col("vi")).alias("kinds"))


@query(f"""WITH {MEMO}, x AS (SELECT key, src, unnest({_lints('plain')}) AS kind, model FROM t WHERE plain IS NOT NULL),
g AS (SELECT model, kind, count(*) AS n, min(key) AS first, list(key ORDER BY key)[1:4] AS examples FROM x GROUP BY model, kind) SELECT model, kind, n, n >= 3 AS collapsed, first, examples FROM g""")
def warn_grouping(spark, d):
    """AGG-14, AGG-15: warnings of one kind collapsed with their first examples."""
    w = memo(spark, d).filter("plain is not null").select("model", F.explode(V.lints(F.col("plain"))).alias("kind"), F.col("key").alias("pos"), F.col("key").alias("msg"))
    return V.grouped(w, ["model", "kind"])


@query(rf"""WITH {MEMO} SELECT key, list_sort(string_split(regexp_replace(lower(src), '[^\p{{L}}\p{{N}}]', '', 'g'), '')) = list_sort(string_split(regexp_replace(lower(vi), '[^\p{{L}}\p{{N}}]', '', 'g'), '')) AS kept FROM t WHERE src IS NOT NULL AND vi IS NOT NULL""")
def multiset_kept(spark, d):
    """AGG-13, VER-14: equal multisets of letters and digits."""
    return memo(spark, d).filter("src is not null and vi is not null").select("key", V.same_characters(F.col("src"), F.col("vi")).alias("kept"))


@query(f"""WITH {CHUNKS} SELECT id, list_filter([CASE WHEN len(regexp_split_to_array(trim(text), '[ \\t\\n]+')) > 175 THEN 'words' END, CASE WHEN length(coalesce(title, '')) > 105 THEN 'headline' END, CASE WHEN len(string_split(text, chr(10))) > 5 THEN 'bullets' END], lambda x: x IS NOT NULL) AS over FROM c WHERE text IS NOT NULL AND level > 0""")
def slide_budget(spark, d):
    """VER-12 budgets: words, headline and bullets of a summary card."""
    c = chunks(spark, d).filter("text is not null and level > 0")
    over = F.array_compact(F.array(F.when(F.size(F.split(F.trim("text"), r"[ \t\n]+")) > 175, F.lit("words")), F.when(F.length(F.coalesce("title", F.lit(""))) > 105, F.lit("headline")), F.when(F.size(F.split("text", "\n")) > 5, F.lit("bullets"))))
    return c.select("id", over.alias("over"))


@query(rf"""WITH {PAPERS}, f AS (SELECT survey_id, sha256(string_agg(x, '|' ORDER BY x)) AS fp FROM (SELECT survey_id, id || ':' || CAST(epoch_us(updated_at) AS VARCHAR) || ':' || coalesce(status, '') AS x FROM p) GROUP BY survey_id)
SELECT survey_id, item_id, sha256(fp || '|' || lower(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')))) AS k FROM f JOIN eval_item ON item_id % 24 = CAST(substr(survey_id, 3) AS BIGINT) % 24""")
def question_memo(spark, d):
    """MEM-03, MEM-04: keys of questions under the present state of a corpus."""
    f = fingerprint(papers(spark, d)).withColumn("b", F.substring("survey_id", 3, 10).cast("long") % 24)
    e = table(spark, d, "eval_item").withColumn("b", F.col("item_id") % 24)
    return f.join(e, "b").select("survey_id", "item_id", M.question_key(F.col("fp"), F.col("text")).alias("k"))


@query("""WITH s AS (SELECT event_id, user_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events) SELECT event_id FROM s WHERE round(spent, 6) < 500""")
def budget_prefix(spark, d):
    """AGT-01: steps that start within a budget, by a running sum."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("value").alias("cost"))
    return M.within_budget(e, "user_id", ["ts", "event_id"], "cost", 500.0).select("event_id")


@query("""WITH r AS (SELECT user_id AS qid, day(ts)::INTEGER AS round, event_type AS id, max(CAST(value AS INTEGER)) AS grade FROM events GROUP BY ALL), f AS (SELECT *, min(round) OVER (PARTITION BY qid, id) AS fr FROM r)
SELECT qid, round, id, grade, place FROM (SELECT *, row_number() OVER (PARTITION BY qid, round ORDER BY grade DESC, id) AS place FROM f WHERE round = fr) WHERE place <= 2""")
def round_replay(spark, d):
    """AGT-02, RNK-09, SET-02: per round the best rows not seen in earlier ones are carried on."""
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("qid"), F.dayofmonth("ts").alias("round"), F.col("event_type").alias("id")).agg(F.max(F.rint("value").cast("int")).alias("grade"))
    return M.carry(r).select("qid", "round", "id", "grade", "place")


@query("SELECT user_id, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY user_id")
def usage_sums(spark, d):
    """AGG-08: summed usage."""
    return M.usage(table(spark, d, "events").withColumn("cost", F.col("value")), "user_id").withColumn("cost", F.round("cost", 4))


@query(r"""SELECT doc_id, left(array_to_string(string_split(trim(regexp_replace(title, '[ \t\n\r\f]+', ' ', 'g')), ' '), ' '), 1500) AS text FROM documents WHERE title IS NOT NULL AND trim(title) <> ''""")
def inverted_rebuild(spark, d):
    """SRC-07, SRC-08: texts rebuilt from their inverted indexes (built here from titles)."""
    w = table(spark, d, "documents").filter("title is not null and trim(title) <> ''").select("doc_id", F.posexplode(F.split(T.collapse(F.col("title")), " ")).alias("p", "w"))
    idx = w.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("idx"))
    return idx.select("doc_id", rebuild_inverted(F.col("idx")).alias("text"))


@query("SELECT event_id, props FROM events WHERE props IS NOT NULL")
def json_extract_safe(spark, d):
    """SRC-12: JSON found inside prose with a fence around it."""
    e = table(spark, d, "events").filter("props is not null")
    return e.select("event_id", F.concat(F.lit("Here it is [sic]:\n```json\n"), F.col("props"), F.lit("\n```\nDone}.")).alias("t")).select("event_id", R.json_in_text("t").alias("props"))


@query(rf"""WITH {CHUNKS} SELECT paper_id, id AS label, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM c WHERE level = 0 AND text IS NOT NULL AND trim(text) <> ''""")
def labelled_answers(spark, d):
    """SRC-13: labelled text of a paper cut into its labels again; the labels are those of the paper, whatever its passages hold."""
    form = F.element_at(F.array(*map(F.lit, ("<<<%s>>>", "<<%s>>", "### %s", "**%s**", "[%s]:"))), F.col("ord") % 5 + 1)
    c = chunks(spark, d, 0).filter("text is not null and trim(text) <> ''").select("paper_id", "ord", "id", "text", F.replace(form, F.lit("%s"), F.col("id")).alias("mark"))
    g = c.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "text", "mark"))).alias("l"))
    t = g.select("paper_id", F.array_join(F.transform("l", lambda x: F.concat(x.mark, F.lit("\n"), x.text)), "\n").alias("t"), F.transform("l", lambda x: x.id).alias("ids"))
    return R.labelled(t, "t", "ids")


@query(f"""WITH {PAPERS} SELECT '| ' || id || ' | ' || regexp_replace(replace(coalesce(title, ''), '|', '\\|'), '\\s*\\n\\s*', ' ', 'g') || ' | ' || coalesce(CAST(year AS VARCHAR), '') || ' |' AS line FROM p""")
def matrix_markdown(spark, d):
    """SNK-05: rows of a Markdown table."""
    return Snk.markdown_rows(papers(spark, d), ["id", "title", "year"])


@query(f"""WITH {BLOCKS}, l AS (SELECT doc, pos, CASE type WHEN 'title' THEN '# ' || text WHEN 'heading' THEN repeat('#', least(coalesce(level, 1), 3) + 1) || ' ' || text WHEN 'caption' THEN '*' || text || '*' WHEN 'equation' THEN '$$' || text || '$$' ELSE text END AS l FROM bl WHERE NOT coalesce(hidden, false))
SELECT doc, string_agg(l, chr(10) || chr(10) ORDER BY pos) AS md FROM l GROUP BY doc""")
def document_export(spark, d):
    """SNK-06: documents in reading order as Markdown."""
    return Snk.export_document(blocks(spark, d))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(spark, d):
    """2.12, beyond the reference: tumbling windows."""
    w = windowed(table(spark, d, "events"), "ts", "1 hour", ["event_type"])
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM events), g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(spark, d):
    """2.12, beyond the reference: sessions by gaps."""
    return sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))
