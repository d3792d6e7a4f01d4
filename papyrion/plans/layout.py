"""Kinds of blocks and page furniture, over the lines and paragraphs of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrion.operators import blocks as B
from papyrion.operators import classify as K
from papyrion.operators import geometry as G
from papyrion.plans.editing import BOXES, _spans
from papyrion.plans.relational import CHUNKS, chunks
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


LINES = "ln AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"


def lines(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def _q(s: str) -> str:
    return s.replace("'", "''")


def _words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"


def _appendix(c: str) -> str:
    t = f"trim({c})"
    return f"({t} <> '' AND length({t}) <= 90 AND {_words(t)} <= 12 AND (regexp_matches({t}, '{K.APPENDIX_WORD}') OR (NOT contains({t}, ',') AND NOT suffix({t}, '.') AND regexp_matches({t}, '{K.APPENDIX_NUMBER}'))))"


@query(f"WITH {LINES} SELECT doc_id, pos FROM ln WHERE {_appendix('text')}")
def appendix_heads(spark, d):
    """DOC-13: headings that end a reference list."""
    return lines(spark, d).filter(K.appendix_head(F.col("text"))).select("doc_id", "pos")


@query(f"WITH {LINES} SELECT doc_id, pos FROM ln WHERE length(text) > 180 AND length(regexp_replace(text, '[^0-9]', '', 'g')) <= 0.10 * length(text) AND (contains(text, '. ') OR suffix(rtrim(text), '.'))")
def prose_lines(spark, d):
    """DOC-14: running text rather than the body of a table."""
    return lines(spark, d).filter(K.prose(F.col("text"))).select("doc_id", "pos")


def _mathy(c: str) -> str:
    s, n = f"len(regexp_extract_all({c}, '{K.MATH}'))", f"length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g'))"
    return f"(length({c}) <= 400 AND (({s} >= 3 AND {s} > {n} / 12) OR (length({c}) < 90 AND {s} >= 2 AND {n} < 20)))"


@query(f"WITH {CHUNKS}, {BLOCKS} SELECT id, {_mathy('text')} AS mathy FROM c WHERE text IS NOT NULL UNION ALL SELECT doc || id, {_mathy('text')} FROM bl")
def mathy_texts(spark, d):
    """DOC-15: formulas among passages and blocks."""
    a = chunks(spark, d).filter("text is not null").select("id", "text")
    b = blocks(spark, d).select(F.concat("doc", "id").alias("id"), "text")
    return a.unionByName(b).select("id", K.mathy(F.col("text")).alias("mathy"))


def _level(c: str, rel: str, bold: str) -> str:
    t = f"trim({c})"
    low = f"regexp_replace(lower({t}), '[:.]+$', '')"
    exact, maybe = (", ".join(f"'{w}'" for w in x) for x in (K.SECTION_EXACT, K.SECTION_MAYBE))
    every = "[" + ", ".join(f"'{w} '" for w in K.SECTION_EXACT + K.SECTION_MAYBE) + "]"
    number = f"regexp_extract({t}, '{K.NUMBERED}', 1)"
    return f"""CASE WHEN {t} = '' OR length({t}) > 110 THEN 0 WHEN {low} IN ({exact}) THEN 1 WHEN {low} IN ({maybe}) THEN CASE WHEN {rel} >= 1.05 OR ({bold} AND {rel} >= 1.02) THEN 1 ELSE 0 END
WHEN {number} <> '' THEN CASE WHEN TRY_CAST(string_split({number}, '.')[1] AS INTEGER) > 40 THEN 0 ELSE least(length(regexp_replace({number}, '[^.]', '', 'g')) + 1, 3) END WHEN regexp_extract({t}, '{K.ROMAN}', 1) <> '' THEN 1
WHEN length({t}) < 60 AND len(list_filter({every}, lambda w: starts_with({low}, w))) > 0 THEN 1 WHEN {_words(t)} < 2 THEN 0 WHEN ({rel} >= 1.12 OR ({bold} AND {rel} >= 1.02)) AND NOT suffix({t}, '.') THEN CASE WHEN {rel} >= 1.25 THEN 1 ELSE 2 END ELSE 0 END"""


#: Type sizes and weights drawn from the places of the lines: no table holds glyphs.
@query(f"WITH {LINES}, z AS (SELECT *, round(0.9 + (pos % 6) * 0.08, 2) AS rel, pos % 2 = 1 AS bold FROM ln) SELECT doc_id, pos, {_level('text', 'rel', 'bold')} AS level FROM z")
def heading_levels(spark, d):
    """DOC-12: headings by name, number, type size and weight."""
    z = lines(spark, d).withColumn("rel", F.round(0.9 + (F.col("pos") % 6) * 0.08, 2)).withColumn("bold", F.col("pos") % 2 == 1)
    return z.select("doc_id", "pos", K.heading_level(F.col("text"), F.col("rel"), F.col("bold")).alias("level"))


def _reader_refs(c: str) -> str:
    t = f"trim({c})"
    v = f"len(regexp_extract_all({t}, '{K.READER_VENUE}'))"
    return f"(length({t}) >= 120 AND regexp_matches({t}, '{K.YEAR}') AND {v} >= 1 AND ({v} >= 3 OR regexp_matches({t}, '(?i)^\\s*(References|Tài liệu tham khảo|\\[\\d+\\])') OR len(regexp_extract_all({t}, '{K.READER_AUTHOR}')) >= 2))"


@query(f"WITH {LINES} SELECT doc_id, -1 AS pos, {_reader_refs('text')} AS refs FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, pos, {_reader_refs('text')} FROM ln")
def reader_reference_lists(spark, d):
    """DOC-07: lists of references by the reader's rule, over whole texts (place -1) and lines."""
    whole = table(spark, d, "documents").filter("text is not null").select("doc_id", F.lit(-1).alias("pos"), "text")
    return whole.unionByName(lines(spark, d)).select("doc_id", "pos", K.reader_refs(F.col("text")).alias("refs"))


_BARE = r"trim(regexp_replace(regexp_replace(trim(text), '[\^_]\{([^}]*)\}', '\1', 'g'), '^[\s\d*†‡§¶.)\]]+', ''))"


@query(rf"""WITH {LINES}, x AS (SELECT doc_id, pos, {_BARE} AS bare FROM ln WHERE trim(text) <> '')
SELECT doc_id, pos FROM x WHERE {_reader_refs("bare")} OR length(bare) < 12 OR regexp_matches(bare, '^[\s\d.,%()\[\]{{}}·•±+\-–—*/:;''"^_~$#@&|\\<>=]+$') OR (regexp_matches(bare, '[\w.+-]+@[\w-]+\.[\w.]{{2,}}') AND length(bare) < 220)
OR regexp_matches(bare, '\b\d{{4}}-\d{{4}}-\d{{4}}-\d{{3}}[\dX]\b') OR (regexp_matches(bare, '(?i)\b(University|Institute|Laborator|Academy|College|School of|Department of|Corresponding author|equal contribution|Our code|available at)\b') AND length(bare) < 200)""")
def noise_lines(spark, d):
    """DOC-08: lines not worth translating, with the reader's rule for references."""
    return lines(spark, d).filter("trim(text) <> ''").filter(B.is_noise(F.col("text"), K.reader_refs)).select("doc_id", "pos")


_JOINED = r"trim(regexp_replace(regexp_replace(regexp_replace(x, '([\p{L}\p{N}_])-[ \t]*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '\s*\n\s*', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"


@query(rf"""WITH x0 AS (SELECT CAST(doc_id AS VARCHAR) AS doc, list_filter(list_transform(regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\n\s*\n'), lambda x: {_JOINED}), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
x1 AS (SELECT doc, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS text FROM x0), x2 AS (SELECT *, pos = 0 AND length(text) < 200 AND NOT suffix(text, '.') AS ti FROM x1), x3 AS (SELECT *, regexp_matches(text, '{K.REFERENCES}') AND NOT ti AS st FROM x2),
x4 AS (SELECT *, coalesce(max(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inr, {_level('text', '1.0', 'false')} AS lv FROM x3),
x5 AS (SELECT *, CASE WHEN ti THEN 'title' WHEN st THEN 'heading' WHEN inr THEN 'reference' WHEN lv > 0 THEN 'heading' WHEN regexp_matches(text, '(?i)^\s*(figure|fig\.?|table|algorithm|listing)\s*\d+\s*([:.)\-–—]|$)') THEN 'caption' WHEN {_mathy('text')} THEN 'equation' ELSE 'para' END AS type FROM x4)
SELECT doc, pos, 'b' || CAST(pos + 1 AS VARCHAR) AS id, type, text, CASE WHEN type = 'reference' THEN 'References' WHEN type = 'title' THEN '' ELSE coalesce(last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), '') END AS section,
CASE WHEN st THEN 1 WHEN type = 'heading' THEN lv ELSE 0 END AS level, type IN ('para', 'caption') OR (type = 'heading' AND NOT st) AS translate FROM x5""")
def parse_text(spark, d):
    """SRC-03: pasted text cut at blank lines, with title, sections, references and formulas."""
    return K.typed_text(table(spark, d, "documents"), "doc_id", "text")


_SCRIPTS = "CASE WHEN pos % 7 = 3 THEN '_{' || id || '} ' || text WHEN pos % 7 = 4 THEN ' ^{2}' ELSE text END"


@query(rf"""WITH {BLOCKS}, s AS (SELECT doc, pos, page, {_SCRIPTS} AS text FROM bl), g AS (SELECT *, CASE WHEN regexp_matches(text, '^\s*[_^]\{{') AND lag(page) OVER (PARTITION BY doc ORDER BY pos) = page THEN 1 ELSE 0 END AS c FROM s),
i AS (SELECT *, sum(1 - c) OVER (PARTITION BY doc ORDER BY pos) AS isle FROM g), e AS (SELECT *, lead(c, 1, 0) OVER (PARTITION BY doc ORDER BY pos) AS more FROM i)
SELECT doc, min(pos) AS pos, string_agg(CASE WHEN more = 1 THEN rtrim(CASE WHEN c = 1 THEN ltrim(text) ELSE text END) WHEN c = 1 THEN ltrim(text) ELSE text END, '' ORDER BY pos) AS text, count(*) AS parts FROM e GROUP BY doc, isle""")
def stitch_scripts(spark, d):
    """DOC-11: blocks cut at a sub- or superscript glued again (the scripts are put in here)."""
    s = F.when(F.col("pos") % 7 == 3, F.concat(F.lit("_{"), "id", F.lit("} "), "text")).when(F.col("pos") % 7 == 4, F.lit(" ^{2}")).otherwise(F.col("text"))
    return K.script_runs(blocks(spark, d).withColumn("text", s))


@query()
def stitch_run_ons(spark, d):
    """DOC-10: paragraphs broken within a sentence, joined over floats."""
    return K.run_ons(blocks(spark, d))


_ITEM = rf"^\s*(?:([{K.BULLETS}])|(\(?\d{{1,2}}[.)])|(\([ivxIVX]{{1,4}}\)))\s+\S"


@query(rf"""WITH RECURSIVE {CHUNKS}, t AS (SELECT id, CASE ord % 3 WHEN 0 THEN replace(text, '. ', '.' || chr(10) || '• ') WHEN 1 THEN '1. ' || replace(text, chr(10), chr(10) || '2. ') ELSE text END AS text FROM c WHERE text IS NOT NULL AND level = 0),
l AS (SELECT id, unnest(range(len(x)))::INTEGER AS i, unnest(x) AS line FROM (SELECT id, string_split(text, chr(10)) AS x FROM t)),
s AS (SELECT *, regexp_extract(line, '{_ITEM}', 1) AS bullet, regexp_extract(line, '{_ITEM}', 2) AS number FROM l), n AS (SELECT *, CASE WHEN number <> '' THEN TRY_CAST(regexp_extract(number, '\d+', 0) AS INTEGER) END AS n, count(*) FILTER (WHERE bullet <> '') OVER (PARTITION BY id) AS bullets FROM s),
m AS (SELECT id, count(*) AS numbers, bool_and(coalesce(n = prev + 1, true)) AS runs FROM (SELECT id, n, lag(n) OVER (PARTITION BY id ORDER BY i) AS prev FROM n WHERE n IS NOT NULL) GROUP BY id),
j AS (SELECT n.*, CASE WHEN bullets >= 2 THEN bullet WHEN numbers >= 2 AND runs THEN number END AS marker FROM n LEFT JOIN m USING (id)), k AS (SELECT *, count(*) FILTER (WHERE marker <> '') OVER (PARTITION BY id ORDER BY i) AS no FROM j WHERE marker IS NOT NULL)
SELECT id, no, max(marker) AS marker, string_agg(CASE WHEN marker <> '' THEN regexp_replace(line, '^\s*(?:[{K.BULLETS}]|\(?\d{{1,2}}[.)]|\([ivxIVX]{{1,4}}\))\s+', '') ELSE line END, chr(10) ORDER BY i) AS text FROM k GROUP BY id, no""")
def list_items(spark, d):
    """DOC-17, WIN-12: items of lists; bullets and numbers are put into the passages here."""
    c = chunks(spark, d, 0).filter("text is not null")
    t = F.when(F.col("ord") % 3 == 0, F.replace("text", F.lit(". "), F.lit(".\n• "))).when(F.col("ord") % 3 == 1, F.concat(F.lit("1. "), F.replace("text", F.lit("\n"), F.lit("\n2. ")))).otherwise(F.col("text"))
    return K.list_items(c.select("id", t.alias("text")), "id", "text")


_ITEMS = f"""{BLOCKS}, pl AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc, page) AS n FROM bl), it AS (SELECT doc, id, page, text, CASE WHEN n = 1 THEN 400.0 WHEN k = 1 THEN 20.0 WHEN k = n THEN 760.0 ELSE 100.0 + 10 * k END AS y0 FROM pl)"""


@query(rf"""WITH {_ITEMS}, e AS (SELECT *, y0 + 12 < 792.0 * 0.09 OR y0 > 792.0 * 0.91 AS edge, lower(trim(regexp_replace(text, '\d+', '#', 'g'))) AS key FROM it),
o AS (SELECT doc, key FROM e WHERE edge AND NOT regexp_matches(text, '{K.JOURNAL}') AND length(key) > 3 GROUP BY doc, key HAVING count(DISTINCT page) >= 2)
SELECT DISTINCT doc, id FROM (SELECT e.doc, e.id FROM e JOIN o ON o.doc = e.doc AND o.key = e.key UNION ALL SELECT doc, id FROM e WHERE edge AND regexp_matches(text, '{K.JOURNAL}'))""")
def page_furniture(spark, d):
    """AGG-12: running headers and footers by page edge, repetition and what they name (heights are drawn from the places)."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc", "page")
    k, n = F.row_number().over(w.orderBy("pos")), F.count("*").over(w)
    y = F.when(F.col("n") == 1, 400.0).when(F.col("k") == 1, 20.0).when(F.col("k") == F.col("n"), 760.0).otherwise(100.0 + 10 * F.col("k"))
    it = blocks(spark, d).withColumn("k", k).withColumn("n", n).select("doc", "id", "page", "text", y.alias("y0"), (y + 12).alias("y1"), F.lit(None).cast("double").alias("page_h"))
    return K.page_furniture(it)


@query(f"""WITH {BOXES}, b AS (SELECT doc, arg_max(size, struct_pack(a := chars, b := -size)) AS body FROM (SELECT doc, round(size, 1) AS size, sum(length(text)) AS chars FROM span GROUP BY ALL) GROUP BY doc),
z AS (SELECT doc_id::VARCHAR AS doc, 0 AS z FROM documents LIMIT 0),
f AS (SELECT paper_id AS doc, row_number() OVER (PARTITION BY paper_id ORDER BY ord, id) AS pos, left(coalesce(section, '') || ' ' || coalesce(text, ''), 80) AS text, 9.0 + ord % 5 AS size FROM c WHERE level = 0),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS r FROM f WHERE NOT regexp_matches(text, '{K.STAMP}')) WHERE r <= 12), t AS (SELECT doc, arg_max(text, struct_pack(a := size, b := -pos)) AS title, max(size) AS size FROM g GROUP BY doc)
SELECT t.doc, t.title FROM t JOIN b ON b.doc = t.doc WHERE t.size > 1.25 * b.body""")
def page_titles(spark, d):
    """SORT-08: the largest block of the first ones as title (sizes are drawn from the places)."""
    from pyspark.sql import Window

    c = chunks(spark, d, 0)
    f = c.select(F.col("paper_id").alias("doc"), F.row_number().over(Window.partitionBy("paper_id").orderBy("ord", "id")).alias("pos"), F.left(F.concat(F.coalesce("section", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))), F.lit(80)).alias("text"), (9.0 + F.col("ord") % 5).alias("size"))
    return K.page_title(f, G.body_size(_spans(spark, d)))


@query(f"""WITH {BOXES}, w AS (SELECT doc, round(x1 - x0, 0) AS w, count(*) AS n FROM box GROUP BY ALL), m AS (SELECT doc, round(x0, 0) AS x, count(*) AS n FROM box GROUP BY ALL HAVING count(*) >= 3),
mm AS (SELECT doc, list(x ORDER BY n DESC, x)[1:6] AS margins FROM m GROUP BY doc), g AS (SELECT doc, round(y0 - lag(y1) OVER (PARTITION BY doc, page ORDER BY y0, box_id), 6) AS gap FROM box),
gg AS (SELECT doc, list(gap ORDER BY gap) AS l FROM g WHERE gap > 0 GROUP BY doc)
SELECT ww.doc, ww.width, coalesce(mm.margins, []) AS margins, gg.l[len(gg.l) // 2 + 1] AS gap FROM (SELECT doc, arg_max(w, struct_pack(a := n, b := -w)) AS width FROM w GROUP BY doc) ww LEFT JOIN mm USING (doc) LEFT JOIN gg USING (doc)""")
def page_stats(spark, d):
    """AGG-09: modal width, the six most frequent left margins, upper median of the gaps of each document's boxes."""
    from papyrion.plans.editing import _boxes

    return G.page_stats(_boxes(spark, d))


_AUTHORY = K.AUTHORY.replace("'", "''")


@query(rf"""WITH {LINES}, i0 AS (SELECT doc_id AS doc, pos, pos // 12 AS page, (pos % 12) * 66.0 AS y0, 9.0 + (pos % 5) * 0.5 AS size, pos % 3 = 0 AS bold, pos % 10 <> 9 AS body, CASE WHEN pos % 13 = 5 THEN '•' ELSE '' END AS marker, text FROM ln),
i1 AS (SELECT *, size / 10.0 AS rel FROM i0 WHERE trim(text) <> '' AND (body OR {_words('text')} > 12) AND NOT regexp_matches(text, '{K.PAGE_ONLY}') AND NOT regexp_matches(text, '{K.STAMP}')),
i2 AS (SELECT *, (y0 > 792.0 * 0.80 AND regexp_matches(text, '{K.FOOTNOTE}') AND length(text) < 400) OR (NOT (max(CASE WHEN starts_with(ltrim(lower(text)), 'abstract') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) = 1) AND page = 0 AND (regexp_matches(text, '{_AUTHORY}') OR (length(text) < 60 AND {_words('text')} <= 6))) AS me FROM i1),
i3 AS (SELECT *, NOT me AND regexp_matches(text, '{K.REFERENCES}') AS st FROM i2), i4 AS (SELECT *, NOT me AND NOT st AND rel >= 1.02 AND {_appendix('text')} AS ap FROM i3),
i5 AS (SELECT *, coalesce(last_value(CASE WHEN st THEN 1 WHEN ap THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inr FROM i4), i6 AS (SELECT * REPLACE (ap AND inr AS ap), {_level('text', 'rel', 'bold')} AS lv FROM i5),
i7 AS (SELECT *, CASE WHEN me THEN 'meta' WHEN st OR ap THEN 'heading' WHEN inr THEN 'reference' WHEN regexp_matches(text, '(?i)^\s*(figure|fig\.?|table|algorithm|listing)\s*\d+\s*([:.)\-–—]|$)') THEN 'caption' WHEN {_mathy('text')} THEN 'equation' WHEN lv > 0 THEN 'heading' ELSE 'para' END AS type FROM i6),
i8 AS (SELECT *, CASE WHEN type <> 'heading' THEN 0 WHEN st THEN 1 WHEN ap THEN least(length(regexp_replace(regexp_extract(text, '{K.APPENDIX_LEVEL}', 1), '[^.]', '', 'g')) + 1, 3) ELSE lv END AS level,
 CASE WHEN type = 'reference' THEN 'References' WHEN me AND page = 0 THEN '' ELSE coalesce(last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), '') END AS section FROM i7),
i9 AS (SELECT *, CASE WHEN type = 'para' AND lag(type) OVER w = 'para' AND lag(section) OVER w = section AND marker = '' AND lag(marker) OVER w = '' AND NOT regexp_matches(lag(text) OVER w, '[.!?:;][''")\]]?$') AND regexp_matches(text, '{K.GOES_ON}') THEN 1 ELSE 0 END AS c FROM i8 WINDOW w AS (PARTITION BY doc ORDER BY pos)),
ia AS (SELECT *, sum(1 - c) OVER (PARTITION BY doc ORDER BY pos) AS isle FROM i9)
SELECT doc, min(pos) AS pos, arg_min(type, pos) AS type, string_agg(text, ' ' ORDER BY pos) AS text, arg_min(section, pos) AS section, arg_min(level, pos) AS level, arg_min(type IN ('para', 'caption') OR (type = 'heading' AND NOT st), pos) AS translate FROM ia GROUP BY doc, isle HAVING length(string_agg(text, ' ' ORDER BY pos)) > 1""")
def blocks_of_items(spark, d):
    """DOC-16: laid-out items as typed blocks, broken paragraphs joined (places and type sizes are drawn from the lines' numbers)."""
    p = F.col("pos")
    it = lines(spark, d).select(F.col("doc_id").alias("doc"), "pos", F.floor(p / 12).cast("int").alias("page"), F.lit(None).cast("double").alias("page_h"), ((p % 12) * 66.0).alias("y0"), (9.0 + (p % 5) * 0.5).alias("size"), F.lit(10.0).alias("modal"), (p % 3 == 0).alias("bold"), (p % 10 != 9).alias("body"), F.when(p % 13 == 5, "•").otherwise("").alias("marker"), "text")
    return K.blocks_of_items(it)


#: Runs drawn from the lines: two columns on every other page, a wide gap after each seventh line; every third line lies in a box.
_RUNS = f"""{LINES}, sp AS (SELECT doc_id AS doc, pos // 40 AS page, pos AS span_id, 600.0 AS page_w, CASE WHEN (pos // 40) % 2 = 0 AND pos % 2 = 1 THEN 320.0 ELSE 40.0 END AS x0, CASE WHEN (pos // 40) % 2 = 0 THEN CASE WHEN pos % 2 = 1 THEN 560.0 ELSE 280.0 END ELSE 560.0 END AS x1, ((pos % 40) // 2) * 14.0 + ((pos % 40) // 14) * 60.0 AS y0, text FROM ln WHERE pos % 3 <> 0 AND trim(text) <> ''),
lp0 AS (SELECT *, count(*) FILTER (WHERE x0 < page_w / 2 - page_w * 0.02 AND x1 > page_w / 2 + page_w * 0.02) OVER w <= greatest(2.0, count(*) OVER w * 0.10) AND count(*) FILTER (WHERE x1 <= page_w / 2) OVER w > 0 AND count(*) FILTER (WHERE x0 >= page_w / 2) OVER w > 0 AS two FROM sp WINDOW w AS (PARTITION BY doc, page)),
lp1 AS (SELECT *, CASE WHEN two AND (x0 + x1) / 2 >= page_w / 2 THEN 1 ELSE 0 END AS col FROM lp0), lp2 AS (SELECT doc, page, col, round(y0, 0) AS line, min(y0) AS y0, max(y0 + 10) AS y1, string_agg(text, ' ' ORDER BY x0, span_id) AS text FROM lp1 GROUP BY doc, page, col, round(y0, 0)),
lp3 AS (SELECT *, CASE WHEN coalesce(y0 - lag(y1) OVER v >= 0 AND y0 - lag(y1) OVER v <= greatest(y1 - y0, lag(y1 - y0) OVER v) * 1.6, false) THEN 0 ELSE 1 END AS n FROM lp2 WINDOW v AS (PARTITION BY doc, page, col ORDER BY y0, line)), lp4 AS (SELECT *, sum(n) OVER (PARTITION BY doc, page, col ORDER BY y0, line) AS para FROM lp3),
lp AS (SELECT doc, page, col, para, min(y0) AS y0, string_agg(text, ' ' ORDER BY y0, line) AS text, count(*) AS lines FROM lp4 GROUP BY doc, page, col, para)"""


def _runs(spark, d):
    p = F.col("pos")
    two = F.floor(p / 40) % 2 == 0
    x = lines(spark, d).filter("pos % 3 <> 0 and trim(text) <> ''")
    y = F.floor((p % 40) / 2) * 14.0 + F.floor((p % 40) / 14) * 60.0
    return x.select(F.col("doc_id").alias("doc"), F.floor(p / 40).cast("int").alias("page"), p.alias("span_id"), F.lit(600.0).alias("page_w"), F.when(two & (p % 2 == 1), 320.0).otherwise(40.0).alias("x0"), F.when(two, F.when(p % 2 == 1, 560.0).otherwise(280.0)).otherwise(560.0).alias("x1"), y.alias("y0"), (y + 10).alias("y1"), "text")


@query(f"WITH {_RUNS} SELECT doc, page, col, para, text, lines FROM lp")
def loose_paragraphs(spark, d):
    """DOC-19: runs outside all boxes as columns, lines and paragraphs."""
    return G.loose_paragraphs(_runs(spark, d)).drop("y0")


@query(f"WITH {_RUNS}, t AS (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t FROM lp) SELECT doc, page, col, para, t AS text FROM t WHERE length(t) >= 60 AND length(t) > 180 AND length(regexp_replace(t, '[^0-9]', '', 'g')) <= 0.10 * length(t) AND (contains(t, '. ') OR suffix(t, '.'))")
def paragraphs_recovered(spark, d):
    """DOC-20: of what no box holds, the paragraphs that read like prose."""
    from papyrion.functions.text import collapse

    p = G.loose_paragraphs(_runs(spark, d)).withColumn("text", collapse(F.col("text")))
    return p.filter((F.length("text") >= 60) & K.prose(F.col("text"))).select("doc", "page", "col", "para", "text")
