"""What comes in from services and goes out to files: web rows, plans, tables of cells, event frames, keyed replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import collapse

#: Facets of a new corpus, in order (fixed values).
FACETS = ("tldr_vi", "task", "idea", "method", "datasets", "metrics", "results", "baselines", "limitations")
#: An identifier of a preprint server, the shapes of web answers, most sub-questions, queries and terms of a plan (fixed values).
PREPRINT_ID = r"(\d{4}\.\d{4,5}(?:v\d+)?)"
BRAVE = "struct<web:struct<results:array<struct<title:string,url:string,description:string>>>>"
TAVILY = "struct<results:array<struct<title:string,url:string,content:string>>>"
SERPER = "struct<organic:array<struct<title:string,link:string,snippet:string>>>"
PLAN = "struct<sub_questions:array<struct<id:string,ask:string,need:string>>,queries:array<struct<q:string,`for`:string>>,must_terms_en:array<string>,intent:string,pseudo_doc:string>"
OPEN_INDEX = "struct<doi:string,title:string,publication_year:int,cited_by_count:int,abstract_inverted_index:map<string,array<int>>>"
COLUMNS = ("en", "vi", "gl")
COLOURS = ("y", "g", "b", "p")


def is_pdf(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return low.endswith(".pdf") | low.contains("/pdf/")


def web_rows(answers: DataFrame, provider: str, json_col: str) -> DataFrame:
    """(title, url, pdf_url, abstract) of one provider's answers; broken JSON gives no rows."""
    schema, path, url, text = {"brave": (BRAVE, "r.web.results", "url", "description"), "tavily": (TAVILY, "r.results", "url", "content"), "serper": (SERPER, "r.organic", "link", "snippet")}[provider]
    x = answers.select(F.from_json(json_col, schema).alias("r")).select(F.explode(path).alias("x"))
    u = F.coalesce(F.col("x")[url], F.lit(""))
    return x.select(F.left(F.coalesce("x.title", F.lit("")), F.lit(300)).alias("title"), u.alias("url"), F.when(is_pdf(u), u).otherwise("").alias("pdf_url"), F.left(F.coalesce(F.col("x")[text], F.lit("")), F.lit(1000)).alias("abstract"))


def clean_plan(df: DataFrame, id_col: str, question: str, json_col: str) -> DataFrame:
    """(id, subs, queries, terms): a plan in shape, whatever the model said.

    Sub-questions without a question go, the question itself stands for none; the question is among the
    queries; at most 5 sub-questions, 8 queries and 12 terms. JSON that can't be read is an empty plan.
    """
    p = df.select(F.col(id_col).alias("id"), F.col(question).alias("q"), F.from_json(json_col, PLAN).alias("p"))
    subs = F.transform(F.coalesce("p.sub_questions", F.array().cast("array<struct<id:string,ask:string,need:string>>")), lambda s, i: F.struct(F.coalesce(F.when(s.id != "", s.id), F.concat(F.lit("q"), (i + 1).cast("string"))).alias("id"), F.trim(F.coalesce(s.ask, F.lit(""))).alias("ask")))
    subs = F.filter(subs, lambda s: s.ask != "")
    subs = F.when(F.size(subs) == 0, F.array(F.struct(F.lit("q1").alias("id"), F.col("q").alias("ask")))).otherwise(subs)
    asked = F.filter(F.transform(F.coalesce("p.queries", F.array().cast("array<struct<q:string,`for`:string>>")), lambda x: F.trim(F.coalesce(x.q, F.lit("")))), lambda x: x != "")
    own = F.exists(asked, lambda x: F.lower(x) == F.lower(F.trim("q")))
    asked = F.when(own, asked).otherwise(F.concat(F.array("q"), asked))
    return p.select("id", F.slice(subs, 1, 5).alias("subs"), F.slice(asked, 1, 8).alias("queries"), F.slice(F.coalesce("p.must_terms_en", F.array().cast("array<string>")), 1, 12).alias("terms"))


def csv_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_rows(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(",", *(csv_cell(F.col(c)) for c in columns))


def event_frame(name: Column, data: Column) -> Column:
    """One frame of an event stream."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), data, F.lit("\n\n"))


def put_leaves(chunk: DataFrame, new: DataFrame) -> DataFrame:
    """Passages after the leaves of papers were replaced; the trees above them go, since they no longer hold."""
    return chunk.join(new.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(new, allowMissingColumns=True)


def put_summaries(chunk: DataFrame, new: DataFrame) -> DataFrame:
    """Passages after the summaries of papers were replaced; leaves stay."""
    gone = new.select("paper_id").distinct().withColumn("_x", F.lit(True))
    kept = chunk.join(gone, "paper_id", "left").filter(F.col("_x").isNull() | (F.col("level") == 0)).drop("_x")
    return kept.unionByName(new, allowMissingColumns=True)


def whitelisted(rows: DataFrame, patch: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Rows with the values of a patch (key, field, value) for allowed text fields; the last of each field by ``no`` wins."""
    p = patch.filter(F.col("field").isin(*allowed)).groupBy(key).agg(*(F.max_by("value", F.when(F.col("field") == f, F.col("no"))).alias(f"_{f}") for f in allowed), *(F.max(F.col("field") == f).alias(f"_has_{f}") for f in allowed))
    j = rows.join(p, key, "left")
    return j.withColumns({f: F.when(F.coalesce(f"_has_{f}", F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)) for f in allowed}).drop(*(f"_{f}" for f in allowed), *(f"_has_{f}" for f in allowed))


def translations_of(chunk: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, vi): the translations of a passage's lines that are blocks, in line order; blocks (paper_id, text, vi), joined by normalised text."""
    b = blocks.filter("coalesce(vi, '') <> ''").select("paper_id", collapse(F.col("text")).alias("k"), "vi").filter("k <> ''").groupBy("paper_id", "k").agg(F.max("vi").alias("vi"))
    line = chunk.filter("text is not null").select("id", "paper_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).withColumn("k", collapse(F.col("l")))
    return line.join(b, ["paper_id", "k"]).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "vi"))), lambda x: x.vi), "\n").alias("vi"))


def highlights_after(marks: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc, block, id, col, start, end, note) after (doc, no, action, ...) edits, in the order of column and start.

    Empty ranges are refused, unknown columns become the translation's; ids go on from the highest; an update
    sets the note of its id, a drop removes it, the last of each by ``no`` wins.
    """
    top = marks.groupBy("doc").agg(F.max(F.regexp_extract("id", r"^h(\d+)$", 1).try_cast("int")).alias("_top"))
    from pyspark.sql import Window

    ok = edits.filter("action = 'add' and end > start").join(top, "doc", "left")
    n = F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy("doc").orderBy("no"))
    new = ok.select("doc", "block", F.concat(F.lit("h"), n.cast("string")).alias("id"), F.when(F.col("col").isin(*COLUMNS), F.col("col")).otherwise("vi").alias("col"), "start", "end", "note")
    e = edits.filter("action in ('update', 'drop')").groupBy("doc", "id").agg(F.max_by("note", F.when(F.col("action") == "update", F.col("no"))).alias("_note"), F.max((F.col("action") == "drop").cast("int")).alias("_drop"))
    kept = marks.join(e, ["doc", "id"], "left").filter(F.coalesce("_drop", F.lit(0)) == 0).withColumn("note", F.coalesce("_note", "note")).select(*new.columns)
    return kept.unionByName(new).withColumn("place", F.row_number().over(Window.partitionBy("doc", "block").orderBy("col", "start", "id")))


def slides_after(deck: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc, place, id): a deck (doc, pos, id) after (doc, id, action, to) edits: drop, duplicate (behind the original), move (to a place), renumbered."""
    from pyspark.sql import Window

    e = edits.groupBy("doc", "id").agg(F.max(F.when(F.col("action") == "drop", 1)).alias("_drop"), F.max(F.when(F.col("action") == "duplicate", 1)).alias("_twice"), F.max(F.when(F.col("action") == "move", F.col("to"))).alias("_to"))
    j = deck.join(e, ["doc", "id"], "left").filter("_drop is null")
    at = F.coalesce(F.col("_to") - 0.5, F.col("pos").cast("double"))
    copies = F.when(F.col("_twice") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = j.select("doc", "id", at.alias("at"), F.explode(copies).alias("k"))
    return x.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("at", "id", "k")).alias("place"), F.when(F.col("k") == 1, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"))
