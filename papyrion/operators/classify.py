"""Kinds of blocks by rule: headings, appendices, prose, formulas, captions, lists; plain text as typed blocks.

All rules are column expressions; what carries state (the section, the reference list) is a window over
one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import collapse
from papyrion.operators.blocks import CAPTION

#: Names that are always sections, and names that are only in larger type (fixed values).
SECTION_EXACT = (
    "abstract", "introduction", "background", "related work", "preliminaries", "methodology", "experiments", "experimental setup", "results", "evaluation",
    "discussion", "limitations", "conclusion", "conclusions", "future work", "acknowledgments", "acknowledgements", "references", "bibliography", "appendix",
)
SECTION_MAYBE = ("method", "methods", "approach", "model", "models", "architecture", "experiment", "setup", "analysis", "ablation", "ablations", "dataset", "datasets", "baseline", "baselines", "task", "tasks")
#: Patterns of numbered headings, appendices, references, symbols and stamps (fixed values).
NUMBERED = r"^\s*(\d+(?:\.\d+)*)\.?\s+([A-Z][^.]{2,80})\s*$"
ROMAN = r"^\s*([IVXLC]+)\.?\s+([A-Z][^.]{2,80})\s*$"
APPENDIX_WORD = r"(?i)^\s*(?:appendix|phụ\s*lục)\b"
APPENDIX_NUMBER = r"^\s*[A-Z](?:\.\d+)*\s+[A-Z][A-Za-z]"
REFERENCES = r"(?i)^\s*(references|bibliography)\s*$"
MATH = "[=∑∏∫∂∇≤≥≈≠±×÷√∈∉⊆⊂∪∩∀∃→←↔⇒⇔·∘⊙⊗‖⟨⟩−∼≜≡αβγδεζηθικλμνξπρσςτυφχψωΓΔΘΛΞΠΣΦΨΩ]"
STAMP = r"(?i)^\s*(arxiv:|doi:|preprint|under review|published as|\d{4} ieee|acm isbn)"
PAGE_ONLY = r"^[\d\s\-–|]{1,12}$"
READER_VENUE = r"(?i)\b(In Proceedings|Proceedings of|arXiv:|arXiv preprint|Advances in Neural|Transactions on|Journal of|Conference on|Springer|Elsevier|ACM |IEEE |pp\.\s*\d|doi:|PMLR|NeurIPS|ICLR|ICML|ACL|EMNLP|NAACL|CVPR|ICCV|ECCV)"
READER_AUTHOR = r"[A-Z][a-zÀ-ỹ]+,\s*[A-Z]\."
YEAR = r"\b(19|20)\d{2}\b"
BULLETS = "•‣▪◦∙"
ITEM = rf"^\s*(?:([{BULLETS}])|(\(?\d{{1,2}}[.)])|(\([ivxIVX]{{1,4}}\)))\s+(?=\S)"


def words_in(c: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def appendix_head(c: Column) -> Column:
    """A heading that ends a reference list; strict, since entries look alike."""
    t = F.trim(c)
    short = (t != "") & (F.length(t) <= 90) & (words_in(t) <= 12)
    return short & (t.rlike(APPENDIX_WORD) | (~t.contains(",") & ~t.endswith(".") & t.rlike(APPENDIX_NUMBER)))


def prose(c: Column) -> Column:
    """Running text rather than the body of a table: long, few digits, an end of a sentence."""
    digits = F.length(F.regexp_replace(c, r"[^0-9]", ""))
    return (F.length(c) > 180) & (digits <= 0.10 * F.length(c)) & (c.contains(". ") | F.rtrim(c).endswith("."))


def mathy(c: Column) -> Column:
    """A formula: many symbols for its letters."""
    symbols = F.regexp_count(c, F.lit(MATH))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (F.length(c) <= 400) & (((symbols >= 3) & (symbols > letters / 12)) | ((F.length(c) < 90) & (symbols >= 2) & (letters < 20)))


def heading_level(c: Column, rel: Column, bold: Column) -> Column:
    """Level of a heading, 0 for what is none; ``rel``: its type size relative to the body's."""
    t = F.trim(c)
    low = F.regexp_replace(F.lower(t), "[:.]+$", "")
    number = F.regexp_extract(t, NUMBERED, 1)
    roman = F.regexp_extract(t, ROMAN, 1)
    first = F.split(number, r"\.")[0].try_cast("int")
    depth = F.least(F.length(F.regexp_replace(number, r"[^.]", "")) + 1, F.lit(3))
    larger = (rel >= 1.05) | (bold & (rel >= 1.02))
    named = F.exists(F.array(*(F.lit(w + " ") for w in SECTION_EXACT + SECTION_MAYBE)), lambda w: F.startswith(low, w)) & (F.length(t) < 60)
    big = ((rel >= 1.12) | (bold & (rel >= 1.02))) & ~t.endswith(".")
    return (
        F.when((t == "") | (F.length(t) > 110), 0)
        .when(low.isin(*SECTION_EXACT), 1)
        .when(low.isin(*SECTION_MAYBE), F.when(larger, 1).otherwise(0))
        .when(number != "", F.when(first > 40, 0).otherwise(depth))
        .when(roman != "", 1)
        .when(named, 1)
        .when(words_in(t) < 2, 0)
        .when(big, F.when(rel >= 1.25, 1).otherwise(2))
        .otherwise(0)
    )


def reader_refs(c: Column) -> Column:
    """A list of references as the reader sees it: a year and a venue, and three venues, an entry's start or two authors."""
    t = F.trim(c)
    venues = F.regexp_count(t, F.lit(READER_VENUE))
    return (F.length(t) >= 120) & t.rlike(YEAR) & (venues >= 1) & ((venues >= 3) | t.rlike(r"(?i)^\s*(References|Tài liệu tham khảo|\[\d+\])") | (F.regexp_count(t, F.lit(READER_AUTHOR)) >= 2))


def typed_text(raw: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, pos, id, type, text, section, level, translate): pasted text cut at blank lines, as typed blocks.

    Broken words and lines within a paragraph are joined. A short first paragraph without a full stop is
    the title; after a references heading everything is a reference; the section is the last heading. Null
    and blank texts give nothing.
    """
    joined = lambda x: collapse(F.regexp_replace(F.regexp_replace(x, r"(?U)(\w)-[ \t]*\n\s*(\w)", "$1$2"), r"\s*\n\s*", " "))
    parts = F.filter(F.transform(F.split(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")), r"\n\s*\n"), lambda x: joined(x)), lambda x: x != "")
    p = raw.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc"), F.posexplode(parts).alias("pos", "text"))
    t = F.col("text")
    w = Window.partitionBy("doc").orderBy("pos")
    title = (F.col("pos") == 0) & (F.length(t) < 200) & ~t.endswith(".")
    start = t.rlike(REFERENCES) & ~title
    p = p.withColumn("_title", title).withColumn("_start", start)
    p = p.withColumn("_in", F.coalesce(F.max(F.col("_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    level = heading_level(t, F.lit(1.0), F.lit(False))
    kind = F.when(F.col("_title"), "title").when(F.col("_start"), "heading").when(F.col("_in"), "reference").when(level > 0, "heading").when(t.rlike(CAPTION), "caption").when(mathy(t), "equation").otherwise("para")
    p = p.withColumn("type", kind).withColumn("level", F.when(F.col("_start"), 1).when(F.col("type") == "heading", level).otherwise(0))
    section = F.when(F.col("type") == "reference", "References").when(F.col("type") == "title", "").otherwise(F.coalesce(F.last(F.when(F.col("type") == "heading", t), True).over(w), F.lit("")))
    translate = F.col("type").isin("para", "caption") | ((F.col("type") == "heading") & ~F.col("_start"))
    return p.select("doc", "pos", F.concat(F.lit("b"), (F.col("pos") + 1).cast("string")).alias("id"), "type", "text", section.alias("section"), "level", translate.alias("translate"))


def script_runs(b: DataFrame) -> DataFrame:
    """(doc, pos, text, parts): blocks that begin with a sub- or superscript glued to the block before on the same page."""
    w = Window.partitionBy("doc").orderBy("pos")
    goes_on = F.col("text").rlike(r"^\s*[_^]\{") & (F.lag("page").over(w) == F.col("page"))
    x = b.withColumn("_c", F.coalesce(goes_on, F.lit(False)).cast("int")).withColumn("_i", F.sum(1 - F.col("_c")).over(w))
    g = x.groupBy("doc", "_i").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    joined = F.aggregate(F.slice("l", 2, 1_000_000), F.element_at("l", 1)["text"], lambda s, i: F.concat(F.rtrim(s), F.ltrim(i.text)))
    return g.select("doc", "pos", joined.alias("text"), F.size("l").alias("parts"))


FLOATS = ("caption", "figure", "table")


def run_ons(b: DataFrame, most: int = 2) -> DataFrame:
    """(doc, pos, text, parts): paragraphs broken within a sentence joined with a blank, over at most two floats in all.

    A fold over the kinds and ends of a document's blocks numbers the runs; it carries no text.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    para = (F.col("type") == "para") & ~F.coalesce("hidden", F.lit(False)) & (t != "")
    open_end = ~t.rlike(r"[.!?:;)\]\"'’”]$") & ~t.rlike(r"[A-Za-zÀ-ỹ]{2}-$")
    kind = F.when(para, 0).when(F.col("type").isin(*FLOATS), 1).otherwise(2)
    l = b.select("doc", F.struct("pos", kind.alias("k"), open_end.alias("open"), t.rlike("^[a-zà-ỹ]").alias("low")).alias("x")).groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("l"))
    zero = F.struct(F.lit(0).alias("no"), F.lit(False).alias("open"), F.lit(0).alias("floats"), F.array().cast("array<struct<pos:int,no:int>>").alias("out"))

    def step(s, e):
        goes_on = (e.k == 0) & s.open & e.low & (s.floats <= most)
        no = F.when((e.k == 0) & ~goes_on, s.no + 1).otherwise(s.no).cast("int")
        open_ = F.when(e.k == 0, e.open).when(e.k == 1, s.open).otherwise(False)
        floats = F.when(e.k == 0, F.when(goes_on, s.floats).otherwise(0)).otherwise(s.floats + 1).cast("int")
        return F.struct(no.alias("no"), open_.alias("open"), floats.alias("floats"), F.when(e.k == 0, F.concat(s.out, F.array(F.struct(e.pos.alias("pos"), no.alias("no"))))).otherwise(s.out).alias("out"))

    runs = l.select("doc", F.explode(F.aggregate("l", zero, step, lambda s: s.out)).alias("x")).select("doc", "x.pos", "x.no")
    g = b.select("doc", "pos", t.alias("t")).join(runs, ["doc", "pos"]).groupBy("doc", "no").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("l"))
    return g.select("doc", F.element_at("l", 1)["pos"].alias("pos"), F.array_join(F.transform("l", lambda i: i.t), " ").alias("text"), F.size("l").alias("parts"))


def list_items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, marker, text): the items of texts that are lists; what comes before the first has number 0 and no marker.

    A list has two bullets, or two numbers that run on by one; roman numbers alone make none.
    """
    line = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("i", "line"))
    pick = lambda g: F.regexp_extract("line", ITEM, g)
    s = line.withColumn("bullet", pick(1)).withColumn("number", pick(2))
    w = Window.partitionBy("id")
    n = F.regexp_extract("number", r"\d+", 0).try_cast("int")
    s = s.withColumn("n", F.when(F.col("number") != "", n)).withColumn("bullets", F.count_if(F.col("bullet") != "").over(w))
    first, last, count = F.min(F.struct("i", "n")), F.max(F.struct("i", "n")), F.count("n")
    marks = s.filter("n is not null").withColumn("prev", F.lag("n").over(w.orderBy("i"))).groupBy("id").agg(count.alias("numbers"), F.bool_and(F.coalesce(F.col("n") == F.col("prev") + 1, F.lit(True))).alias("runs"))
    j = s.join(marks, "id", "left")
    kind = F.when(F.col("bullets") >= 2, 1).when((F.col("numbers") >= 2) & F.col("runs"), 2)
    j = j.withColumn("kind", kind).filter("kind is not null")
    marker = F.when(F.col("kind") == 1, F.col("bullet")).otherwise(F.col("number"))
    j = j.withColumn("marker", marker).withColumn("no", F.count_if(F.col("marker") != "").over(w.orderBy("i")))
    body = F.when(F.col("marker") != "", F.regexp_replace("line", ITEM, "")).otherwise(F.col("line"))
    g = j.groupBy("id", "no").agg(F.max("marker").alias("marker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", body.alias("t")))), lambda x: x.t), "\n").alias("text"))
    return g


def page_title(spans: DataFrame, body: DataFrame, most: int = 12) -> DataFrame:
    """(doc, title): the largest of the first blocks of the first page, where it is a quarter larger than the body; stamps are none."""
    w = Window.partitionBy("doc").orderBy("pos")
    first = spans.filter(~F.col("text").rlike(STAMP)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    top = first.groupBy("doc").agg(F.max_by(F.struct("text", "size"), F.struct("size", -F.col("pos"))).alias("x"))
    return top.join(body.select("doc", F.col("size").alias("body")), "doc").filter(F.col("x.size") > 1.25 * F.col("body")).select("doc", F.col("x.text").alias("title"))


JOURNAL = r"(?i)(proceedings of the|annual meeting of the|association for computational linguistics|©\s*\d{4}|\(c\)\s*\d{4}|all rights reserved|licensed under|creative commons|conference on|workshop on|advances in neural information|\bpages?\s+\d+[-–]\d+|permission to make digital|isbn\s|issn\s)"


def page_furniture(items: DataFrame, edge: float = 0.09) -> DataFrame:
    """(doc, id): blocks that run through a document, of (doc, id, page, page_h, y0, y1, text).

    Digit-masked lines at the top or bottom of two pages mark all their like; what names a venue or a
    licence at an edge is furniture by itself.
    """
    h = F.coalesce("page_h", F.lit(792.0))
    x = items.withColumn("_edge", (F.col("y1") < h * edge) | (F.col("y0") > h * (1 - edge))).withColumn("_key", F.lower(F.trim(F.regexp_replace("text", r"\d+", "#"))))
    often = x.filter(F.col("_edge") & ~F.col("text").rlike(JOURNAL) & (F.length("_key") > 3)).groupBy("doc", "_key").agg(F.count_distinct("page").alias("n")).filter("n >= 2").select("doc", "_key")
    by_key = x.join(often, ["doc", "_key"], "left_semi").select("doc", "id")
    return by_key.unionByName(x.filter(F.col("_edge") & F.col("text").rlike(JOURNAL)).select("doc", "id")).distinct()


#: What begins a footnote, what only the head of a first page says, levels of appendices, ends and beginnings within a sentence (fixed values).
FOOTNOTE = r"^\s*(?:[*†‡§¶]|\d{1,2}[A-Z])"
AUTHORY = r"(?i)@|\b(university|universit[ée]|institute|research|labs?|inc\.|corp\.|google|microsoft|meta|openai|deepmind|college|school of|department)\b"
APPENDIX_LEVEL = r"^\s*(\d+(?:\.\d+)*)"
CLOSED = r"[.!?:;]['\")\]]?$"
GOES_ON = r"^[a-z0-9(\[)\]]"


def blocks_of_items(items: DataFrame) -> DataFrame:
    """(doc, pos, type, text, section, level, translate) of laid-out items (doc, pos, page, page_h, y0, size, modal, bold, body, marker, text).

    What is no text goes (page numbers, stamps, short labels of pictures); footnotes and the head of the
    first page are meta; a references heading opens the list that an appendix closes; then captions,
    formulas and headings. A paragraph that goes on within a sentence is joined to the one before, unless
    either is an item of a list. Rules are one CASE, latches and joins windows over a document.
    """
    t = F.col("text")
    w = Window.partitionBy("doc").orderBy("pos")
    h = F.coalesce("page_h", F.lit(792.0))
    x = items.filter((F.trim(F.coalesce(t, F.lit(""))) != "") & (F.col("body") | (words_in(t) > 12)) & ~t.rlike(PAGE_ONLY) & ~t.rlike(STAMP))
    x = x.withColumn("rel", F.when(F.col("modal") > 0, F.col("size") / F.col("modal")).otherwise(1.0))
    seen = F.max(F.startswith(F.ltrim(F.lower(t)), F.lit("abstract")).cast("int")).over(w) == 1
    note = (F.col("y0") > h * 0.80) & t.rlike(FOOTNOTE) & (F.length(t) < 400)
    front = ~seen & (F.col("page") == 0) & (t.rlike(AUTHORY) | ((F.length(t) < 60) & (words_in(t) <= 6)))
    x = x.withColumn("_meta", note | front).withColumn("_start", ~F.col("_meta") & t.rlike(REFERENCES)).withColumn("_app", ~F.col("_meta") & ~F.col("_start") & (F.col("rel") >= 1.02) & appendix_head(t))
    event = F.when(F.col("_start"), 1).when(F.col("_app"), 0)
    inside = F.coalesce(F.last(event, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    x = x.withColumn("_in", inside).withColumn("_app", F.col("_app") & F.col("_in"))
    level = heading_level(t, F.col("rel"), F.col("bold"))
    kind = F.when(F.col("_meta"), "meta").when(F.col("_start") | F.col("_app"), "heading").when(F.col("_in"), "reference").when(t.rlike(CAPTION), "caption").when(mathy(t), "equation").when(level > 0, "heading").otherwise("para")
    dots = F.length(F.regexp_replace(F.regexp_extract(t, APPENDIX_LEVEL, 1), r"[^.]", ""))
    x = x.withColumn("type", kind).withColumn("level", F.when(F.col("type") != "heading", 0).when(F.col("_start"), 1).when(F.col("_app"), F.least(dots + 1, F.lit(3))).otherwise(level))
    head = F.coalesce(F.last(F.when(F.col("type") == "heading", t), True).over(w), F.lit(""))
    x = x.withColumn("section", F.when(F.col("type") == "reference", "References").when(F.col("_meta") & (F.col("page") == 0), "").otherwise(head))
    before = lambda c: F.lag(c).over(w)
    joins = (F.col("type") == "para") & (before("type") == "para") & (before("section") == F.col("section")) & (F.col("marker") == "") & (before("marker") == "") & ~before("text").rlike(CLOSED) & t.rlike(GOES_ON)
    x = x.withColumn("_c", F.coalesce(joins, F.lit(False)).cast("int")).withColumn("_i", F.sum(1 - F.col("_c")).over(w))
    translate = F.col("type").isin("para", "caption") | ((F.col("type") == "heading") & ~F.col("_start"))
    g = x.groupBy("doc", "_i").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "type", "section", "level", translate.alias("translate")))).alias("l"))
    one = F.element_at("l", 1)
    return g.select("doc", one["pos"].alias("pos"), one["type"].alias("type"), F.array_join(F.transform("l", lambda i: i.text), " ").alias("text"), one["section"].alias("section"), one["level"].alias("level"), one["translate"].alias("translate")).filter(F.length("text") > 1)
