"""Rules over decks of slides, outlines and syntheses: codes of what is wrong, slide by slide and over the whole deck.

A deck is a table (doc, no, kind, headline, bullets, figure, notes, sources); a rule is a condition with
a code, and all rules of a slide are one array without its nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions import text as T

#: Headlines that name a topic and say nothing, bare agenda entries, words of order, words of cause (fixed values).
EMPTY_HEADLINES = (
    "giới thiệu", "tổng quan", "bối cảnh", "phương pháp", "cách làm", "kết quả", "thực nghiệm", "thí nghiệm", "thảo luận", "kết luận", "công trình liên quan", "nội dung", "mục lục", "động lực", "giới hạn", "tóm tắt", "đặt vấn đề",
    "introduction", "background", "method", "methods", "results", "discussion", "conclusion", "related work", "outline", "motivation", "overview",
)
BARE_AGENDA = ("phương pháp", "cách làm", "kết quả", "thực nghiệm", "giới thiệu", "mở đầu", "kết luận", "thảo luận", "tổng quan", "bối cảnh", "giới hạn", "đánh giá", "động lực", "bài toán")
STEPS = ("bước", "trước hết", "sau đó", "cuối cùng", "lần lượt", "mỗi vòng", "đầu vào", "đầu ra", "nhận", "trả về", "→")
STRICT_CAUSAL = ("vì ", "bởi ", "do đó", "dẫn đến", "dẫn tới", "khiến", "làm cho", "bằng cách", "thông qua", "nhờ ", "nhờ đó", "kết quả là", "cho nên", "nên ", "thay vì", "để tránh", "nếu không", "ngược lại")
#: Budgets of a slide: words, characters of the headline, bullets, words of the notes (fixed values).
MOST_WORDS, MOST_HEADLINE, MOST_BULLETS, NOTES = 175, 105, 5, (80, 200)
QUIET = ("title", "thanks", "closing")
DIVIDERS = ("section", "agenda")


def count_words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def headline_codes(c: Column) -> list[Column]:
    """What is wrong with a statement: missing, a mere topic, a label, a question."""
    t = F.trim(F.coalesce(c, F.lit("")))
    bare = F.lower(F.trim(F.regexp_replace(t, "[:.]+$", "")))
    return [F.when(t == "", "missing"), F.when(bare.isin(*EMPTY_HEADLINES), "topic"), F.when(t.endswith(":"), "label"), F.when(t.endswith("?"), "question")]


def slide_codes(deck: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc, no, codes): the rules a slide breaks. ``figures`` (doc, figure): the pictures that exist.

    A picture that is used again counts against the later slides only.
    """
    kind = F.col("kind")
    known = figures.select("doc", "figure").distinct().withColumn("_known", F.lit(True))
    d = deck.join(known, ["doc", "figure"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    again = F.row_number().over(Window.partitionBy("doc", "figure", "_known").orderBy("no")) > 1
    d = d.withColumn("_again", again & F.col("figure").isNotNull() & F.col("_known"))
    words = count_words(F.concat_ws(" ", "headline", F.array_join("bullets", " ")))
    spoken = count_words(F.col("notes"))
    talks = ~kind.isin(*QUIET, *DIVIDERS)
    rules = [
        *headline_codes(F.col("headline")),
        F.when(F.length(F.trim("headline")) > MOST_HEADLINE, "long_headline"),
        F.when((words > MOST_WORDS) & ~kind.isin(*QUIET), "words"),
        F.when(F.size("bullets") > MOST_BULLETS, "bullets"),
        F.when(talks & (spoken < NOTES[0]), "short_notes"),
        F.when(talks & (spoken > NOTES[1]), "long_notes"),
        F.when(F.col("figure").isNotNull() & ~F.col("_known"), "unknown_figure"),
        F.when(F.col("_again"), "figure_again"),
        F.when((kind == "content") & (F.col("figure").isNull() | ~F.col("_known")), "nothing_to_see"),
        F.when((F.size("sources") == 0) & ~kind.isin(*QUIET, "agenda"), "no_source"),
        F.when((kind == "section") & (F.size("bullets") > 0), "divider_with_bullets"),
    ]
    return d.select("doc", "no", F.array_compact(F.array(*rules)).alias("codes"))


def orphan_numbers(deck: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, no, num): figures of a slide's face that none of its source blocks holds; whole numbers up to 12 are exempt."""
    face = deck.filter(~F.col("kind").isin(*QUIET)).filter(F.size("sources") > 0).withColumn("face", F.concat_ws(" ", "headline", F.array_join("bullets", " ")))
    n = face.select("doc", "no", F.explode(F.array_distinct(T.numbers(F.col("face")))).alias("raw")).withColumn("num", T.norm_number(F.col("raw")))
    n = n.filter(~(F.col("raw").rlike(r"^\d+$") & (F.col("raw").try_cast("long") <= 12)))
    have = face.select("doc", "no", F.explode("sources").alias("id")).join(blocks.select("doc", "id", "text"), ["doc", "id"])
    have = have.select("doc", "no", F.explode(T.source_numbers(F.col("text"))).alias("num")).distinct()
    return n.join(have, ["doc", "no", "num"], "left_anti").select("doc", "no", "num").distinct()


def outline_codes(items: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, no, codes) of (doc, no, kind, message, points, section, evidence, figure, sources); ``sections`` (doc, name)."""
    names = sections.groupBy("doc").agg(F.collect_set("name").alias("_names"))
    d = items.join(names, "doc", "left")
    content = F.col("kind") == "content"
    n = F.size("points")
    rules = [
        *headline_codes(F.col("message")),
        F.when(content & (n == 0), "no_points"),
        F.when(content & (n > 0) & (n < 3), "few_points"),
        F.when(content & (F.trim("section") != "") & F.col("_names").isNotNull() & ~F.array_contains("_names", F.trim("section")), "unknown_section"),
        F.when(content & (F.col("evidence") == "none"), "no_evidence"),
        F.when((F.size("sources") == 0) & ~F.col("kind").isin("title", "agenda", "section", "closing"), "no_source"),
    ]
    return d.select("doc", "no", F.array_compact(F.array(*rules)).alias("codes"))


def agenda_codes(deck: DataFrame) -> DataFrame:
    """(doc, codes): the agenda against the dividers that follow it."""
    g = deck.groupBy("doc").agg(F.min_by("bullets", F.when(F.col("kind") == "agenda", F.col("no"))).alias("items"), F.count_if(F.col("kind") == "section").alias("n"))
    items = F.filter("items", lambda b: F.trim(b) != "")
    bare = F.exists(items, lambda b: F.lower(F.regexp_replace(F.trim(b), r"\.+$", "")).isin(*BARE_AGENDA))
    rules = [F.when(F.col("items").isNull() & (F.col("n") > 0), "no_agenda"), F.when(F.size(items) < 3, "few_entries"), F.when(bare, "bare_entries"), F.when(F.col("n") > F.size(items), "more_dividers")]
    return g.select("doc", F.array_compact(F.array(*rules)).alias("codes"))


def walks_mechanism(c: Column) -> Column:
    """Two words of order and two of cause: a text that follows a mechanism instead of naming it."""
    low = F.lower(F.coalesce(c, F.lit("")))
    n = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    return (n(STEPS) >= 2) & (n(STRICT_CAUSAL) >= 2)


def agenda_titles(names: Column, cards: Column) -> Column:
    """The cards of an agenda with the section names as titles, by position; cards beyond the names go."""
    return F.transform(names, lambda name, i: F.struct(name.alias("title"), F.get(cards, i).alias("card")))


def slides_of_outline(outline: DataFrame, slides: DataFrame) -> DataFrame:
    """(doc, no, oid, slide): each outline item with the slide of its id, else the slide at its place."""
    by_id = slides.filter("oid is not null").groupBy("doc", "oid").agg(F.max_by("slide", "place").alias("_a"))
    by_place = slides.select("doc", F.col("place").alias("no"), F.col("slide").alias("_b"))
    return outline.join(by_id, ["doc", "oid"], "left").join(by_place, ["doc", "no"], "left").select("doc", "no", "oid", F.coalesce("_a", "_b").alias("slide"))


def flowchart(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, src, dst): edges of flowchart texts; node labels in brackets go, chains ``a --> b --> c`` count edge by edge."""
    line = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.split(text_col, "[\n;]")).alias("l"))
    nodes = F.transform(F.split(F.regexp_replace("l", r'\|[^|]*\||\[[^\]]*\]|\([^)]*\)|\{[^}]*\}', ""), r"\s*(?:-->|---|==>|-\.->)\s*"), lambda x: F.regexp_extract(x, r"([A-Za-z0-9_]+)\s*$", 1))
    e = line.select("id", nodes.alias("n")).filter("size(n) > 1")
    pairs = F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.struct(F.element_at("n", i).alias("src"), F.element_at("n", i + 1).alias("dst")))
    return e.select("id", F.explode(pairs).alias("e")).select("id", "e.src", "e.dst").filter("src <> '' and dst <> ''").distinct()
