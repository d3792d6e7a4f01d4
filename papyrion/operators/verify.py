"""Grounding checks: text to rows, then set differences and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions import text as T

#: Phrases that only make a sentence longer (fixed values).
FILLER = (
    "đóng vai trò quan trọng", "đóng vai trò then chốt", "vô cùng quan trọng", "mang lại hiệu quả cao", "mang lại nhiều lợi ích", "đạt hiệu quả tốt",
    "góp phần nâng cao", "góp phần cải thiện", "góp phần quan trọng", "là một trong những", "có ý nghĩa quan trọng", "hết sức cần thiết",
    "đáng chú ý là", "nhìn chung có thể thấy", "có thể thấy rằng", "nói chung là", "về cơ bản thì", "trong bối cảnh hiện nay",
    "ngày càng trở nên", "không thể phủ nhận", "chưa xác định", "không rõ", "cần nghiên cứu thêm để làm rõ",
)
#: Verbs of improvement that do not say how (fixed values).
VAGUE = (
    "cải thiện", "nâng cao", "tăng cường", "tối ưu hoá", "tối ưu hóa", "đẩy mạnh", "hoàn thiện", "phát huy", "khắc phục hạn chế",
    "giải quyết vấn đề", "xử lý tốt hơn", "hiệu quả hơn",
)
#: Marks of a mechanism: cause, means, condition, order (fixed values).
CAUSAL = (
    "vì", "bởi", "do đó", "nên ", "dẫn đến", "dẫn tới", "khiến", "làm cho", "bằng cách", "thông qua", "nhờ ", "nhờ đó", "kết quả là", "cho nên",
    "khi ", "nếu ", "trong khi", "thay vì", "trước hết", "sau đó", "cuối cùng", "từng bước", "lần lượt", "mỗi lần", "mỗi vòng", "tại mỗi",
    "tức là", "nghĩa là", "cụ thể", "ví dụ",
)
#: Words without content for the comparison of a term and its explanation (fixed values).
STOP = (
    "là", "và", "của", "các", "những", "một", "có", "được", "cho", "với", "trong", "khi", "này", "đó", "thì", "mà", "để", "từ", "trên", "về", "như", "hay",
    "hoặc", "nếu", "vì", "nên", "đã", "sẽ", "cũng", "rất", "nhiều", "ít", "không", "the", "a", "an", "of", "and", "to", "in", "for", "on", "is", "are", "with",
)
#: Scripts a translation may hold without the source doing so (fixed ranges).
ALLOWED = r"\t\n\r\x{0020}-\x{024F}\x{02B0}-\x{02FF}\x{0300}-\x{036F}\x{0370}-\x{03FF}\x{1D00}-\x{1DBF}\x{1E00}-\x{1EFF}\x{2000}-\x{206F}\x{2070}-\x{209F}\x{20A0}-\x{20CF}\x{2100}-\x{23FF}\x{25A0}-\x{26FF}\x{FB00}-\x{FB4F}"
#: A citation, and the place between two sentences.
CITE = r"\[([A-Za-z0-9]{3,40})\]"
SENTENCE = r"(?<=[.!?:;])\s+(?=[A-ZĐÀ-Ỹ0-9*#\-])|\n+"
#: Words that own up to a gap (fixed values).
GAP = r"(?i)chưa tìm thấy|không tìm thấy|chưa có bằng chứng"


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, i, text, cites): sentences with their citations; headings, table rules and empty lines are none."""
    lines = F.filter(F.split(text_col, "\n"), lambda x: ~x.rlike(r"^\s*(#{1,6}\s|\|[\s\-:|]*\||[-*>]\s*$|\s*$)"))
    parts = F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE))), lambda x: F.trim(x)), lambda x: x != "")
    s = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(parts).alias("i", "text"))
    return s.withColumn("cites", F.regexp_extract_all("text", F.lit(CITE), F.lit(1)))


def unknown_citations(s: DataFrame, allowed: DataFrame) -> DataFrame:
    """Citations of what was not shown: (id, i, cite) not among (id, cite)."""
    return s.select("id", "i", F.explode("cites").alias("cite")).join(allowed, ["id", "cite"], "left_anti")


def uncited_numbers(s: DataFrame) -> DataFrame:
    """Sentences with figures and no citation."""
    n = s.withColumn("nums", T.numbers(F.col("text")))
    return n.filter((F.size("nums") > 0) & (F.size("cites") == 0)).select("id", "i", F.size("nums").alias("n"))


def ungrounded_numbers(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, num): figures of a claim that its source does not hold. claims (id, text), sources (id, source)."""
    c = claims.select("id", F.explode(F.array_distinct(F.transform(T.numbers(F.col("text")), T.norm_number))).alias("num"))
    have = sources.select("id", F.explode(T.source_numbers(F.col("source"))).alias("num")).distinct()
    return c.join(have, ["id", "num"], "left_anti")


def script_leak(out: Column, src: Column) -> Column:
    """Characters of scripts that neither the allowed ranges nor the source hold."""
    strange = F.array_distinct(F.regexp_extract_all(F.coalesce(out, F.lit("")), F.lit(f"[^{ALLOWED}]"), F.lit(0)))
    return F.array_sort(F.filter(strange, lambda c: ~F.contains(F.coalesce(src, F.lit("")), c)))


def _any(low: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(low, p))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[0-9A-Za-zÀ-ỹ]+"), F.lit(0))


def content_words(c: Column) -> Column:
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) > 1) & ~w.isin(*STOP)))


def circular(term: Column, explain: Column) -> Column:
    """An explanation that hardly says more than the term."""
    t, e = content_words(term), content_words(explain)
    return (F.size(t) > 0) & (F.size(e) > 0) & (F.size(F.array_intersect(t, e)) / F.size(t) >= 0.6) & (F.size(e) <= 2.5 * F.size(t))


def lints(c: Column, term: Column | None = None) -> Column:
    """Kinds of shallow writing in a text: filler, vague claim or missing mechanism, circular."""
    low = F.lower(c)
    causal = _any(low, CAUSAL)
    vague = _any(low, VAGUE) & ~causal
    bare = ~vague & (F.size(words(c)) >= 12) & ~causal & ~c.rlike(r"\d")
    kinds = [F.when(_any(low, FILLER), F.lit("filler")), F.when(vague, F.lit("vague")), F.when(bare, F.lit("no_mechanism"))]
    if term is not None:
        kinds.append(F.when(circular(term, c), F.lit("circular")))
    return F.array_compact(F.array(*kinds))


def grouped(warnings: DataFrame, by: list[str], keep: int = 4, least: int = 3) -> DataFrame:
    """Warnings of one kind as one row from ``least`` on, with the first examples in order."""
    g = warnings.groupBy(*by).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "msg"))), 1, keep).alias("l"), F.min("pos").alias("first"))
    return g.select(*by, "n", (F.col("n") >= least).alias("collapsed"), "first", F.transform("l", lambda x: x.msg).alias("examples"))


def same_characters(a: Column, b: Column) -> Column:
    """Equal multisets of letters and digits, whatever their order."""
    chars = lambda c: F.array_sort(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), ""))
    return chars(a) == chars(b)


def hides_gap(answer: Column, open_questions: Column) -> Column:
    """Open questions and no word of it."""
    return (open_questions > 0) & ~answer.rlike(GAP)


def read_gate(findings: DataFrame, batch: DataFrame) -> DataFrame:
    """Findings (.., chunk, finding) that rest on a passage of the batch (chunk) and are not blank."""
    return findings.filter(F.trim("finding") != "").join(batch, "chunk", "left_semi")


def synthesis_warnings(approaches: DataFrame, evidence: DataFrame, passages: DataFrame, papers: DataFrame) -> DataFrame:
    """(survey_id, kind, ref) of a synthesis: approaches (survey_id, name, id, falsify), evidence (survey_id, cite, claim),
    passages (survey_id, cite, body), papers (survey_id, id, carded).

    Cited passages must be the corpus' own, figures of a claim stand in its passage, papers exist, carded
    papers are placed, an approach says what would refute it, and three approaches of one paper each are none.
    """
    out = lambda df, kind, ref: df.select("survey_id", F.lit(kind).alias("kind"), ref.cast("string").alias("ref")).distinct()
    unknown = out(evidence.join(passages, ["survey_id", "cite"], "left_anti"), "unknown_chunk", F.col("cite"))
    cited = evidence.join(passages, ["survey_id", "cite"]).withColumn("id", F.struct("survey_id", "cite"))
    wrong = ungrounded_numbers(cited.select("id", F.col("claim").alias("text")), cited.select("id", F.col("body").alias("source")))
    wrong = wrong.select("id.survey_id", F.lit("fabricated_number").alias("kind"), F.concat_ws(" ", "id.cite", "num").alias("ref")).distinct()
    strange = out(approaches.join(papers, ["survey_id", "id"], "left_anti"), "unknown_paper", F.col("id"))
    forgotten = out(papers.filter("carded").join(approaches, ["survey_id", "id"], "left_anti"), "forgotten_paper", F.col("id"))
    bold = out(approaches.filter("falsify is null"), "no_falsifier", F.col("name"))
    size = approaches.groupBy("survey_id", "name").agg(F.count_distinct("id").alias("n")).groupBy("survey_id").agg(F.count("*").alias("k"), F.max("n").alias("most"))
    alone = out(size.filter("k >= 3 and most <= 1"), "not_grouped", F.lit(""))
    every = unknown
    for x in (wrong, strange, forgotten, bold, alone):
        every = every.unionByName(x)
    return every


def year_conflicts(answers: DataFrame, papers: DataFrame, near: int = 60) -> DataFrame:
    """(aid, id, year, said): papers (aid, id, title, year) whose title's start stands in their answer with other years around it only."""
    p = papers.filter((F.length(F.trim("title")) >= 12) & (F.coalesce("year", F.lit(0)) != 0)).withColumn("head", F.left(F.trim("title"), F.lit(40)))
    j = p.join(answers, "aid").withColumn("at", F.expr("instr(answer, head)"))
    start = F.greatest(F.col("at") - near, F.lit(1))
    around = F.substr("answer", start, F.length("head") + F.col("at") - start + near)
    years = F.array_distinct(F.transform(F.regexp_extract_all(around, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    return j.filter("at > 0").withColumn("said", F.array_sort(years)).filter((F.size("said") > 0) & ~F.array_contains("said", F.col("year"))).select("aid", "id", "year", "said")


#: Times of day and lengths of time, whose digits are no figures (fixed value).
TIMES = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?"


def lecture_warnings(claims: DataFrame, sources: DataFrame, cited: DataFrame) -> DataFrame:
    """(doc, kind, ref): figures of claims (id, text) that their source (id, source) does not hold, and citations (doc, cite) of no source."""
    wrong = ungrounded_numbers(claims.select("id", F.regexp_replace("text", TIMES, " ").alias("text")), sources)
    a = wrong.select(F.col("id").alias("doc"), F.lit("fabricated_number").alias("kind"), F.col("num").alias("ref")).distinct()
    b = cited.join(sources.select(F.col("id").alias("cite")), "cite", "left_anti").select("doc", F.lit("unknown_source").alias("kind"), F.col("cite").alias("ref"))
    return a.unionByName(b)
