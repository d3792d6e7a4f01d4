"""Problem 10: pages of keywords, links or tags instead of sentences.

One narrow pass measures every document: its text is cut into sentences and lines, and each is
measured by link-text ratio, tag share, separator density (rows of one and the same pattern of words,
numbers and separators are a listing), the share of word pairs that the document repeats, the share of
its top words (words other than function words standing three times or more), whether it is a
repeated line, whether it is one of many lines without any function word or end of a sentence, and
the share of function words. The thresholds of function words, top words, repeated lines and bare
lines are calibrated per language from all documents (grouped medians over a handful of languages);
a second, JVM-side step sums the characters of the segments that are no prose and keeps documents
with more than half. The shuffle carries one small row per document into a grouped median,
pre-aggregated map-side.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.session import cut, spread

#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the a an of and in to is are be for on by with we our it its that this these those or as at from because their was but than how should what when which where each both no do does not only into while most there has have can without under over once more one all",
    "de": "der die das den dem des ein eine einen und von vor für im in auf zu nur wird ohne mit alle aller sich ob um wie als bei wir werden wurden so nicht auch ist sind",
    "fr": "le la les l de des du d et un une pour par sur en est sont que qui avec sans nous on ne pas dans ce cette ces se si plus contre il elle",
    "vi": "của và là các trong cho một chúng tôi không có được với khi trên mọi về thì ở này những để bằng hơn vì bởi từ đến cả lẫn mỗi nào chỉ đều vẫn sau còn bị lại mà gồm như ra vào dưới nó",
}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_SETS.values())
_WORD = re.compile(r"[^\W_]+")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\[[^\]\n]{0,200}\]\([^)\s]*\)")
_TAG = re.compile(r"[#@][^\W_][\w-]*")
_SEP = re.compile(r"\s[/|•·»>]\s|;\s|\t")
_CUT = re.compile(r"(?<=[.!?])\s+|\n+")
_ENTRY = re.compile(r"^\s*\[\d{1,3}\]\s.*\b(?:19|20)\d\d\b[^\n]*$", re.M)
_LISTED = re.compile(r"\s*\[?\d{1,3}[\].]\s")

_FIELD = re.compile(r"\s[-/|•·»>–—]\s|[;,\t]\s?")
_WORDS = re.compile(r"[^\W\d]+(?:\W{0,2}\s?[^\W\d]+)*")
#: Rows of one pattern that make a listing, fields of a row, lines in a row that may be bare.
ROWS, FIELDS, BARE = 3, 3, 8
#: A segment of which this share is links, tags or separators is a list.
LIST_SHARE = 0.5
#: Share of a segment's word pairs that the document repeats.
REPEATED = 0.5
#: Share of a segment's words that are top words of the document; at least so many times the language's median share, and at most the last.
TOP, TOP_TIMES, TOP_MOST = 0.5, 1.5, 0.9
#: Share of a segment's words that one top word makes in no prose.
ONE = 0.25
#: Share of top words, or of characters in repeated lines, below which a document can't be half keywords.
EARLY_TOP, EARLY_LINES = 0.25, 0.2
#: Times that a line stands from which it counts as repeated; times the language's median share of such lines that the document's must exceed.
LINES, LINES_TIMES = 2, 1.5
#: Share of the language's median share of function words below which a repeating segment is no prose.
FUNCTION_SHARE = 0.6
#: The same for segments that hardly hold anything else than repeated pairs.
OFTEN_SHARE = 0.8
#: The median taken for a language none of whose documents holds a function word.
USUAL = 0.2


def _top_words(counts: Counter) -> set[str]:
    """Words of a document, no function words and no numbers, that stand three times or more."""
    return {x for x, n in counts.items() if n >= 3 and x not in _ANY and not x.isdigit()}


def _line_share(parts: list[str]) -> float:
    """Share of the characters that stand in repeated parts."""
    n = Counter([x for p in parts if (x := p.strip())])
    return sum([len(x) * k for x, k in n.items() if k >= LINES]) / max(1, sum([len(x) * k for x, k in n.items()]))


def row_pattern(line: str) -> str | None:
    """A row of a listing as its pattern of words, numbers and separators; None for what is none.

    A row has ``FIELDS`` fields at least, a number, more letters than digits, and no entry's number before it.
    """
    fields = _FIELD.split(line)
    if len(fields) < FIELDS or _LISTED.match(line) or line.rstrip().endswith((".", "!", "?")):
        return None
    digits = sum(map(str.isdigit, line))
    if not digits or 2 * digits > sum(map(str.isalpha, line)):
        return None
    return "|".join(re.sub(r"\d+", "9", _WORDS.sub("w", f.strip())) for f in fields)


def bare_line(line: str, words: list[str]) -> bool:
    """A line of a few words without a function word or the end of a sentence."""
    return 0 < len(words) <= 12 and not _ANY.intersection(words) and not line.rstrip().endswith((".", "!", "?", ":")) and not _LISTED.match(line) and sum(map(str.isalpha, line)) * 2 > len(line)


def bare_runs(lines: list[bool]) -> list[bool]:
    """Those of the marked lines that stand in a run of ``BARE`` or more."""
    out, i = [False] * len(lines), 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j]:
            j += 1
        if j - i >= BARE:
            out[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    return out


def measure(text: str) -> tuple[int, int, list[tuple[int, float, float, float, bool, bool]], str | None, float, float, float, float]:
    """(characters, characters of lists, segments, language, function share, top-word share, repeated-line share, bare-line share).

    Segments are (characters, repeated share, function share, top-word share, whether repeated as a line, whether bare) and
    only those with noticeable repetition; the others are prose whatever the calibration says. The
    function share of the document leaves them and lists out.
    """
    low = text.lower()
    words = _WORD.findall(low)
    counts = Counter(words)
    hits = {lang: sum([counts[x] for x in ws if x in counts]) for lang, ws in _SETS.items()}
    best = max(hits, key=hits.get)
    guess = best if hits[best] else None
    pairs = Counter(zip(words, words[1:]))
    repeats = sum([n for n in pairs.values() if n >= 3])
    links = sum(map(len, _LINK.findall(low))) if "://" in low or "www." in low or "](" in low else 0
    tags = sum(map(len, _TAG.findall(low))) if "#" in low or "@" in low else 0
    parts = _CUT.split(low)
    lined = low.count("\n") + 1
    fielded = lined >= ROWS and len(_FIELD.findall(low)) >= ROWS * (FIELDS - 1)
    bare = bare_runs([bare_line(p, _WORD.findall(p)) for p in parts]) if lined >= BARE else [False] * len(parts)
    bare_share = sum([len(p) for p, x in zip(parts, bare) if x]) / len(low)
    patterns = Counter(x for p in parts if (x := row_pattern(p))) if fielded else Counter()
    listing = any(n >= ROWS for n in patterns.values())
    tops = _top_words(counts)
    top_share = sum([counts[x] for x in tops]) / len(words) if words else 0.0
    line_share = _line_share(low.split("\n"))
    if not listing and bare_share < EARLY_LINES and repeats < 0.15 * len(words) and links + tags < 0.2 * len(low) and top_share < EARLY_TOP and line_share < EARLY_LINES:
        # too little of any of it for half of the characters, whatever the segments
        return len(text), 0, [], guess, sum([counts[x] for x in _ANY if x in counts]) / len(words) if words else 0.0, top_share, line_share, bare_share
    hot = {p for p, n in pairs.items() if n >= 3}
    entries = sum(map(len, _ENTRY.findall(low))) if "[" in low else 0
    if entries:  # bibliographic entries are prose here, however alike they look
        low = _ENTRY.sub("", low)
        parts = _CUT.split(low)
        bare = bare_runs([bare_line(p, _WORD.findall(p)) for p in parts]) if lined >= BARE else [False] * len(parts)
    total = hard = prose_words = prose_function = 0
    soft = []
    often = {x for x, n in Counter([p.strip() for p in parts]).items() if n >= LINES}
    for s, is_bare in zip(parts, bare):
        if not s or s.isspace():
            continue
        n = len(s)
        total += n
        if tags and sum(map(len, _TAG.findall(s))) > LIST_SHARE * n:
            hard += n
            continue
        w = _WORD.findall(s)
        k = len(w)
        function = sum([x in _ANY for x in w])
        if links and ("://" in s or "www." in s or "](" in s):
            linked = sum(map(len, _LINK.findall(s)))
            if linked > LIST_SHARE * n or (linked > 0.25 * n and function < 0.12 * k):
                hard += n
                continue
        if listing and function <= 0.1 * k and patterns.get(row_pattern(s) or "", 0) >= ROWS:
            hard += n
            continue
        rep = sum([p in hot for p in zip(w, w[1:])]) / (k - 1) if k >= 2 and hot else 0.0
        top = sum([x in tops for x in w]) / k if k else 0.0
        if k >= 8 and top >= ONE and max(map(w.count, tops.intersection(w))) >= ONE * k:
            top = 1.0  # one word stands again and again
        line = k > 0 and s.strip() in often
        # items between separators need less repetition to count as a keyword list
        if rep < (REPEATED if len(_SEP.findall(s)) < 0.15 * k else 0.7 * REPEATED):
            rep = 0.0
        if rep or top >= TOP or line or is_bare:
            soft.append((n, rep, function / k, top, line, is_bare))
        else:
            prose_words += k
            prose_function += function
    return total + entries, hard, soft, guess, prose_function / prose_words if prose_words else 0.0, top_share, line_share, bare_share


MEASURES = "n int, hard int, soft array<struct<n:int,rep:float,fw:float,top:float,line:boolean,bare:boolean>>, guess string, fw float, top float, lines float, bares float"


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The measures of every document with a text that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        soft_type = pa.list_(pa.struct([("n", pa.int32()), ("rep", pa.float32()), ("fw", pa.float32()), ("top", pa.float32()), ("line", pa.bool_()), ("bare", pa.bool_())]))
        for b in batches:
            ids, langs, cols = [], [], ([], [], [], [], [], [], [], [])
            for i, text, lang in zip(*(c.to_pylist() for c in b.columns)):
                if text and not text.isspace():
                    ids.append(i)
                    langs.append(lang)
                    for c, v in zip(cols, measure(text)):
                        c.append(v)
            soft = pa.array([[{"n": n, "rep": r, "fw": f, "top": t, "line": d, "bare": e} for n, r, f, t, d, e in x] for x in cols[2]], soft_type)
            arrays = [pa.array(ids, b.schema.field(0).type), pa.array(langs, pa.string()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), soft, pa.array(cols[3], pa.string()), *(pa.array(c, pa.float32()) for c in cols[4:])]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "lang", "n", "hard", "soft", "guess", "fw", "top", "lines", "bares"])

    kept = spread(docs.select(docs[id_col], docs[text_col], docs[lang_col]))
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, lang string, {MEASURES}")


def spam_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, over: float = 0.5) -> DataFrame:
    """(id, share) of documents of which more than ``over`` of the characters are no prose.

    The language of a document is the one whose function words it holds most; without any, its
    ``lang`` column in lower case. Null, empty and blank texts give no row. Repeated rows count once.
    """
    m = cut(measure_documents(docs, id_col, text_col, lang_col).withColumn("lang", F.coalesce("guess", F.lower("lang"), F.lit("und"))))
    median = lambda c: F.percentile_approx(c, 0.5, 1000).alias(f"usual_{c}")
    usual = m.filter("fw > 0").groupBy("lang").agg(median("fw"), median("top"), median("lines"), median("bares"))
    # one row a language: some dozens at any size, still left to Spark's own size check
    j = m.join(usual, "lang", "left")
    fw = F.coalesce("usual_fw", F.lit(USUAL))
    top = F.least(F.greatest(F.lit(TOP), TOP_TIMES * F.coalesce("usual_top", F.lit(0.0))), F.lit(TOP_MOST))
    lines = F.col("lines") > LINES_TIMES * F.coalesce("usual_lines", F.lit(0.0))
    bares = F.col("bares") > LINES_TIMES * F.coalesce("usual_bares", F.lit(0.0))

    def keyword(s):
        """Repeated pairs, top words, repeated or bare lines, and few function words for the language."""
        pairs = (s.rep > 0) & (s.fw <= F.when(s.rep >= 0.8, OFTEN_SHARE).otherwise(FUNCTION_SHARE) * fw)
        return pairs | (((s.top >= top) | (s.line & lines) | (s.bare & bares)) & (s.fw <= FUNCTION_SHARE * fw))

    keywords = F.aggregate(F.filter("soft", keyword), F.lit(0), lambda a, s: a + s.n)
    return j.withColumn("share", (F.col("hard") + keywords) / F.col("n")).filter(F.col("share") > over).select(id_col, "share").distinct()
