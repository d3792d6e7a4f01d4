"""Readers of foreign shapes: labelled answers, JSON in prose, inverted abstracts, Atom and registry rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def labelled(df: DataFrame, text_col: str, labels: Column | str | None = None) -> DataFrame:
    """(label, body) of labelled runs; a text that stops in the middle keeps what it has.

    Without a set of labels every ``<<<id>>>`` counts. With one (an array) a label is ``<<<id>>>`` with two
    to four signs, or ``### id``, ``**id**`` or ``[id]`` on a line of its own, with a colon or without; what
    is in no such form or not in the set stays part of the body, and of a label that comes twice the last
    body counts. Null texts give nothing.
    """
    keep = [c for c in df.columns if c != text_col and not (isinstance(labels, str) and c == labels)]
    if labels is None:
        mark = r"<<<?\s*([A-Za-z0-9_]+)\s*>>>?"
        keys = F.regexp_extract_all(text_col, F.lit(mark), F.lit(1))
        bodies = F.slice(F.split(text_col, mark), 2, 1_000_000)
        out = df.select(*keep, F.explode(F.arrays_zip(keys.alias("label"), bodies.alias("body"))).alias("x"))
        return out.select(*keep, F.col("x.label").alias("label"), F.trim("x.body").alias("body"))
    own = F.col(labels) if isinstance(labels, str) else labels
    line = r"[ \t]*:?[ \t]*$"
    form = rf"(?m)(?:[ \t]*<{{2,4}}[ \t]*([A-Za-z0-9_]+?)[ \t]*>{{2,4}}(?:[ \t]*:)?|^[ \t]*#{{1,6}}[ \t]*([A-Za-z0-9_]+?)_?{line}|^[ \t]*\*\*[ \t]*([A-Za-z0-9_]+?)[ \t]*\*\*{line}|^[ \t]*\[[ \t]*([A-Za-z0-9_]+?)[ \t]*\]{line})"
    found = F.transform(F.arrays_zip(*(F.regexp_extract_all(text_col, F.lit(form), F.lit(g)).alias(f"g{g}") for g in range(1, 5))), lambda x: F.concat(x.g1, x.g2, x.g3, x.g4))
    # runs are cut at every form; a form of no label is put back between its neighbours
    x = df.filter(F.col(text_col).isNotNull()).select(*keep, own.alias("_own"), found.alias("_found"), F.split(text_col, form).alias("_pieces"), F.regexp_extract_all(text_col, F.lit(form), F.lit(0)).alias("_marks"))
    known = F.transform("_found", lambda k, i: F.struct(i.alias("i"), k.alias("k"), F.array_contains("_own", k).alias("known")))
    x = x.select(*keep, "_pieces", "_marks", F.filter(known, lambda s: s.known).alias("_k"))
    nxt = lambda i: F.coalesce(F.get(F.col("_k"), i + 1)["i"], F.size("_marks"))
    body = lambda s, i: F.array_join(F.transform(F.sequence(s.i, nxt(i) - 1), lambda j: F.concat(F.when(j == s.i, F.lit("")).otherwise(F.get(F.col("_marks"), j)), F.get(F.col("_pieces"), j + 1))), "")
    out = x.select(*keep, F.posexplode(F.transform("_k", lambda s, i: F.struct(s.k.alias("label"), body(s, i).alias("body")))).alias("_i", "x"))
    return out.groupBy(*keep, F.col("x.label").alias("label")).agg(F.btrim(F.max_by("x.body", "_i"), F.lit(" \t\n\r")).alias("body"))


def _balanced(text: str) -> str | None:
    """The first JSON value in a text, by brackets outside strings; None where there is none."""
    for start, c in enumerate(text):
        if c not in "{[":
            continue
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            x = text[i]
            if quoted:
                escaped = not escaped and x == "\\"
                if x == '"' and text[i - 1] != "\\" or x == '"' and not escaped and _even(text, i):
                    quoted = False
            elif x == '"':
                quoted = True
            elif x in "{[":
                depth += 1
            elif x in "}]":
                depth -= 1
                if depth == 0:
                    try:
                        json.loads(text[start : i + 1], strict=False)
                        return text[start : i + 1]
                    except ValueError:
                        break
    return None


def _even(text: str, i: int) -> bool:
    n = 0
    while i - n - 1 >= 0 and text[i - n - 1] == "\\":
        n += 1
    return n % 2 == 0


@pandas_udf(StringType())
def json_in_text(s: pd.Series) -> pd.Series:
    """The JSON value inside prose or a code fence, as text; null where there is none."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            json.loads(t, strict=False)
            return t.strip()
        except ValueError:
            return _balanced(t)

    return s.map(one)


def atom_entries(df: DataFrame, xml_col: str) -> DataFrame:
    """(title, summary, year, url) of the entries of an Atom feed."""
    entries = F.regexp_extract_all(xml_col, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    e = df.select(F.explode(entries).alias("e"))
    tag = lambda n: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{n}[^>]*>(.*?)</{n}>", 1), r"\s+", " "))
    return e.select(tag("title").alias("title"), tag("summary").alias("summary"), F.expr("try_cast(left(regexp_extract(e, '<published>([0-9-]+)', 1), 4) AS int)").alias("year"), tag("id").alias("url"))


REGISTRY = "struct<DOI:string,title:array<string>,abstract:string,`is-referenced-by-count`:int,issued:struct<`date-parts`:array<array<int>>>>"


def registry_rows(df: DataFrame, json_col: str) -> DataFrame:
    """(doi, title, abstract, cites, year) of registry JSON; tags go from abstracts, broken JSON gives nulls."""
    r = df.select(F.from_json(json_col, REGISTRY).alias("r"))
    return r.select(
        F.lower("r.DOI").alias("doi"),
        F.try_element_at("r.title", F.lit(1)).alias("title"),
        F.trim(F.regexp_replace(F.regexp_replace("r.abstract", "<[^>]+>", " "), r"\s+", " ")).alias("abstract"),
        F.coalesce(F.col("r.is-referenced-by-count"), F.lit(0)).alias("cites"),
        F.try_element_at(F.try_element_at("r.issued.date-parts", F.lit(1)), F.lit(1)).alias("year"),
    )


def union_sources(*parts: DataFrame) -> DataFrame:
    """Rows of several sources with whatever columns each has."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
