"""Problem 1: texts that look the same but are stored with different characters.

Each text is brought to one form. Invisible characters go; blanks, hyphens, full-width,
mathematical and ligature letters and accents take their usual form. Letters of other scripts are
repaired script-aware: for each token the dominant script is determined (the token's, and where it
has none the text's), look-alikes are substituted only in tokens that mix scripts or stand in a text
of another script, and only when the result exists in the corpus vocabulary. The vocabulary holds
the folded forms of the whole corpus; a form that stands nowhere undisguised counts if two different
texts hold it, so that two differently disguised copies of a word vouch for each other, but no text
for itself, however many rows it comes in.

Plan: one narrow pass gives every record two 128-bit digests; only records with suspicious tokens
(few) carry text. Their candidates meet the vocabulary by a hash join on the token, never by
broadcast or collect. Groups with more than one string are found on pre-aggregated digests, and
only their members are joined into pairs, salted by the size of the group.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.fold import TO_LATIN, WEAK, visible
from papyrion.session import cut

_TOKEN = re.compile(r"\w+")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯԱ-֏]")
_FROM_LATIN = {
    "CYRILLIC": {ord(v): k for k, v in ((chr(a), b) for a, b in TO_LATIN.items()) if unicodedata.name(k).startswith("CYRILLIC") and len(v) == 1 and v.isalpha()},
    "GREEK": {ord(v): k for k, v in ((chr(a), b) for a, b in TO_LATIN.items()) if unicodedata.name(k).startswith("GREEK") and k not in WEAK},
}


@lru_cache(65536)
def script(ch: str) -> str:
    """LATIN, GREEK, CYRILLIC, ... of a letter; empty for digits, marks and signs."""
    if ch.isascii():
        return "LATIN" if ch.isalpha() else ""
    return unicodedata.name(ch, "").split(" ")[0] if ch.isalpha() else ""


def dominant(text: str) -> str:
    """The script of most letters; Latin where it ties."""
    n = Counter(map(script, text))
    n.pop("", None)
    return max(n, key=lambda s: (n[s], s == "LATIN")) if n else ""


def candidate(token: str, main: str) -> str | None:
    """What a token would be in its dominant script, when all its strange letters have look-alikes there."""
    own = Counter(map(script, token))
    own.pop("", None)
    strange = [c for c in token if script(c) not in ("", main)]
    if not strange:
        return None
    to = main
    if len(own) > 1 and max(own.values()) * 2 > sum(own.values()) and (top := max(own, key=own.get)) != main and main != "LATIN":
        to = top
    if to == "LATIN":
        if own.get("LATIN", 0) == 0 and len(own) == 1 and all(c in WEAK for c in strange):
            return None  # Greek letters by themselves: a formula
        out = token.translate(TO_LATIN)
    elif to in _FROM_LATIN:
        out = token.translate(_FROM_LATIN[to])
    else:
        return None
    return out if out != token and all(script(c) in ("", to) for c in out) else None


def suspicious(text: str) -> list[tuple[str, str]]:
    """(token, candidate) of the tokens of a visible() text that may be disguised."""
    if text.isascii() or not _FOREIGN.search(text):
        return []
    main = dominant(text)
    out = {}
    for t in _TOKEN.findall(text):
        if t not in out and not t.isascii() and (c := candidate(t, main)):
            out[t] = c
    return list(out.items())


def repair(text: str, fixes: dict[str, str]) -> str:
    """The text with the accepted substitutions."""
    return _TOKEN.sub(lambda m: fixes.get(m[0], m[0]), text) if fixes else text


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_FORMS = "tbl string, id string, raw binary, form binary, shown string, fixes array<struct<token:string,fix:string>>"
_FIX = pa.list_(pa.struct([("token", pa.string()), ("fix", pa.string())]))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for tbl, i, text in zip(*(c.to_pylist() for c in b.columns)):
            if i is None or not text:
                continue
            shown = visible(text).strip(" ")
            if not shown or shown.isspace():
                continue
            s = suspicious(shown)
            for col, v in zip(rows, (tbl, i, digest(text), digest(shown), shown if s else None, [{"token": a, "fix": c} for a, c in s])):
                col.append(v)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string(), _FIX)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["tbl", "id", "raw", "form", "shown", "fixes"])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(folded token, digest of the text): the digest is null for tokens that stand undisguised, once a batch."""
    for b in batches:
        clean: set[str] = set()
        disguised: set[tuple[str, bytes]] = set()
        for text in set(b.column(0).to_pylist()):
            if text:
                shown = visible(text)
                toks = set(_TOKEN.findall(shown))
                if strange := dict(suspicious(shown)):
                    d = digest(text)
                    disguised.update((f, d) for t, f in strange.items() if t in toks)
                    toks -= strange.keys()
                clean |= toks
        fix = [*clean, *(f for f, _ in disguised)]
        if fix:
            yield pa.RecordBatch.from_arrays([pa.array(fix), pa.array([None] * len(clean) + [d for _, d in disguised], pa.binary())], names=["fix", "text"])


def canonical(records: DataFrame) -> DataFrame:
    """(tbl, id, raw digest, form digest, form) of (tbl, id, text) records; ``form`` only where repaired.

    Null, empty and blank texts, and null ids, are left out. The final form of a record without a
    repair is fold.visible(text) without blanks at its ends.
    """
    recs = records.select(F.col("tbl").cast("string"), F.col("id").cast("string"), F.col("text").cast("string"))
    forms = cut(recs.mapInArrow(_forms, _FORMS).distinct())
    odd = forms.filter(F.size("fixes") > 0)
    fixes = odd.select("tbl", "id", "raw", F.explode("fixes").alias("f")).select("tbl", "id", "raw", "f.token", "f.fix")
    # known: stands undisguised somewhere, or disguised in two different texts; the same text twice is one
    words = recs.select("text").mapInArrow(_vocabulary, "fix string, text binary").join(fixes.select("fix").distinct(), "fix", "left_semi")
    known = words.groupBy("fix").agg(F.count_if(F.col("text").isNull()).alias("clean"), F.min("text").alias("a"), F.max("text").alias("b")).filter("clean > 0 or a < b").select("fix")
    good = fixes.join(known, "fix").groupBy("tbl", "id", "raw").agg(F.map_from_entries(F.collect_set(F.struct("token", "fix"))).alias("good"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tbl, i, raw, shown, good = (c.to_pylist() for c in b.columns)
            out = [repair(s, dict(g)) for s, g in zip(shown, good)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([digest(o) for o in out], pa.binary()), pa.array(out, pa.string())], names=["tbl", "id", "raw", "form", "shown"])

    mended = odd.join(good, ["tbl", "id", "raw"]).select("tbl", "id", "raw", "shown", "good").mapInArrow(mend, "tbl string, id string, raw binary, form binary, shown string")
    rest = forms.join(good.select("tbl", "id", "raw"), ["tbl", "id", "raw"], "left_anti").select("tbl", "id", "raw", "form", F.lit(None).cast("string").alias("shown"))
    return mended.unionByName(rest)


def look_classes(records: DataFrame) -> DataFrame:
    """(tbl, class, id, n_texts, n_records): the class of each record whose text looks like a different string.

    One row a record, however large its class; ``n_texts`` counts the class's different strings.
    """
    c = canonical(records).select("tbl", "id", "raw", "form").distinct()
    strings = c.groupBy("tbl", "form", "raw").agg(F.count("*").alias("n"))
    several = strings.groupBy("tbl", "form").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_records")).filter("n_texts > 1")
    return c.join(several, ["tbl", "form"]).select("tbl", F.lower(F.hex("form")).alias("class"), "id", "n_texts", "n_records").distinct()


#: Members of a group that one salt holds.
PER_SALT = 2000


def same_looking(records: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b): records of one table whose texts look the same but are different strings; id_a < id_b."""
    c = cut(canonical(records).select("tbl", "id", "raw", "form").distinct())
    strings = c.groupBy("tbl", "form", "raw").agg(F.count("*").alias("n"))
    several = strings.groupBy("tbl", "form").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).filter("kinds > 1")
    members = c.join(several.select("tbl", "form", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts")), ["tbl", "form"])
    left = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts").cast("long")).cast("int"))
    right = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    a, b = left.alias("a"), right.alias("b")
    pair = a.join(b, [F.col("a.tbl") == F.col("b.tbl"), F.col("a.form") == F.col("b.form"), F.col("a.salt") == F.col("b.salt"), F.col("a.raw") != F.col("b.raw"), F.col("a.id") != F.col("b.id")])
    return pair.select(F.col("a.tbl").alias("tbl"), F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b")).distinct()
