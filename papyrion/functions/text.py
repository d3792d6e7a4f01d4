"""Text functions as column expressions: normalising, hashing, names, titles, numbers, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def memo_key(text: Column, model: Column) -> Column:
    """Key of a translation: hash of the collapsed text, and the model."""
    return F.concat(sha(collapse(text)), F.lit("|"), model)


def norm_name(c: Column) -> Column:
    """Entity name for grouping: lower case, signs as blanks, at most 80 characters."""
    return F.left(collapse(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9À-ỹ ]+", " ")), F.lit(80))


def norm_title(c: Column) -> Column:
    """Title for grouping: lower-case ASCII letters and digits between single blanks."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]+", " "))


def usable_title(c: Column) -> Column:
    """Long enough to be searched for: 16 characters and three words."""
    t = collapse(F.coalesce(c, F.lit("")))
    return (F.length(t) >= 16) & (F.size(F.split(t, " ")) >= 3)


#: Bold, code and emphasis marks around text (fixed values).
MARKUP = r"\*\*([^*]+)\*\*|`([^`]+)`|\*([^*\s][^*]*)\*"


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, MARKUP, "$1$2$3")


#: Accented lower-case letters and their base letters; đ stays (fixed values, in order).
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵïöüäëñç"
BASE = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyiouaenc"


def fold_accents(c: Column) -> Column:
    """Lower case without accents, by a fixed table (no Unicode decomposition is built in)."""
    return F.translate(F.lower(c), ACCENTED, BASE)


def tokens(c: Column) -> Column:
    """Index terms: runs of letters and digits, lower case, without accents."""
    return F.regexp_extract_all(fold_accents(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: A number by itself: no letter, digit, point or comma before, no letter or digit after.
NUMBER = r"(?U)(?<![\w.,])\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?(?![\w])"
#: A number of a source text: letters may follow.
SOURCE_NUMBER = r"(?U)(?<![\w.,])(\d+(?:[.,]\d+)*)(?:[eE][-+]?\d+)?"
#: Addresses, whose digits are no figures.
URLISH = r"(?U)\b(?:https?://|www\.|\S+\.(?:com|org|net|io|edu|gov)\b)\S*"


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), URLISH, " "), F.lit(NUMBER), F.lit(0))


def norm_number(c: Column) -> Column:
    """1,5 as 1.5, without zeros at the end of a fraction; grouping is not interpreted."""
    dotted = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), "0+$", ""), r"\.+$", "")
    return F.when(c.contains(".") | c.contains(","), dotted).otherwise(c)


def source_numbers(c: Column) -> Column:
    """All numbers a source may vouch for, with and without grouping signs."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SOURCE_NUMBER), F.lit(1))
    plain = F.transform(F.filter(raw, lambda n: n.contains(",") | n.contains(".")), lambda n: F.regexp_replace(n, "[.,]", ""))
    return F.array_distinct(F.concat(F.transform(raw, norm_number), plain))


def first_sentences(c: Column, n: int = 2, most: int = 400) -> Column:
    """The first n sentences, at most ``most`` characters."""
    parts = F.split(collapse(c), r"(?<=[.!?])\s+")
    return F.left(F.array_join(F.slice(parts, 1, n), " "), F.lit(most))


def clip_words(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word, with an ellipsis where cut."""
    t = collapse(c)
    head = F.regexp_replace(F.regexp_replace(F.left(t, F.lit(most)), r"\s+\S*$", ""), r"[\s,;:.\-–—]+$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(head, F.lit("…")))
