"""Folding of characters that look the same, shared by the operators of this package."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other scripts that look like Latin letters (fixed values).
LOOKALIKE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "к": "k", "в": "b", "м": "m", "н": "h", "т": "t", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ё": "Ë", "Ї": "Ï", "Һ": "H", "Ԁ": "D", "З": "3", "з": "3",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "κ": "k", "τ": "t", "χ": "x", "γ": "y", "η": "n", "ω": "w", "ε": "e", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g",
}

#: Characters that leave no mark: joiners, marks of direction, variation selectors, soft hyphen.
INVISIBLE = re.compile("[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff]+")
#: Blanks of any width; line breaks are none.
BLANKS = re.compile("[\t\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]")
#: Hyphens that print alike.
HYPHENS = re.compile("[\u2010\u2011\ufe63\uff0d]")


def _plain(ch: str) -> str | None:
    """The usual form of a compatibility character a reader takes for it; None where readers tell them apart."""
    d = unicodedata.decomposition(ch)
    if not d.startswith("<"):
        return None
    kind = d[1 : d.index(">")]
    if kind in ("wide", "narrow", "font") or (kind == "compat" and "LIGATURE" in unicodedata.name(ch, "")):
        return unicodedata.normalize("NFKC", ch)
    return None


class _Plain(dict):
    """Translation table filled on demand."""

    def __missing__(self, code: int):
        v = _plain(chr(code)) if code > 0x7F else None
        self[code] = v if v is not None else code
        return self[code]


PLAIN = _Plain()
#: Greek letters that readers tell from Latin ones when they stand alone; they count as disguise only among Latin letters.
WEAK = frozenset("ανριυκτχγηωε")
TO_LATIN = {ord(k): v for k, v in LOOKALIKE.items()}


#: Anything but characters that folding leaves alone: most texts hold none and come back as they are.
STRANGE = re.compile("[^\n\x20-\x7eÀ-ÖØ-öø-ıĴ-ſƠơƯưẠ-ỹ‘-‟–—…€°±×÷§]")


def visible(text: str) -> str:
    """One form for invisible characters, blanks, hyphens, compatibility letters and accents.

    Superscripts, case, digits and line breaks stay; letters of other scripts stay, too.
    """
    if text.isascii():
        return text.replace("\t", " ") if "\t" in text else text
    if not STRANGE.search(text):
        return text
    t = INVISIBLE.sub("", text)
    t = HYPHENS.sub("-", BLANKS.sub(" ", t)).translate(PLAIN)
    return t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)


def latin(text: str) -> str:
    """visible() and every look-alike letter as its Latin one; for matching, not for display."""
    return text if text.isascii() or not STRANGE.search(text) else visible(text).translate(TO_LATIN)
