"""Problem 3: cut oversized items into overlapping pieces at natural boundaries, JVM-side.

One regular expression with bounded quantifiers walks over a text: its alternatives are ordered by
the strength of the boundary (end of text, blank line, line break, sentence, clause, word), each
consumes as much as the limit leaves room for, and the last takes characters (never parting a
letter from its accents). All matches together are the text. SQL array functions then put before
each piece what it repeats of the one before, from a sentence or word boundary on. The plan is one
projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2200, 180


def cut_pattern(room: int, least: float = 0.5) -> str:
    """Pattern whose successive matches are at most ``room`` characters and cut at the strongest boundary.

    A boundary counts from ``least`` of the room on, so that a weak early boundary is not taken
    before a later one of the same strength; words count from a tenth on.
    """
    low, word = max(1, int(room * least)), max(1, room // 10)
    return (
        "(?s)"
        rf".{{1,{room}}}\z"
        rf"|.{{{low},{room - 2}}}\n[ \t]*\n"
        rf"|.{{{low},{room - 1}}}\n"
        rf"|.{{{low},{room - 3}}}[.!?。…][\"'”’»)\]]?\s"
        rf"|.{{{low},{room - 1}}}[。！？]"
        rf"|.{{{low},{room - 2}}}[;:,]\s"
        rf"|.{{{word},{room - 1}}}\s"
        rf"|.{{1,{room}}}(?![\p{{M}}\x{{200d}}\x{{fe0f}}])"
        rf"|.{{1,{room}}}"
    )


def _tail(piece: Column, overlap: int) -> Column:
    """The end of a piece that the next repeats: from the earliest sentence, else word, within ``overlap``."""
    end = F.right(piece, F.lit(overlap))
    whole = F.length(piece) <= overlap
    sentence = F.regexp_extract(end, r"(?s)^.*?[.!?。…][\"'”’»)\]]?\s+(\S.{39,})\z", 1)
    word = F.regexp_extract(end, r"(?s)^\S*\s+(\S.*)\z", 1)
    return F.when(whole, piece).when(sentence != "", sentence).when(word != "", word).otherwise(end)


def split_pieces(items: DataFrame, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ("ord", "section"), *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, piece_no, n_pieces, overlap, text, *keep): the pieces of every item, numbered from 1.

    A text within the limit is one piece, an empty text one empty piece; a null text gives no row.
    Lengths are code points. ``overlap`` is the number of characters at the start of a piece that
    repeat the end of the one before; without them the pieces are the text. Rows stay as many as
    they come: repeated rows give repeated pieces. Columns of the input that are not named are
    ignored, so their names can't clash.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of the limit")
    room = limit - overlap
    base = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("_t"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    cores = F.when(F.length("_t") <= limit, F.array("_t")).otherwise(F.regexp_extract_all("_t", F.lit(cut_pattern(room)), F.lit(0)))
    cut = base.withColumn("_c", cores)
    before = F.concat(F.array(F.lit("")), F.transform(F.slice("_c", 1, F.greatest(F.size("_c") - 1, F.lit(0))), lambda p: _tail(p, overlap) if overlap else F.lit("")))
    pieces = F.zip_with("_c", before, lambda c, b: F.struct(F.concat(b, c).alias("text"), F.length(b).alias("overlap")))
    out = cut.select("item_id", F.size("_c").alias("n_pieces"), F.posexplode(pieces).alias("_p", "_s"), *(f"_k{i}" for i in range(len(keep))))
    return out.select("item_id", (F.col("_p") + 1).alias("piece_no"), "n_pieces", F.col("_s.overlap").alias("overlap"), F.col("_s.text").alias("text"), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)))
