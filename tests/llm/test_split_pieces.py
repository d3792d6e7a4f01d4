import random

import pytest

from papyrion.llm.split_pieces import split_pieces

SCHEMA = "id string, text string, ord int, section string"


def pieces(spark, texts, **kw):
    df = spark.createDataFrame([(str(i), t, i, "s") for i, t in enumerate(texts)], SCHEMA)
    out = {}
    for r in sorted(split_pieces(df, **kw).collect(), key=lambda r: (r.item_id, r.piece_no)):
        out.setdefault(r.item_id, []).append(r)
    return out


def check(parts, text, limit, overlap):
    assert [p.piece_no for p in parts] == list(range(1, len(parts) + 1))
    assert all(len(p.text) <= limit and p.n_pieces == len(parts) for p in parts)
    assert parts[0].text[parts[0].overlap :] + "".join(p.text[p.overlap :] for p in parts[1:]) == text
    for a, b in zip(parts, parts[1:]):
        assert b.overlap <= overlap and a.text.endswith(b.text[: b.overlap])


def test_round_trip_of_any_text(spark):
    rng = random.Random(1)
    alphabet = ["a", "word ", ". ", "! ", "\n", "\n\n", ", ", "漢", "。", "é", "😀", " ", "\t", "-", "z" * 40]
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 5, 90, 100, 101, 400, 3000)] + ["x" * 1001, "a b " * 600, "\n" * 500]
    for i, parts in pieces(spark, texts, limit=100, overlap=20).items():
        check(parts, texts[int(i)], 100, 20)


def test_production_limits_and_boundaries(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(400))
    parts = pieces(spark, [text])["0"]
    check(parts, text, 2200, 180)
    assert all(p.text.rstrip().endswith(".") and p.text.startswith("Sentence") for p in parts)
    assert all(0 < p.overlap for p in parts[1:])


def test_stronger_boundaries_win(spark):
    text = ("a" * 60 + "\n\n") + ("b" * 25 + ". ") + "c" * 60
    assert pieces(spark, [text], limit=100, overlap=0)["0"][0].text.endswith("\n\n")


def test_accents_stay_with_their_letter(spark):
    text = "é" * 300
    for p in pieces(spark, [text], limit=101, overlap=0)["0"]:
        assert not p.text.startswith("́")


def test_edges(spark):
    df = spark.createDataFrame([("n", None, 1, None), ("e", "", 2, "s"), ("x", "y" * 2200, 3, "s"), ("x", "y" * 2200, 3, "s")], SCHEMA)
    got = split_pieces(df.withColumn("piece_no", df.ord).withColumn("_c", df.text)).collect()
    assert sorted((r.item_id, r.n_pieces, len(r.text)) for r in got) == [("e", 1, 0), ("x", 1, 2200), ("x", 1, 2200)]
    assert split_pieces(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        split_pieces(df, limit=100, overlap=60)


def test_very_long_text(spark):
    text = "word, " * 200_000
    parts = pieces(spark, [text])["0"]
    check(parts, text, 2200, 180)
