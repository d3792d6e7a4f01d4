from papyrion.llm.fold import visible
from papyrion.llm.lookalike import candidate, dominant, same_looking, suspicious

SCHEMA = "tbl string, id string, text string"


def test_visible_form():
    assert visible("ａ b‑c​dﬁ é 𝖺 x²") == "a b-cdfi é a x²"
    assert visible("A\nb\tc") == "A\nb c"
    assert visible("ủ") == "ủ" and visible("1⁵") == "1⁵"


def test_candidates():
    text = "Some ordinary words: аnd оf Вig, α + β"
    assert dominant(text) == "LATIN"
    got = dict(suspicious(text))
    assert got["аnd"] == "and" and got["оf"] == "of" and got["Вig"] == "Big" and "α" not in got
    assert candidate("α61β88", "LATIN") is None
    assert candidate("привет", "CYRILLIC") is None and candidate("cтол", "CYRILLIC") == "стол"


def test_pairs(spark, rows):
    data = [
        ("chunk", "a", "the noise filter and the cache"),
        ("chunk", "b", "the noise ﬁlter аnd the cache"),
        ("chunk", "c", "the nоise filter and the cаche"),
        ("chunk", "d", "The noise filter and the cache"),
        ("chunk", "e", "the noise filter and the cache"),
        ("chunk", "a", "the noise filter and the cache"),
        ("tm", "f", "the noise filter and the​ cache"),
        ("chunk", "g", None), ("chunk", "h", ""), ("chunk", "i", "​"), ("chunk", "j", " "), ("chunk", None, "the noise"),
        ("chunk", "k", "x² + α"), ("chunk", "l", "x2 + α"), ("chunk", "m", "x² + a"),
        ("chunk", "n", "z" * 100_000), ("chunk", "o", "z" * 100_000 + "​"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    want = [("chunk", "a", "b"), ("chunk", "a", "c"), ("chunk", "b", "c"), ("chunk", "b", "e"), ("chunk", "c", "e"), ("chunk", "n", "o")]
    assert rows(same_looking(df.withColumn("form", df.id).withColumn("raw", df.text))) == want
    assert same_looking(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_group_is_salted(spark, monkeypatch):
    import papyrion.llm.lookalike as L

    monkeypatch.setattr(L, "PER_SALT", 7)
    data = [("chunk", f"p{i:03d}", "plain words here") for i in range(60)] + [("chunk", f"q{i}", "plain words here") for i in range(3)]
    got = L.same_looking(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len({tuple(r) for r in got}) == 180


def test_a_text_does_not_vouch_for_itself(spark, rows):
    """One text in many rows is one text, at any partitioning; two different ones vouch for each other."""
    data = [("chunk", f"r{i}", "we saw хосо there") for i in range(8)]
    two = [("chunk", "u", "one саусе of it"), ("chunk", "v", "one cаусe of it")]
    for parts in (1, 64):
        df = spark.createDataFrame(data + two, SCHEMA).repartition(parts)
        assert rows(same_looking(df)) == [("chunk", "u", "v")]


def test_classes_hold_each_record_once(spark):
    from papyrion.llm.lookalike import look_classes

    data = [("chunk", f"p{i:03d}", "plain words here") for i in range(60)] + [("chunk", f"q{i}", "plain\u200b words here") for i in range(3)] + [("chunk", "z", "alone"), ("chunk", "n", None)]
    got = look_classes(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 63 and {(r.n_texts, r.n_records) for r in got} == {(2, 63)} and len({r["class"] for r in got}) == 1
    assert look_classes(spark.createDataFrame([], SCHEMA)).count() == 0
