"""Hand-worked cases of the corpus, search, graph, structure, check and memo operators."""

import random

from pyspark.sql import functions as F

from papyrion.functions import text as T
from papyrion.operators import biblio, blocks, corpus, graph, memo, search, tree, verify


def one(spark, c, v):
    return spark.createDataFrame([(v,)], "x string").select(c(F.col("x")).alias("y")).first().y


def test_numbers(spark):
    for text, want in (("Qwen2.5-7B", ["7"][:0]), ("100M", []), ("GPT-4", ["4"]), ("62.3M", ["62"]), ("42,5%", ["42,5"]), ("see github.com/52566rz/x", [])):
        assert one(spark, T.numbers, text) == want, text
    assert {"100"} <= set(one(spark, T.source_numbers, "100M")) and {"62.3"} <= set(one(spark, T.source_numbers, "62.3M"))
    assert set(one(spark, T.source_numbers, "1,000")) == {"1", "1000"}
    for a, b in (("1,5", "1.5"), ("10.0", "10"), ("100", "100"), ("1,000", "1")):
        assert one(spark, T.norm_number, a) == b


def test_text(spark):
    assert one(spark, T.norm_name, "  BERT-Large (v2)!  ") == "bert large v2"
    assert spark.range(1).select(T.clip_words(F.lit("one two, three four"), 12).alias("y")).first().y == "one two…"
    assert one(spark, T.tokens, "Bộ nhớ ĐỆM x1") == ["bo", "nho", "đem", "x1"]
    assert spark.range(1).select(T.strip_markup(F.lit("a **b** `c` *d* 2*3")).alias("y")).first().y == "a b c d 2*3"


def test_rrf_and_diversity(spark):
    a = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abc")], "qid int, id string, rank int")
    b = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("cad")], "qid int, id string, rank int")
    got = [(r.id, r.score) for r in search.ranked(search.rrf([a, b])).orderBy("rank").collect()]
    assert [x for x, _ in got] == list("acbd") and abs(got[0][1] - (1 / 61 + 1 / 62)) < 1e-8
    hits = [(1, f"x{i}", "p1" if i < 8 else "p2", i + 1) for i in range(12)]
    top = search.diversify(spark.createDataFrame(hits, "qid int, id string, paper_id string, rank int"), 6).orderBy("place").collect()
    assert [r.paper_id for r in top] == ["p1"] * 3 + ["p2"] * 3


def test_bm25_properties(spark):
    docs = [("a", "cache memory cache", None, None, "t", None), ("b", "memory of a tree", None, "bộ nhớ", "t", None), ("c", None, None, None, None, None), ("d", "planner", "x", None, "other", "s")]
    c = spark.createDataFrame(docs, "id string, text string, ctx string, vi string, title string, section string")
    q = spark.createDataFrame([(1, "cache"), (2, "bo nho"), (3, '"(*'), (4, None)], "qid int, q string")
    got = {(r.qid, r.id) for r in search.bm25(c, q).collect()}
    assert got == {(1, "a"), (2, "b")}


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (2, "d", 1.0)], "qid int, id string, score double")
    grades = spark.createDataFrame([(1, "a", 0), (1, "c", 3)], "qid int, id string, grade int")
    got = [(r.qid, r.id, r.grade) for r in search.rerank(hits, grades).orderBy("qid", "place").collect()]
    assert got == [(1, "c", 3), (1, "b", 1), (2, "d", 2)]


def test_upsert_keeps_old_for_empty(spark):
    old = spark.createDataFrame([("k", "x", 1), ("o", "y", 2)], "key string, vi string, hits int")
    new = spark.createDataFrame([("k", "", 3), ("n", "z", 1)], "key string, vi string, hits int")
    got = {r.key: (r.vi, r.hits) for r in corpus.keep_old_if_empty(old, new, "key", ["vi"], "hits").collect()}
    assert got == {"k": ("x", 4), "o": ("y", 2), "n": ("z", 1)}


def test_latest_and_fingerprint(spark):
    df = spark.createDataFrame([("a", "s", "new", "2024-01-01"), ("a", "s", "old", "2023-01-01"), ("b", "s", None, "2023-01-01")], "id string, survey_id string, status string, u string").withColumn("updated_at", F.to_timestamp("u"))
    now = corpus.latest(df, "id", "updated_at")
    assert {r.id: r.status for r in now.collect()} == {"a": "new", "b": None}
    f1 = corpus.fingerprint(now).first().fp
    assert f1 == corpus.fingerprint(now.orderBy(F.desc("id"))).first().fp
    assert f1 != corpus.fingerprint(now.withColumn("status", F.lit("x"))).first().fp


def test_graph(spark):
    c = spark.createDataFrame([("c1", "p1", 0, "Alpha extends Betta with a head."), ("c2", "p2", 0, "Built on top of Betta, Gamma adds a tree. Alpha extends Alpha with x."), ("c3", "p2", 0, None)], "id string, paper_id string, level int, text string")
    p = spark.createDataFrame([("p1", "s", 2020), ("p2", "s", None)], "id string, survey_id string, year int")
    e = graph.edges_from_text(c, p)
    assert sorted((r.src_name, r.dst_name, r.rel) for r in e.collect()) == [("Alpha", "Betta", "extends"), ("Gamma", "Betta", "builds_on")]
    ent = {r.name: r.papers for r in graph.entities(e).collect()}
    assert ent == {"Alpha": 1, "Betta": 2, "Gamma": 1}
    assert [r.src_name for r in graph.lineage(e, p).orderBy("step").collect()] == ["Gamma", "Alpha"]


BLOCKS = "doc string, pos int, id string, type string, text string, section string, level int, page int, translate boolean, marker string, cont boolean, hidden boolean"


def block_rows(*items):
    return [("d", i, f"b{i}", k, t, "", 0, 1, True, "", False, False) for i, (k, t) in enumerate(items)]


def test_stitch(spark):
    b = spark.createDataFrame(block_rows(("para", "They differ-"), ("caption", "Figure 1: x"), ("para", "ent in parts"), ("para", "Upper-"), ("para", "Case starts"), ("para", "other-"), ("heading", "Method"), ("para", "wise no")), BLOCKS)
    assert [r.text for r in blocks.stitch_hyphenated(b).orderBy("pos").collect()] == ["They different in parts", "Upper-", "Case starts", "other-", "wise no"]


def test_passages(spark):
    ref = "[1] Smith, J. and Doe, K. A work. In Proceedings of the Meeting, 2020. pp. 3"
    b = spark.createDataFrame(
        block_rows(("heading", "Intro"), ("para", "a " * 500), ("para", "b " * 400), ("equation", "x = 1"), ("heading", "Method"), ("para", "short"), ("meta", "nobody"), ("para", ref), ("heading", "References"), ("para", "gone"), ("heading", "Appendix A"), ("para", "kept")), BLOCKS
    )
    got = [(r.ord, r.section, r.kind, r.text[:12]) for r in blocks.passages(b).orderBy("ord").collect()]
    assert [g[1] for g in got] == ["Intro", "Intro", "Intro", "Method", "Appendix A"] and got[1][3].startswith("…") and got[2][2] == "equation"
    assert not any("gone" in g[3] or "[1]" in g[3] for g in got)


def test_hard_split_and_caption(spark):
    parts = spark.createDataFrame([("A sentence here. " * 300,)], "t string").select(blocks.sentence_parts(F.col("t")).alias("p")).first().p
    assert all(len(p) <= 1300 for p in parts) and len(parts) > 3
    df = spark.createDataFrame([("Fig. 3: x",), ("Table 2 summarizes",), ("Table 12. y",)], "t string")
    assert [r.k for r in df.select(blocks.caption_key(F.col("t")).alias("k")).collect()] == ["fig3", "", "table12"]


def test_clusters(spark):
    rows = [("p", f"c{i}", i, "A" if i < 9 else "B" if i < 10 else "C") for i in range(12)]
    c = spark.createDataFrame(rows, "paper_id string, id string, ord int, section string")
    got = [(r.run, r.cluster) for r in tree.fixed_clusters(c).join(c, "id").orderBy("ord").collect()]
    assert got == [(1, 0)] * 6 + [(1, 1)] * 4 + [(2, 0)] * 2
    import numpy as np

    assert tree.cut_group(np.array([0.9] * 6), 7) == [] and tree.cut_group(np.array([0.9, 0.9, 0.9, 0.1, 0.9, 0.9, 0.9, 0.9]), 9) == [3]


def test_lints(spark):
    f = lambda t: spark.createDataFrame([(t,)], "x string").select(verify.lints(F.col("x")).alias("y")).first().y
    assert f("Mô hình cải thiện độ chính xác.") == ["vague"]
    assert f("Mô hình cải thiện độ chính xác vì dùng thêm dữ liệu.") == []
    assert f("một hai ba bốn năm sáu bảy tám chín mười mười một mười hai") == ["no_mechanism"]
    assert "filler" in f("Điều này đóng vai trò quan trọng, vì nó nhanh.")
    assert f(None) in ([], None)


def test_grounding(spark):
    s = verify.sentences(spark.createDataFrame([("a", "# Head\nIt holds 5 items [c12]. It gains 62,3% here.\n\nNo number.")], "id string, t string"), "id", "t")
    assert [(r.text, r.cites) for r in s.orderBy("i").collect()][0] == ("It holds 5 items [c12].", ["c12"])
    assert [r.i for r in verify.uncited_numbers(s).collect()] == [1]
    allowed = spark.createDataFrame([("a", "c99")], "id string, cite string")
    assert [r.cite for r in verify.unknown_citations(s, allowed).collect()] == ["c12"]
    claims = spark.createDataFrame([("a", "62,3 and 77")], "id string, text string")
    sources = spark.createDataFrame([("a", "62.3% of 100M")], "id string, source string")
    assert [r.num for r in verify.ungrounded_numbers(claims, sources).collect()] == ["77"]
    assert spark.range(1).select(verify.script_leak(F.lit("bảo 띠 ᥕ 漢"), F.lit("漢")).alias("x")).first().x == sorted("띠ᥕ")


def test_biblio_and_memo(spark):
    r = spark.createDataFrame([(1, "10.1/X", "T", None, 3, "a"), (2, "10.1/x", "", "V", 9, "b"), (3, None, None, "W", 1, "c"), (4, None, "My Title!", None, None, "d"), (5, "", "my title", "Z", 2, None)], "o int, doi string, title string, venue string, cites int, source string")
    got = {x.k: (x.title, x.venue, x.cites, x.source) for x in biblio.dedup(r, "o", ["title", "venue"]).collect()}
    assert got == {"10.1/x": ("T", "V", 9, "a+b"), "my title": ("My Title!", "Z", 2, "d")}
    c = spark.createDataFrame([("u", i, 0.004) for i in range(5)], "u string, i int, cost double")
    assert memo.within_budget(c, "u", ["i"], "cost", 0.01).count() == 3 and memo.within_budget(c, "u", ["i"], "cost", 0.0).count() == 5


def test_inputs_in_any_order(spark):
    rows = block_rows(*[("para" if i % 3 else "heading", f"text {i} goes on-") for i in range(30)])
    a = blocks.sticky_section(spark.createDataFrame(rows, BLOCKS)).select("pos", "sec").collect()
    random.Random(0).shuffle(rows)
    b = blocks.sticky_section(spark.createDataFrame(rows, BLOCKS)).select("pos", "sec").collect()
    assert sorted(a) == sorted(b)
