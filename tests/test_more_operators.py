"""Small cases of the operators that SQL does not cover whole: folds, greedy choices, trees, edges of the inputs."""

import random

from pyspark.sql import functions as F

from papyrion.operators import classify as K
from papyrion.operators import deck as D
from papyrion.operators import exchange as X
from papyrion.operators import index as Ix
from papyrion.operators import search as S
from papyrion.operators import shaping as Sh
from papyrion.operators import store as St
from papyrion.operators import tree as Tr

BLOCKS = "doc string, pos int, id string, type string, text string, page int, hidden boolean"


def blocks(spark, *rows, doc="d"):
    return spark.createDataFrame([(doc, i, f"b{i}", t, x, 1, h) for i, (t, x, h) in enumerate(r if len(r) == 3 else (*r, False) for r in rows)], BLOCKS)


def run_ons_by_hand(rows, most=2):
    """Paragraphs joined one after the other, as a reader would."""
    out, open_, floats = [], False, 0
    for kind, text in rows:
        if kind == "para" and text.strip():
            if open_ and text[:1].islower() and floats <= most:
                out[-1] += " " + text
            else:
                out.append(text)
                floats = 0
            open_ = text[-1] not in ".!?:;" and not text.endswith("-")
        elif kind in K.FLOATS:
            floats += 1
        else:
            open_ = False
    return out


def test_run_ons_against_a_walk(spark):
    rng = random.Random(3)
    for seed in range(12):
        rows = [(rng.choice(["para", "para", "para", "caption", "equation", "heading"]), rng.choice(["we say that", "and more of it", "The end.", "Another one", "it stops here.", "bro-"])) for _ in range(14)]
        got = [r.text for r in K.run_ons(blocks(spark, *rows)).orderBy("pos").collect()]
        assert got == run_ons_by_hand(rows), rows


def test_run_ons_edges(spark):
    assert K.run_ons(blocks(spark, ("para", None), ("para", ""), ("para", "a b"), ("para", "c", True), ("para", "d"))).count() == 2  # a hidden block is no float
    assert K.run_ons(spark.createDataFrame([], BLOCKS)).count() == 0


def test_pasted_text(spark):
    text = "A title of it\n\nIntroduction\n\nSome words that are bro-\nken over lines, and they\nend here.\n\nFigure 1: a thing\n\nReferences\n\nConclusion\n\n\n"
    df = spark.createDataFrame([("x", text), ("n", None), ("e", " \n\n "), ("s", "Only one sentence that ends.")], "id string, text string")
    got = {(r.doc, r.id): (r.type, r.section, r.translate) for r in K.typed_text(df, "id", "text").collect()}
    assert got[("x", "b1")] == ("title", "", False) and got[("x", "b3")] == ("para", "Introduction", True) and got[("x", "b4")][0] == "caption"
    assert got[("x", "b5")] == ("heading", "References", False) and got[("x", "b6")] == ("reference", "References", False)
    assert got[("s", "b1")][0] == "para" and not [k for k in got if k[0] in "ne"]
    assert [r.text for r in K.typed_text(df, "id", "text").filter("id = 'b3'").collect()] == ["Some words that are broken over lines, and they end here."]


def test_headings(spark):
    level = lambda t, rel=1.0, bold=False: spark.createDataFrame([(t,)], "t string").select(K.heading_level(F.col("t"), F.lit(rel), F.lit(bold)).alias("l")).first().l
    assert [level(x) for x in ("Related Work:", "3.1 Two parts", "835 Teutberga", "IV. Results of it", "Model", "word", "", "A sentence that ends.")] == [1, 2, 0, 1, 0, 0, 0, 0]
    assert level("Model", 1.1) == 1 and level("Large words here", 1.3) == 1 and level("Bold words here", 1.03, True) == 2


def test_list_items(spark):
    rows = [("a", "We do:\n• one\nmore\n• two"), ("b", "1. one\n2. two\n3. three"), ("c", "1. one\n3. two"), ("d", "(i) one\n(ii) two"), ("e", None), ("f", "")]
    got = {}
    for r in K.list_items(spark.createDataFrame(rows, "id string, t string"), "id", "t").orderBy("id", "no").collect():
        got.setdefault(r.id, []).append((r.marker, r.text))
    assert got == {"a": [("", "We do:"), ("•", "one\nmore"), ("•", "two")], "b": [("1.", "one"), ("2.", "two"), ("3.", "three")]}


def greedy(captions, regions):
    first = {}
    for r, key, _ in sorted(regions):
        if key:
            first.setdefault(key, r)
    out, used = {}, set()
    for _, i, key, _ in sorted(captions):
        if key in first and first[key] not in used:
            out[i] = first[key]
            used.add(first[key])
    for _, i, _, y in sorted(captions):
        free = [(abs(ry - y), r) for r, _, ry in regions if r not in used]
        if i not in out and free:
            out[i] = min(free)[1]
            used.add(out[i])
    return out


def test_captions_to_regions_against_a_walk(spark):
    rng = random.Random(7)
    for _ in range(6):
        caps = [(p, f"c{p}", rng.choice(["", "fig1", "fig2", "table1"]), float(rng.randrange(100))) for p in range(5)]
        regs = [(f"r{k}", rng.choice(["", "", "fig1", "table1"]), float(rng.randrange(100))) for k in range(rng.randrange(0, 6))]
        c = spark.createDataFrame([("d", 1, *x) for x in caps], "doc string, page int, pos int, id string, key string, y double")
        r = spark.createDataFrame([("d", 1, *x) for x in regs], "doc string, page int, region string, key string, y double")
        assert {x.id: x.region for x in Sh.captions_to_regions(c, r).collect()} == greedy(caps, regs)


def test_summary_tree(spark):
    leaves = spark.createDataFrame([("p", f"pc{i}", i, "A" if i < 30 else "B", f"text {i}") for i in range(60)] + [("q", "qc1", 1, None, None)], "paper_id string, id string, ord int, section string, text string")
    t = Sh.summary_tree(leaves).collect()
    assert {r.paper_id for r in t} == {"p"}
    by = {k: [r for r in t if r.level == k] for k in (1, 2, 3)}
    assert len(by[1]) == 10 and len(by[2]) == 2 and not by[3] and len({r.id for r in t}) == 12
    assert sum(len(r.children) for r in by[1]) == 60 and {c for r in by[2] for c in r.children} == {r.id for r in by[1]}


def test_cut_group_leaves_no_passage_alone():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in range(1, 40):
        cuts = Tr.cut_group(rng.random(max(n - 1, 0)), n)
        parts = np.diff([-1, *cuts, n - 1])
        assert n < 2 or (parts.sum() == n and (len(cuts) == 0 or parts.min() >= 2))


def test_graph_put_and_move(spark):
    ents = spark.createDataFrame([("s1", "p1", 1, "Our method", "model", "p1c1"), ("s1", "p1", 2, "Kosor", " Model ", "p1c1"), ("s1", "p1", 3, "KOSOR", "dataset", "p1c2"), ("s1", "p1", 4, "x", None, None), ("s1", "p1", 5, "Zalik", "gadget", "q9c1"), ("s1", "p1", 6, None, None, None)], "survey_id string, paper_id string, no int, name string, kind string, chunk string")
    clean = {r.norm: (r.name, r.kind, r.chunks) for r in St.clean_entities(ents).collect()}
    assert clean == {"kosor": ("Kosor", "model", ["p1c1", "p1c2"]), "zalik": ("Zalik", "concept", [])}
    e0 = spark.createDataFrame([], "id string, survey_id string, norm string, name string, kind string, papers long")
    m0 = spark.createDataFrame([], "entity_id string, chunk_id string, paper_id string")
    g0 = spark.createDataFrame([], "survey_id string, src string, dst string, rel string, paper_id string, chunk_id string")
    rels = St.clean_edges(spark.createDataFrame([("s1", "p1", 1, "Kosor", "Zalik", "extends", "p1c1"), ("s1", "p1", 2, "Kosor", "Nobody", "extends", "p1c1"), ("s1", "p1", 3, "Kosor", "kosor", "extends", "p1c1"), ("s1", "p1", 4, "Kosor", "Zalik", "likes", "p1c1")], "survey_id string, paper_id string, no int, src string, dst string, rel string, chunk string"), St.clean_entities(ents), ("extends",))
    entity, mention, edge = St.put_graph(e0, m0, g0, St.clean_entities(ents), rels)
    assert edge.count() == 1 and {(r.name, r.papers) for r in entity.collect()} == {("Kosor", 1), ("Zalik", 1)}
    moved, m2, e2 = St.move_papers(spark.createDataFrame([("p1", "s2")], "paper_id string, to string"), entity, mention, edge)
    assert {r.survey_id for r in moved.collect()} == {"s2"} and e2.first().survey_id == "s2" and m2.count() == mention.count()
    assert not {r.id for r in moved.collect()} & {r.id for r in entity.collect()}
    assert St.drop_papers(spark.createDataFrame([("p1",)], "paper_id string"), entity, mention, edge)[0].count() == 0


def test_flowchart(spark):
    t = 'flowchart LR\nA["x --> y"] --> B(two) -->|yes| C{three}\nC --- D; D ==> A\nnothing here'
    got = {(r.src, r.dst) for r in D.flowchart(spark.createDataFrame([(1, t), (2, None)], "id int, t string"), "id", "t").collect()}
    assert got == {("A", "B"), ("B", "C"), ("C", "D"), ("D", "A")}


def test_web_rows_and_patches(spark):
    j = spark.createDataFrame([('{"organic": [{"title": "T", "link": "https://x/PDF/a", "snippet": null}]}',), ("{broken",), (None,)], "j string")
    assert [tuple(r) for r in X.web_rows(j, "serper", "j").collect()] == [("T", "https://x/PDF/a", "https://x/PDF/a", "")]
    rows = spark.createDataFrame([("a", "t", "v"), ("b", None, "w")], "id string, title string, venue string")
    patch = spark.createDataFrame([("a", 1, "title", "x"), ("a", 2, "title", None), ("b", 1, "id", "z"), ("c", 1, "title", "q")], "id string, no int, field string, value string")
    assert sorted(map(tuple, X.whitelisted(rows, patch, "id", ["title", "venue"]).collect())) == [("a", None, "v"), ("b", None, "w")]


def test_stored_index_answers_like_a_fresh_one_and_follows_the_table(spark, tmp_path):
    path = str(tmp_path / "chunk.parquet")
    rows = [(f"c{i}", f"alpha beta {'gamma' if i % 3 else 'delta'} {i}", None, None, "a title", "s") for i in range(40)] + [("n", None, None, None, None, None)]
    cols = "id string, text string, ctx string, vi string, title string, section string"
    q = spark.createDataFrame([(1, "gamma title"), (2, "delta 7"), (3, "nothing known")], "qid int, q string")
    spark.createDataFrame(rows, cols).write.parquet(path)
    fresh = {(r.qid, r.id): round(r.score, 9) for r in S.bm25(spark.read.parquet(path), q).collect()}
    one = Ix.ready(spark, path, spark.read.parquet(path))
    assert {(r.qid, r.id): round(r.score, 9) for r in Ix.scored(spark, one, q).collect()} == fresh and fresh
    assert Ix.ready(spark, path, spark.read.parquet(path)) == one
    spark.createDataFrame(rows[:20], cols).write.mode("overwrite").parquet(path)
    two = Ix.ready(spark, path, spark.read.parquet(path))
    assert two != one and {r.id for r in Ix.scored(spark, two, q).collect()} <= {f"c{i}" for i in range(20)}
    spark.createDataFrame([], cols).write.mode("overwrite").parquet(path)
    assert Ix.scored(spark, Ix.ready(spark, path, spark.read.parquet(path)), q).count() == 0


def test_many_terms_are_joined_with_the_same_result(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "chunk.parquet")
    cols = "id string, text string, ctx string, vi string, title string, section string"
    spark.createDataFrame([(f"c{i}", f"alpha beta gamma{i % 4} {i}", None, None, "a title", "s") for i in range(30)], cols).write.parquet(path)
    chunk, q = spark.read.parquet(path), spark.createDataFrame([(1, "gamma1 title"), (2, "beta 7 alpha")], "qid int, q string")
    of = lambda df: {(r.qid, r.id): round(r.score, 9) for r in df.collect()}
    monkeypatch.setattr(Ix, "PER_BUCKET", 4)  # several buckets
    listed = of(Ix.scored(spark, Ix.ready(spark, path, chunk), q))
    fresh = of(S.bm25(chunk, q))
    monkeypatch.setattr(Ix, "LISTED_TERMS", 1)
    monkeypatch.setattr(S, "LISTED_TERMS", 1)
    assert of(Ix.scored(spark, Ix.ready(spark, path, chunk), q)) == listed == fresh == of(S.bm25(chunk, q)) and listed


def test_small_inputs_are_spread_without_loss(spark):
    from papyrion.session import spread

    one = spark.range(1000).coalesce(1)
    many = spark.range(1000).repartition(16)
    assert spread(one).rdd.getNumPartitions() > 1 and spread(one).count() == 1000 and spread(many).rdd.getNumPartitions() == 16 and spread(many).count() == 1000


def test_items_to_blocks(spark):
    rows = [
        ("A Person", 0, 100.0, 10.0, True), ("Abstract", 0, 120.0, 12.0, True), ("We say that", 0, 140.0, 10.0, True), ("it goes on here.", 0, 160.0, 10.0, True), ("17", 0, 780.0, 10.0, True),
        ("* Corresponding author of it", 0, 700.0, 9.0, True), ("Axis label", 1, 50.0, 8.0, False), ("References", 1, 100.0, 12.0, True), ("Bebek, A. A work. 2020.", 1, 120.0, 10.0, True), ("Appendix A", 2, 50.0, 12.0, True), ("Its text stands here.", 2, 70.0, 10.0, True),
    ]
    from papyrion.operators.classify import blocks_of_items

    schema = "doc string, pos int, text string, page int, y0 double, size double, body boolean, page_h double, modal double, bold boolean, marker string"
    it = spark.createDataFrame([("d", i, *r, None, 10.0, False, "") for i, r in enumerate(rows)] + [("e", 0, None, 0, 1.0, 1.0, True, None, 10.0, False, "")], schema)
    got = [(r.type, r.text, r.section) for r in blocks_of_items(it).orderBy("pos").collect()]
    assert got == [("meta", "A Person", ""), ("heading", "Abstract", "Abstract"), ("para", "We say that it goes on here.", "Abstract"), ("meta", "* Corresponding author of it", ""), ("heading", "References", "References"), ("reference", "Bebek, A. A work. 2020.", "References"), ("heading", "Appendix A", "Appendix A"), ("para", "Its text stands here.", "Appendix A")]


def test_loose_paragraphs_keep_columns_apart(spark):
    from papyrion.operators.geometry import loose_paragraphs

    spans = [(f"{c}{i}", 40.0 if c == "l" else 320.0, 14.0 * i + (80 if i > 2 else 0), f"{c}{i}") for i in range(5) for c in "lr"] + [("mid", 280.0, 700.0, "17")]
    df = spark.createDataFrame([("d", 0, 600.0, s, x, y, x + (240 if s != "mid" else 40), y + 10, t) for s, x, y, t in spans], "doc string, page int, page_w double, span_id string, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r.col, r.text) for r in loose_paragraphs(df).collect()}
    assert {(0, "l0 l1 l2"), (0, "l3 l4"), (1, "r0 r1 r2"), (1, "r3 r4")} <= got


def test_accepted_pairs_equal_the_rule(spark, rows):
    words = "does a an help on the learning sparse learn s na ve x".split()
    r = random.Random(4)
    make = lambda n: [(i if r.random() < 0.9 else i - 1, " ".join(r.choice(words) for _ in range(r.choice((0, 1, 2, 2, 3, 4, 7))))) for i in range(n)]
    a = spark.createDataFrame([(f"p{i}", t) for i, t in make(150)] + [(None, "Does a"), ("p0", None), ("h1", "on the x-ray of"), ("h2", "on the x!"), ("h3", "a a bc")], "id string, title string")
    b = spark.createDataFrame(make(200) + [(None, "does A"), (1, None), (900, "On the xs"), (901, "on the x"), (902, "a a b")] + [(950 + i, "does a help") for i in range(9)], "doc_id long, title string")
    key = lambda c: F.slice(F.split(Sh.norm_title(F.col(c)), " "), 1, 2)
    plain = a.withColumn("k", key("title")).alias("a").join(b.withColumn("k", key("title")).alias("b"), "k").filter(Sh.accepted_title(F.col("a.title"), F.col("b.title"))).select("id", "doc_id").distinct()
    wanted = rows(plain)
    assert len(wanted) > 100 and ("h3", 902) in wanted
    for block in (3, 2000):
        assert rows(Sh.accepted_pairs(a, b, rows=block)) == wanted


def test_accepted_pairs_of_one_beginning_in_many_titles(spark):
    a = spark.range(2500).select(F.col("id").cast("string"), F.format_string("Does a w%d help u%d v%d", F.col("id") % 97, F.col("id") % 89, "id").alias("title"))
    b = spark.range(12000).select(F.col("id").alias("doc_id"), F.format_string("does a w%d aid u%d t%d", F.col("id") % 97, F.col("id") % 89, "id").alias("title"))
    assert Sh.accepted_pairs(a, b).count() == sum(1 for i in range(2500) for j in range(i % 8633, 12000, 8633))


def test_first_shallow_of_places_beyond_two_million(spark, tmp_path):
    from papyrion.plans.shaped import first_shallow

    schema = "id string, paper_id string, ord int, section string, vi string, level int"
    spark.createDataFrame([("a", "p", 2_147_484, "s", "rất " * 15, 0), ("b", "p", 3_000_000, "s", "rất " * 15, 0), ("c", "p", 2_147_483_647, "t", "rất " * 15, 0)], schema).write.parquet(f"{tmp_path}/chunk.parquet")
    assert sorted(map(tuple, first_shallow(spark, str(tmp_path)).collect())) == [("p", "s", "a"), ("p", "t", "c")]
