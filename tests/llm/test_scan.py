import json
import random

import pytest

from papyrion.llm.scan import Editor, edits, fit_editor, header, misread, page_number, repair_blocks, repair_lines, scan_noise, _words

WORDS = "learning calibration decoder footprint throughput baseline matrix memory annotators disagreed catalogues patent claims contain coverage survey unclear training recurrent reranking attention legal contracts rulings examples sampling".split()


@pytest.fixture(scope="module")
def editor():
    vocab = {w: 500 for w in WORDS} | {"": 10_000, "low-rank": 300, "self-supervised": 300, "supervised": 300, "rank": 100, "the": 9000, "of": 9000, "and": 9000, "-13B": 100, "-large": 100}
    rare = [w.replace(a, b, 1) for w in WORDS for a, b in (("e", "c"), ("t", "f"), ("a", "@"), ("i", "!"), ("o", "0"), ("m", "rn"), ("d", "cl"), ("cl", "d"), ("li", "h"), ("s", "5"), ("l", "1"), ("g", "9")) if a in w]
    return fit_editor(vocab, rare)


def test_edits():
    assert edits("rnatrix", "matrix")[:2] in (["m", ""], ["", "m"]) and misread("rnatrix", "matrix")
    assert not misread("claim", "claims") and not misread("base", "has")
    assert misread("cahbration", "calibration") and "".join(edits("cahbration", "calibration")) == "calibration"


def test_corrections(editor):
    for bad, good in (("calibrafion", "calibration"), ("cl@ims", "claims"), ("rnernory", "memory"), ("reran9ing", None), ("contracts", None), ("kosorik", None)):
        assert editor.correct(bad) in (good, None) if good is None else editor.correct(bad) == good, bad


def test_furniture():
    for s in ("12", "- 12 -", "– 12 –", "Page 3", "Page 3 of 40", "304 / 314", "ix", "[53]", "p. 7"):
        assert page_number(s), s
    for s in ("97.1", "n = 862", "36.77% 10.28%", "in 2020.", "Table 3", "mix"):
        assert not page_number(s), s
    title = _words("Sokos: Frozen planner modules for code search")
    assert header("SOKOS: FROZEN PLANNER MODULES FOR CODE   13", title) == (True, True)
    assert header("Letters in Text Mining · Sokos: Frozen planner modules", title) == (True, False)
    assert header("Sokos  et  al.", title) == (True, False) and header("Preprint. Under review. Bebek and co-authors", title)[0]
    assert not header("the planner modules of Kosor are frozen and", title)[0]


def test_lines(editor):
    text = "The cali-\n12\nbration of low-\nrank decoder tra-\nSokos et al.\nining and self-\nsupervised mafrix."
    fixed, noise = repair_lines(text, [], "para", editor)
    assert noise == {"hyphen", "pageno", "header", "ocr"}
    assert fixed == "The calibration of low-rank decoder training and self-supervised matrix."
    assert repair_lines("Kosor-\n13B and the coverage", [], "para", editor) == ("Kosor-13B and the coverage", set())
    assert repair_lines("14\n97.1\nn = 3", [], "table", editor)[1] == set()
    assert repair_lines("", [], "para", editor) == ("", set())


def test_blocks(editor):
    b = [("title", "Sokos: Frozen planner modules"), ("meta", "Bebek et al."), ("para", "The coverage of the cali-"), ("meta", "- 4 -"), ("para", "Sokos: Frozen planner modules 5"), ("para", "bration and fhe coverage")]
    got = {i: (t, n) for i, t, n in repair_blocks([{"id": f"b{k}", "type": x, "text": t, "page": 1 + k // 3} for k, (x, t) in enumerate(b)], None, editor)}
    assert got["b1"][1] == set() and got["b2"] == ("The coverage of the calibration", {"hyphen"}) and got["b3"][1] == {"pageno"} and got["b4"][1] == {"header", "pageno"}
    assert repair_blocks([{"text": None}, "x", {"id": 1}], None, editor) == [("1", "", set())]


def test_records(spark, rows):
    schema = "tbl string, rec_id string, text string, title string, kind string"
    rng = random.Random(2)
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(30))
    data = [("chunk", f"c{i}", say(), "T", "para") for i in range(60)]
    data += [("chunk", f"n{i}", say() + " " + w, "T", "para") for i, w in enumerate(("calibrafion", "covcrage", "fraining", "rnemory", "rnatrix", "m@trix", "attenfion"))]
    data += [("chunk", "h", say() + " cali-\n12\nbration " + say(), None, None), ("chunk", "h", None, None, None), (None, None, "x", None, None), ("chunk", "e", "", None, "para"), ("parse_cache", "s", "{broken", None, None), ("parse_cache", "t", json.dumps([{"id": "b1", "type": "para", "text": "Page 3"}]), None, None), ("chunk", "long", say() * 3000, None, "para")]
    got = rows(scan_noise(spark.createDataFrame(data + data[:5], schema).withColumn("noise", __import__("pyspark").sql.functions.lit(1))))
    assert {g for g in got if g[1] in ("h", "t")} == {("chunk", "h", "", "hyphen"), ("chunk", "h", "", "pageno"), ("parse_cache", "t", "b1", "pageno")}
    assert not [g for g in got if g[1].startswith("c") or g[1] in ("e", "s", "long")]
    assert len([g for g in got if g[1].startswith("n") and g[3] == "ocr"]) >= 6
    assert scan_noise(spark.createDataFrame([], schema)).count() == 0


def test_editor_without_training():
    assert Editor({}).correct("word") is None


def test_frequent_misreadings_and_rare_words(spark):
    from papyrion.llm.scan import fit

    rng = random.Random(5)
    say = lambda n=12: " ".join(rng.choice(WORDS) for _ in range(n))
    data = [("chunk", f"c{i}", say(), None, "para") for i in range(6000)]
    noisy = [(w, w.replace(a, b, 1)) for w in WORDS for a, b in (("e", "c"), ("t", "f"), ("o", "0")) if a in w]
    data += [("chunk", f"n{i}", say() + " " + noisy[i % len(noisy)][1], None, "para") for i in range(150)]
    data += [("chunk", f"m{i}", "covcrage " + say(5), None, "para") for i in range(20)]  # in more than 1/1000 of the texts
    data += [("chunk", f"r{i}", "branches " + say(5), None, "para") for i in range(6)]  # in less
    data += [("chunk", "x", "these branchcs", None, "para"), ("chunk", "y", "Branchcs", None, "para")]
    df = spark.createDataFrame(data, "tbl string, rec_id string, text string, title string, kind string")
    editor = fit(df)
    assert "covcrage" not in editor.vocab and "coverage" in editor.vocab and "branches" not in editor.vocab
    got = {r.rec_id for r in scan_noise(df).filter("noise = 'ocr'").collect()}
    assert {f"m{i}" for i in range(20)} | {"x", "y"} <= got and not [g for g in got if g[0] in "cr"]


def test_header_of_any_wording_repeated_over_pages(editor):
    b = []
    for page in (1, 2, 3, 4):
        if page > 1:
            b.append({"id": f"h{page}", "type": "para", "page": page, "text": "Kosor and colleagues"})
        b += [{"id": f"p{page}{k}", "type": "para", "page": page, "text": f"The coverage of the calibration number {k} and the decoder of the survey."} for k in range(4)]
    got = {i: n for i, _, n in repair_blocks(b, None, editor)}
    assert {i for i, n in got.items() if n} == {"h2", "h3", "h4"} and got["h2"] == {"header"}
    # the same line in the middle of its pages, or once, is text; so are numbers in tables
    middle = [x for x in b if x["id"][0] == "p"]
    for page, at in ((2, 6), (3, 11)):
        middle.insert(at, {"id": f"m{page}", "type": "para", "page": page, "text": "Kosor and colleagues"})
    assert not any(n for _, _, n in repair_blocks(middle, None, editor))
    table = [{"id": f"n{p}", "type": "para", "page": p, "text": "97 12 31"} for p in (1, 2, 3)]
    assert not any(n for _, _, n in repair_blocks(table, None, editor))


def test_page_number_that_goes_with_the_page(editor):
    b = [{"id": f"{p}{k}", "type": "para", "page": p, "text": "The coverage of the calibration and the decoder of the survey." if k != 3 else str(40 + p)} for p in (1, 2, 3) for k in range(6)]
    assert {i for i, _, n in repair_blocks(b, None, editor) if "pageno" in n} == {"13", "23", "33"}


def test_letters_of_other_scripts_stay(editor):
    for text in ("Let α and β be the rates. Привет мир", "Đo độ chính xác của mô hình", "x² ≥ ½"):
        assert repair_lines(text, [], "para", editor) == (text, set())
    assert repair_lines("Привет мир and fhe calibrafion of\nthe survey α", [], "para", editor)[0].startswith("Привет мир and") and "calibration" in repair_lines("Привет calibrafion", [], "para", editor)[0]


def test_line_that_interrupts_a_word(editor):
    assert repair_lines("The cali-\nKosor and colleagues\nbration of the survey.", [], "para", editor) == ("The calibration of the survey.", {"header", "hyphen"})


def test_header_lines_repeated_over_the_pages_of_a_document(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    data = [("chunk", f"c{i}", f"The {say(8)}\nKosor and colleagues {i}\n{say(8)}.", None, "para", i, "p") for i in range(5)]
    data += [("chunk", "d", f"The {say(8)}\nKosor and colleagues 7\n{say(8)}.", None, "para", 3, "q"), ("chunk", "e", f"The {say(8)}\nPage 9\n{say(8)}.", None, "para", 1, "p")]
    got = {(r.rec_id, r.noise) for r in scan_noise(spark.createDataFrame(data, "tbl string, rec_id string, text string, title string, kind string, page int, doc string")).collect()}
    assert got == {(f"c{i}", x) for i in range(5) for x in ("header", "pageno")} | {("e", "pageno")}


def test_words_too_frequent_for_a_misreading(spark):
    from papyrion.llm.scan import repaired

    rng = random.Random(6)
    say = lambda n=12: " ".join(rng.choice(WORDS) for _ in range(n))
    noisy = [w.replace(a, b, 1) for w in WORDS for a, b in (("e", "c"), ("t", "f")) if a in w]
    data = [("chunk", f"c{i}", say(), None, "para") for i in range(8000)] + [("chunk", f"n{i}", say() + " " + noisy[i % len(noisy)], None, "para") for i in range(120)]
    data += [("chunk", f"t{i}", say() + " tables cables", None, "para") for i in range(60)] + [("chunk", f"e{i}", say() + " fables", None, "para") for i in range(5)]
    df = spark.createDataFrame(data, "tbl string, rec_id string, text string, title string, kind string")
    assert not {r.rec_id for r in scan_noise(df).collect() if r.rec_id[0] in "te"}
    assert {r.rec_id: r.text for r in repaired(df).collect()}["e0"].endswith("fables")
