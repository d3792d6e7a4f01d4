"""Queries that return every row and whole texts, on small tables of their own."""

import datetime as dt
import hashlib

from papyrion.plans import registry

PAPER = "id string, survey_id string, title string, year int, venue string, n_pages int, created_at timestamp_ntz, updated_at timestamp_ntz, card struct<tldr_vi string, novelty string>"
T0 = dt.datetime(2024, 1, 1)


def paper(i, survey="s", card=None, title="T", year=2020, venue=None, at=0):
    return (i, survey, title, year, venue, 1, T0 + dt.timedelta(hours=at), T0, card)


def run(spark, tmp_path, name, **tables):
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    return registry.queries()[name](spark, str(tmp_path))


def test_paper_listing_has_every_paper_in_order(spark, tmp_path):
    data = [paper(f"p{i:03}", at=200 - i) for i in range(90)] + [paper("q1", "other", at=1), paper("q0", "other", at=1)]
    got = {r.id: r.r for r in run(spark, tmp_path, "paper_listing", paper=(data, PAPER)).collect()}
    assert got == {f"p{i:03}": 90 - i for i in range(90)} | {"q0": 1, "q1": 2}


def test_facet_matrix_has_whole_cells_of_every_paper(spark, tmp_path):
    long = "x" * 59 + "|" + "y\n" * 50 + "end"
    data = [paper("a", card=(long, None)), paper("b"), paper("c", card=(None, "n"))]
    got = {r.id: (r.tldr, r.novelty) for r in run(spark, tmp_path, "facet_matrix", paper=(data, PAPER)).collect()}
    assert got == {"a": ("x" * 59 + "\\|" + "y " * 50 + "end", ""), "b": ("", ""), "c": ("", "n")}


def test_corpus_digest_reads_whole_cards(spark, tmp_path):
    same = "w" * 300
    data = [paper("b", "s1", (same + "1", "n"), year=None, venue="V"), paper("a", "s1"), paper("b2", "s2", (same + "2", "")), paper("c", "s3")]
    chunk = [(p + "c0", p, 0, "abstract", same, 0) for p in ("b", "b2", "c")]
    df = run(spark, tmp_path, "corpus_digest", paper=(data, PAPER), chunk=(chunk, "id string, paper_id string, ord int, kind string, text string, level int"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {"s1": f"[P2] T (n.d., V)\n  Chốt: {same}1\n  Điểm mới: n", "s2": f"[P1] T (2020)\n  Chốt: {same}2", "s3": ""}
    assert {r.survey_id: r.digest for r in df.collect()} == {k: sha(t) for k, t in want.items()}


def test_number_extract_reads_every_kind(spark, tmp_path):
    kinds = ["para", "abstract", "summary", "table", "figcap", "equation", "list", None]
    data = [(f"c{k}", k_, "a 1,5 b 7 and 7, x2") for k, k_ in enumerate(kinds)] + [("none", "table", "words"), ("null", "para", None)]
    got = {r.id: r.n for r in run(spark, tmp_path, "number_extract", chunk=(data + data[:2], "id string, kind string, text string")).collect()}
    assert got == {f"c{k}": 2 for k in range(len(kinds))}
