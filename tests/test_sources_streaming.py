from pyspark.sql import functions as F

from papyrion.sources import readers, sinks
from papyrion.streaming.ingest import ingest_new, windowed


def test_json_in_text(spark):
    texts = ['{"a": 1}', 'Sure!\n```json\n{"a": "}{\\"", "b": [1, 2]}\n```', "[see] then {\"x\": 2} end", "no json", None, '{"a": 1', '{"a": "line\nbreak"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(readers.json_in_text("t").alias("j"))
    assert [r.j for r in df.collect()] == ['{"a": 1}', '{"a": "}{\\"", "b": [1, 2]}', '{"x": 2}', None, None, None, '{"a": "line\nbreak"}']


def test_labelled(spark):
    df = spark.createDataFrame([(1, "intro <<<b1>>> first <<b2>> second\nline <<<zz>>> cut o")], "k int, t string")
    assert [(r.label, r.body) for r in readers.labelled(df, "t").collect()] == [("b1", "first"), ("b2", "second\nline"), ("zz", "cut o")]
    assert [r.label for r in readers.labelled(df, "t", F.array(F.lit("b1"))).collect()] == ["b1"]


def test_labels_of_a_closed_set_in_every_form(spark):
    text = "lead\n### b1\nfirst <<<zz>>> stays in a\n**b12**:\nsecond\n[b1x]\nnot a label\n<<b2>>\nthird\n[b3] :\nlast, cut o"
    df = spark.createDataFrame([(1, text, ["b1", "b12", "b2", "b3"]), (2, None, ["b1"]), (3, "none", ["b1"])], "k int, t string, ids array<string>")
    got = {r.label: r.body for r in readers.labelled(df, "t", "ids").collect()}
    assert got == {"b1": "first <<<zz>>> stays in a", "b12": "second\n[b1x]\nnot a label", "b2": "third", "b3": "last, cut o"}


def test_bibliographic_readers(spark):
    feed = "<feed><entry><id>http://x/1</id><published>2021-03-04</published><title>A\n  title</title><summary>S</summary></entry><entry><title>B</title></entry></feed>"
    got = readers.atom_entries(spark.createDataFrame([(feed,)], "x string"), "x").collect()
    assert [(r.title, r.year) for r in got] == [("A title", 2021), ("B", None)]
    reg = ['{"DOI": "10.1/X", "title": ["T"], "abstract": "<p>a <i>b</i></p>", "is-referenced-by-count": 4, "issued": {"date-parts": [[2020, 1]]}}', "{broken"]
    got = readers.registry_rows(spark.createDataFrame([(r,) for r in reg], "j string"), "j").collect()
    assert tuple(got[0]) == ("10.1/x", "T", "a b", 4, 2020) and got[1].doi is None


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    sinks.overwrite_partitions(spark.createDataFrame([("b", 3)], "k string, v int"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    assert sinks.markdown_rows(spark.createDataFrame([("x|y\nz", None)], "a string, b int"), ["a", "b"]).first().line == "| x\\|y z |  |"


def test_incremental_ingest(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y")], "id string, t string")
    a.write.parquet(src)
    go = lambda: ingest_new(spark, src, dst, cp, "id", "id string, t string", lambda b: b)
    go()
    spark.createDataFrame([("2", "z"), ("3", "w")], "id string, t string").write.mode("append").parquet(src)
    go()
    assert sorted((r.id, r.t) for r in spark.read.parquet(dst).collect()) == [("1", "x"), ("2", "y"), ("3", "w")]


def test_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "t string, k string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.n, r.total) for r in windowed(e, "ts", "1 hour", ["k"]).collect()) == [(1, 4.0), (2, 3.0)]
