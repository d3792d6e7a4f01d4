import random

from papyrion.llm.spam import spam_pages

rng = random.Random(4)
SUBJECTS = ["The model", "Our filter", "This tree", "A decoder", "Every reader", "Some cache"]
REST = ["is trained on the notes of a museum and then used for the claims.", "has little to say about how the memory was built in the first place.", "shows that the gain comes at a price which we did not expect.", "can not be released because the owners of the data did not agree.", "was proposed for the search of code but it ignores the tables."]


def prose(n):
    return " ".join(f"{rng.choice(SUBJECTS)} {k} {rng.choice(REST)}" for k in range(n))


def keywords(n):
    return " ".join(f"{rng.choice(['cheap', 'best', 'buy', 'top 10'])} {rng.choice(['noise filter', 'travel diaries', 'query rewriting'])}" for _ in range(n))


def test_kinds(spark):
    links = "\n".join(f"* thing https://shop{i}.example/a/{i}" for i in range(20))
    tags = " ".join(f"#tag_{i % 5}" for i in range(60))
    shop = "\n".join(f"Noise filter {i} / new / travel diaries / SKU {1000 + i}" for i in range(20))
    stuffed = " ".join("Travel diaries noise filter and travel diaries noise filter." for _ in range(20))
    refs = "References\n" + "\n".join(f"[{i}] Bebek, A.; Dodek, C.. A study of item {i * 7} in the wild number {i}. Letters in Text, 20{10 + i}." for i in range(12))
    spam = {1: keywords(60), 2: links, 3: tags, 4: shop, 5: stuffed, 6: prose(2) + "\n" + keywords(80)}
    fine = {11: prose(12), 12: prose(12) + "\n" + keywords(8), 13: refs, 14: None, 15: "", 16: "  \n ", 17: prose(10) + "\nKeywords: a; b; c\nCode: https://x.example/1", 18: prose(2000)}
    df = spark.createDataFrame([(i, t, rng.choice(["en", "EN", None])) for i, t in {**spam, **fine}.items()] + [(1, spam[1], "en")], "doc_id long, text string, lang string")
    got = spam_pages(df.withColumn("n", df.lang).withColumn("hard", df.lang)).collect()
    assert sorted(r.doc_id for r in got) == sorted(spam)
    assert all(0.5 < r.share <= 1 for r in got)


def test_empty(spark):
    assert spam_pages(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_single_keywords_in_any_order(spark):
    r = random.Random(3)
    words = [a + b for a in ("lamp", "sofa", "rug", "desk", "vase", "shelf") for b in ("shop", "deal", "sale", "mart", "land", "box", "kit", "set", "pro", "max")]
    spam = {k: " ".join(r.choice(ws) for _ in range(n)) for k, (ws, n) in enumerate(((words, 300), (words, 600), (words, 1500), (words[:12], 80)))}
    lines = words[:20] + [f"{a} {b}" for a, b in zip(words[20:40], words[40:60])]
    spam[4] = "\n".join(r.sample(lines, len(lines)) + r.sample(lines, len(lines)))  # each line twice
    fine = {10: prose(200), 11: prose(12) + "\n" + " ".join(words[:12] * 4), 12: "\n".join([prose(1)] * 2 + [prose(3)]), 13: "\n".join(f"{w}: a thing that we use in the house when it is needed for {k}." for k, w in enumerate(words)), 14: " ".join(words)}
    df = spark.createDataFrame([(i, t, "en") for i, t in {**spam, **fine}.items()], "doc_id long, text string, lang string")
    assert sorted(x.doc_id for x in spam_pages(df).collect()) == sorted(spam)


def test_lines_of_keywords_that_never_repeat(spark):
    r = random.Random(8)
    syl = ["ka", "ro", "mi", "tel", "sun", "bra", "vo", "lin", "dex", "pa", "zu", "gor"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(3, 5)))
    rows = [f"{word()} {word()} {r.randint(1, 99)} - {word()} - {word()} {r.randint(1, 9)},99" for _ in range(12)]
    spam = {1: "\n".join(" ".join(word() for _ in range(4)) for _ in range(60)), 2: "zapatos rojos zapatos azules zapatos baratos comprar zapatos online zapatos mujer zapatos hombre zapatos piel", 3: "\n".join(rows)}
    table = "\n".join(f"{word()} {r.randint(10, 99)}.{k} / {r.randint(10, 99)}.7 / {r.randint(10, 99)}.1" for k in range(12))
    other = " ".join(f"{word()} {word()} ne {word()} me {word()}." for _ in range(40))  # sentences of a language unknown here
    fine = {10: prose(30), 11: prose(30) + "\n" + "\n".join(f"{word()} {word()}" for _ in range(12)), 12: table, 13: other, 14: "\n".join(f"{w}: a thing that we use in the house when it is needed for {k}." for k, w in enumerate(rows))}
    df = spark.createDataFrame([(i, t, "en") for i, t in {**spam, **fine}.items()], "doc_id long, text string, lang string")
    assert sorted(x.doc_id for x in spam_pages(df).collect()) == sorted(spam)
