import random

from papyrion.llm.leak import ItemAutomaton, leaked, without_spans, words_of

rng = random.Random(5)
VOC = [f"w{i}" for i in range(60)]
ITEMS = [(i, " ".join(rng.choice(VOC) for _ in range(60))) for i in range(12)]


def brute(item, doc, least=18, per=8):
    """Whether some stretch of the item of 18 to 35 words stands in the document within its errors, ending in matches."""
    for i in range(len(item)):
        for size in range(least, 36):
            part = item[i : i + size]
            if len(part) < size:
                break
            most = size // per
            for j in range(len(doc)):
                if doc[j] != part[0]:
                    continue
                row = list(range(size + 1))
                for n, w in enumerate(doc[j : j + size + most], 1):
                    prev, row[0] = row[0], n
                    for k in range(1, size + 1):
                        prev, row[k] = row[k], min(prev + (part[k - 1] != w), row[k] + 1, row[k - 1] + 1)
                    if row[size] <= most and w == part[-1]:
                        return True
    return False


def spoil(words, errors):
    w = list(words)
    for _ in range(errors):
        k, at = rng.randrange(3), rng.randrange(len(w))
        if k == 0:
            w[at] = "other"
        elif k == 1:
            w.pop(at)
        else:
            w.insert(at, "more")
    return w


def test_against_brute_force():
    auto = ItemAutomaton(ITEMS)
    hits = misses = 0
    for _ in range(120):
        n, text = rng.choice(ITEMS)
        item = text.split()
        a, size = rng.randrange(30), rng.choice((14, 17, 18, 20, 26, 34))
        doc = ["x", "y"] + spoil(item[a : a + size], rng.choice((0, 0, 1, 2, 3, 5))) + ["z"] * 3
        found = n in auto.found(doc)
        want = brute(item, doc)
        assert found == want, (doc, item)
        hits, misses = hits + want, misses + (not want)
    assert hits > 20 and misses > 20


def test_disguise_and_spans():
    item = "Every grain weight above 505 units was copied until the kiln thermometer from the aqueduct returned in June. How many noticed?"
    auto = ItemAutomaton([(7, item)])
    doc = "Before it. EVERY GRAIN WEIGHT ABOVE 505 UNITS\nWAS COPIED UNTIL THE KILN ТHERMOMETER FROM THE ＡQUEDUCT RETURNED IN JUNE! After."
    got = auto.found(words_of(doc))
    assert got == {0: (2, 20)}
    assert without_spans("a b c d e", [(1, 2)]) == "a  d e" and without_spans(None, []) is None


def test_edges(spark, rows):
    item = " ".join(VOC[:40])
    items = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, None, 0), (3, "", 0), (None, item, 0), (4, "too short", 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(1, "x " + item), (1, "x " + item), (2, None), (3, ""), (4, " ".join(VOC[:17])), (5, ("filler " * 40_000) + item)], "doc_id long, text string")
    assert [r[:2] for r in rows(leaked(docs, items))] == [(1, 1), (5, 1)]
    assert leaked(docs, items.limit(0)).count() == 0 and leaked(docs.limit(0), items).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    import papyrion.llm.leak as L

    monkeypatch.setattr(L, "BLOCK_WORDS", 70)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in ITEMS], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaked(docs, items).collect()} >= {(i, i) for i, _ in ITEMS}


def test_leaks_are_taken_out_by_length_or_coverage(spark):
    from papyrion.llm.leak import cleaned

    long, other = " ".join(VOC[:40]), " ".join(VOC[20:60])
    items = spark.createDataFrame([(1, long), (2, other), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {long} after"), (1, f"before {long} after"), (2, "clean text"), (3, None), (4, "head " + " ".join(VOC[:20]) + " tail")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed, r.coverage) for r in cleaned(docs, items).collect()}
    assert set(got) == {1, 4} and got[1][0].split() == ["before", "after"] and got[1][2] == 1.0 and got[1][1] == 2
    assert got[4][0].split() == ["head", "tail"] and got[4][2] == 0.5
    assert {r.doc_id for r in cleaned(docs, items, words=30, share=0.9).collect()} == {1}
    assert cleaned(docs.limit(0), items).count() == 0
