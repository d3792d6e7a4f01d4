import numpy as np

from papyrion.llm.vector_neighbours import balanced_partition, most_similar, mutual

SCHEMA = "chunk_id string, model string, dim int, vec array<float>"


def frame(spark, x, model="m"):
    return spark.createDataFrame([(f"c{i:05d}", model, x.shape[1], [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)


def clusters(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, d))
    return (centres[rng.integers(0, len(centres), n)] + 0.3 * rng.standard_normal((n, d))) * rng.uniform(0.5, 2, (n, 1))


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, 1)[:, :k]


def test_one_partition_is_exact(spark):
    x = clusters(300)
    want = {(f"c{i:05d}", f"c{j:05d}") for i, js in enumerate(brute(x, 5)) for j in js}
    got = {(r.id, r.neighbour) for r in most_similar(frame(spark, x)).collect()}
    assert len(got & want) >= 0.999 * len(want) and len(got) == len(want)


def test_recall_with_many_partitions(spark):
    x = clusters(3000)
    want = {(f"c{i:05d}", f"c{j:05d}") for i, js in enumerate(brute(x, 5)) for j in js}
    got = {(r.id, r.neighbour) for r in most_similar(frame(spark, x), part_rows=200, sample=1500).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert len(got) == len(want)


def test_partitions_are_balanced():
    x = clusters(1024)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = np.bincount(balanced_partition(x, 4))
    assert len(n) == 16 and n.min() == n.max() == 64


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 8))
    x = np.concatenate([np.repeat(base[:1], 30, 0), base[1:]])
    rows = [(f"c{i:05d}", "m", 8, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += rows[:5] + [("z", "m", 8, [0.0] * 8), ("n", "m", 8, None), ("s", "m", 8, [1.0] * 7), ("q", "m", 8, [float("nan")] * 8), (None, "m", 8, [1.0] * 8), ("other", "m2", 8, [1.0] * 8), ("d", "m2", None, [2.0] * 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = most_similar(df.withColumn("key", df.chunk_id).withColumn("grp", df.model)).collect()
    ids = {r.id for r in got}
    assert not ids & {"z", "n", "s", "q"} and {"other", "d"} <= ids
    mine = sorted((r.rank, r.neighbour, r.cosine) for r in got if r.id == "c00010")
    assert mine == [(k + 1, f"c{k:05d}", 1.0) for k in range(5)]
    assert all(r.id != r.neighbour for r in got)
    pairs = {(r.id_a, r.id_b) for r in mutual(most_similar(df, least=0.9)).collect()}
    assert ("c00000", "c00001") in pairs and ("d", "other") in pairs


def test_empty(spark):
    assert most_similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_partitions_grow_over_several_levels(spark):
    """Samples that can teach few partitions: the nodes are cut again until they hold part_rows or little more."""
    from papyrion.llm import vector_neighbours as V

    x = clusters(6000, seed=3)
    want = {(f"c{i:05d}", f"c{j:05d}") for i, js in enumerate(brute(x, 5)) for j in js}
    sizes = []
    was = V.in_cells
    try:
        V.in_cells = lambda placed, s, n: (sizes.append([r.nb for r in s.collect()]), was(placed, s, n))[1]
        got = {(r.id, r.neighbour) for r in most_similar(frame(spark, x), part_rows=100, sample=240, recall=0.98).collect()}
    finally:
        V.in_cells = was
    assert len(sizes[0]) > 30 and max(sizes[0]) <= 2 * V.SLACK * 100
    assert len(got & want) >= 0.95 * len(want)


def test_what_no_cut_can_part_is_searched_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.ones((900, 8)) + 1e-4 * rng.standard_normal((900, 8))
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    got = most_similar(frame(spark, x), part_rows=20, sample=480, least=0.9).collect()
    by = {}
    for r in got:
        by.setdefault(int(r.id[1:]), []).append(r.cosine)
    assert len(by) == 900 and all(len(v) == 5 and min(v) >= 0.9999 for v in by.values())


def test_cells_meet_every_pair_once(spark):
    from papyrion.llm.vector_neighbours import in_cells

    df = spark.createDataFrame([("g", 0, k, [1.0], k < 50) for k in range(300)], "grp string, node long, key long, vec array<float>, base boolean")
    sizes = spark.createDataFrame([("g", 0, 50, 300)], "grp string, node long, nb long, nq long")
    rows = in_cells(df, sizes, 5).collect()
    met = [(q.key, b.key) for q in rows if q.asks for b in rows if b.base and (b.block, b.turn) == (q.block, q.turn)]
    assert len(met) == len(set(met)) == 300 * 50


def test_codes_bound_the_cosine():
    from papyrion.llm.vector_neighbours import decode, encode

    rng = np.random.default_rng(2)
    for d in (1, 7, 64):
        x = rng.standard_normal((200, d)).astype(np.float32)
        x[0] = np.eye(d)[0]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y, gap = decode(encode(x))
        assert (np.linalg.norm(y[:, :d] - x, axis=1) <= gap).all() and np.median(gap) < 0.2


def test_close_neighbours_need_few_whole_vectors(spark, tmp_path):
    """Rows sent to the partitions are codes, over two levels, and vectors follow only where a pair is possible."""
    from papyrion.llm import vector_neighbours as V

    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 32))
    x[2000:2400] = x[:400] + 0.15 * rng.standard_normal((400, 32))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.triu(u @ u.T, 1)
    want = {(f"c{i:05d}", f"c{j:05d}") for i, j in zip(*np.nonzero(s >= 0.9))}
    sent = []
    was = V.in_cells
    try:
        V.in_cells = lambda placed, s, n: (sent.append((dict(placed.dtypes)["vec"], placed.count())), was(placed, s, n))[1]
        got = {(r.id_a, r.id_b) for r in mutual(most_similar(frame(spark, x), least=0.9, part_rows=100, sample=400)).collect()}
    finally:
        V.in_cells = was
    assert len(want) > 350 and len(got & want) >= 0.98 * len(want) and got <= want
    (first, n), (second, few) = sent
    assert (first, second) == ("binary", "array<float>") and n > 4000 and few < 1500


def test_an_id_with_several_vectors_keeps_the_smallest(spark):
    rows = [("a", "m", 2, [1.0, 0.0]), ("a", "m", 2, [0.0, 1.0]), ("b", "m", 2, [1.0, 0.0]), ("c", "m", 2, [0.0, 1.0]), ("d", "m", None, [5.0]), ("d", "m", None, [1.0, 0.1])]
    got = {(r.id, r.neighbour): r.cosine for r in most_similar(spark.createDataFrame(rows, SCHEMA), least=0.5).collect()}
    assert set(got) == {("a", "c"), ("c", "a"), ("b", "d"), ("d", "b")}


def test_bases_look_upward_only():
    from papyrion.llm.vector_neighbours import routed_rows

    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 8)).astype(np.float32)
    router = rng.standard_normal((8, 16)).astype(np.float32), np.zeros(16, np.float32), 0.01
    base = np.arange(500) < 400

    def looks(upward):
        return {(int(r), int(n), bool(b)) for rows, node, own in routed_rows(x, router, base, upward) for r, n, b in zip(rows, node, own)}

    home = {r: n for rows, node, _ in [next(routed_rows(x, router, base))] for r, n in zip(rows.tolist(), node.tolist())}
    assert looks(True) == {(r, n, b) for r, n, b in looks(False) if r >= 400 or n >= home[r]} != looks(False)
