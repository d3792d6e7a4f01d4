"""Problem 5: the k most similar vectors of every vector, through learned partitions.

Fit (on a bounded sample): the neighbour graph of the sample is cut into balanced partitions by
recursive bisection, and a small softmax classifier learns to tell a vector's partition. Index
(cluster): every vector goes to its most probable partition. Search: every vector is a query in its
most probable partitions, as far as their probability says; each partition is one block product per
block of queries, and the candidates of a query are merged.

One sample teaches at most 256 partitions. A partition that is still too large is fitted and cut
again in the same way, on executors, up to ``LEVELS`` times; so the partitions grow with the
vectors and hold ``PART_ROWS`` entries or little more. What no cut can part (vectors all but equal)
is searched in blocks of bases and turns of queries. Equal vectors are searched once: a group of
copies is one entry of the index, its members are each other's first neighbours and are put back by
equi-joins afterwards. So no task sees more than ``SLACK * PART_ROWS`` bases and ``TURN * PART_ROWS`` queries.

Where only close neighbours are wanted, vectors travel to the partitions as codes of four bits a
dimension. A code comes with its distance from the vector, so what two codes say bounds the cosine
from above: no close pair is lost. Whole vectors are sent only where the codes leave a pair possible.
There each pair of partitions is looked into from one side, and what meets is a neighbour of each other.

How far queries look is measured: for a bounded set of queries the true neighbours among all vectors
are found exactly, and the least probability that still meets ``recall`` of them is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.session import cut

#: Vectors of a fit, entries of a partition, least partitions a query looks into.
SAMPLE, PART_ROWS, PROBES = 12_000, 2000, 2
#: Share of the true neighbours that the partitions looked into must hold; the same where only close ones are wanted.
RECALL, CLOSE_RECALL = 0.965, 0.997
#: Queries on which that share is measured, and sample vectors for which neighbours are made.
MEASURED, MADE = 1000, 4000
#: Least sample vectors of a partition: bounds the partitions that one sample can teach; more take another level.
PART_SAMPLE = 24
#: Levels of partitions: at most 256 times as many at each. Base of the node numbers.
LEVELS, NODE_STEP = 4, 512
#: Times the entries of a partition from which a node is cut again, and its queries are asked in turns; rows that one task routes.
SLACK, TURN, ROUTED_ROWS = 2, 16, 50_000
GRAPH_K, EPOCHS, QUERY_BLOCK = 12, 12, 2048
DIGITS = 6


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """Row numbers of the k nearest rows of each unit row, by blocks."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int32)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, 1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, depth: int, seed: int = 5) -> np.ndarray:
    """Partition number (0 .. 2**depth - 1) of each row: halves of equal size that cut few graph edges.

    Each part is split at the median of a smoothed eigenvector of its neighbour graph.
    """
    graph = neighbour_graph(x)
    part = np.zeros(len(x), np.int64)
    rng = np.random.default_rng(seed)
    place = np.full(len(x), -1, np.int64)
    for _ in range(depth):
        new = np.zeros(len(x), np.int64)
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            place[rows] = np.arange(len(rows))
            near = place[graph[rows]]
            place[rows] = -1
            inside = near >= 0
            near = np.where(inside, near, np.arange(len(rows))[:, None])
            y = x[rows] @ rng.standard_normal(x.shape[1])
            if len(rows) > 2:  # start along the main direction of the part
                c = x[rows] - x[rows].mean(0)
                v = rng.standard_normal(x.shape[1])
                for _ in range(8):
                    v = c.T @ (c @ v)
                    v /= np.linalg.norm(v) + 1e-12
                y = c @ v
            for _ in range(12):
                y = 0.5 * y + 0.5 * y[near].mean(1)
                y = y - y.mean()
                y /= np.abs(y).max() + 1e-12
            order = np.argsort(y, kind="stable")
            side = np.zeros(len(rows), np.int64)
            side[order[len(rows) // 2 :]] = 1
            new[rows] = 2 * p + side
        part = new
    return part


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax over partitions, by mini-batch descent from the partitions' means."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    w = np.zeros((d, parts), np.float32)
    np.add.at(w.T, part, x)
    w /= np.maximum(np.linalg.norm(w, axis=0), 1e-9)
    w *= 8.0
    b = np.zeros(parts, np.float32)
    rate = 2.0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            z = x[rows] @ w + b
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(rows)), part[rows]] -= 1
            z /= len(rows)
            w -= rate * (x[rows].T @ z)
            b -= rate * z.sum(0)
        rate *= 0.85
    return w, b


def synthetic(x: np.ndarray, cosines: np.ndarray, seed: int = 7) -> np.ndarray:
    """For each unit row a unit row in a random direction, at a cosine drawn from the given ones."""
    rng = np.random.default_rng(seed)
    c = cosines[rng.integers(0, len(cosines), len(x))][:, None]
    r = rng.standard_normal(x.shape)
    r -= (r * x).sum(1, keepdims=True) * x
    r /= np.linalg.norm(r, axis=1, keepdims=True) + 1e-12
    return (c * x + np.sqrt(np.maximum(0.0, 1 - c * c)) * r).astype(np.float32)


def probabilities(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (x @ w + b).astype(np.float64)
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z / z.sum(1, keepdims=True)


def tails(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(partitions by falling probability, probability that is left from each of them on)."""
    order = np.argsort(-p, 1, kind="stable")
    left = np.cumsum(np.take_along_axis(p, order, 1)[:, ::-1], 1)[:, ::-1]
    return order, left


def tail_for(w: np.ndarray, b: np.ndarray, queries: np.ndarray, near: np.ndarray, recall: float) -> float:
    """The probability down to which a query's partitions are looked into, so that ``recall`` of the pairs' neighbours are met."""
    order, left = tails(probabilities(queries, w, b))
    home = probabilities(near, w, b).argmax(1)
    rank = (order == home[:, None]).argmax(1)
    return float(np.quantile(left[np.arange(len(rank)), rank], 1 - recall, method="lower")) * 0.999


def depth_for(n: int, part_rows: int, sample: int) -> int:
    """Halvings of n entries: to partitions of ``part_rows``, as far as the sample can teach them."""
    return max(0, min(math.ceil(math.log2(max(n, 1) / part_rows)), math.floor(math.log2(max(min(n, sample) / PART_SAMPLE, 1)))))


def learn(x: np.ndarray, depth: int, k: int, recall: float, least: float | None, pairs: tuple[np.ndarray, np.ndarray] | None = None, cosines: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, bias, tail) of a router over 2**depth partitions of a sample of unit rows.

    ``pairs``: queries and their true neighbours, on which the tail is measured; without them the
    sample's own neighbours stand for them (farther apart than in the whole, so no easier). With
    ``least``, neighbours made at the cosines of the true ones are added (at ``least``, where none are known).
    """
    part = balanced_partition(x, depth)
    w, b = fit_router(x, part, 2**depth)
    if pairs is None:
        q = np.arange(min(len(x), MEASURED))
        s = x[q] @ x.T
        s[q, q] = -np.inf
        m = min(k, len(x) - 1)
        near = np.argpartition(-s, m - 1, 1)[:, :m]
        ok = np.take_along_axis(s, near, 1) >= (least if least is not None else -1.0)
        pairs = x[np.repeat(q, m)[ok.ravel()]], x[near.ravel()[ok.ravel()]]
    queries, near = pairs
    if least is not None:
        made = x[:MADE]
        at = np.einsum("ij,ij->i", queries, near) if cosines is None or not len(cosines) else cosines
        queries, near = np.concatenate([queries, made]), np.concatenate([near, synthetic(made, at if len(at) else np.array([least]))])
    return w, b, tail_for(w, b, queries, near, recall) if len(queries) else 0.0


def true_neighbours(entries: DataFrame, grp: str, keys: np.ndarray, x: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, neighbour rows): the k nearest entries of a bounded set of queries among all entries of a group, exactly.

    Each part of the entries keeps the best k of a query and sends them once.
    """
    shared = entries.sparkSession.sparkContext.broadcast((keys, x))
    floor = -2.0 if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qk, q = shared.value
        best: list[list[tuple[float, int, np.ndarray]]] = [[] for _ in qk]
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy()
            v = _unit(b.column(1), b.num_rows)
            s = q @ v.T
            s[qk[:, None] == own[None, :]] = -np.inf
            m = min(k, b.num_rows)
            top = np.argpartition(-s, m - 1, 1)[:, :m]
            for i in range(len(qk)):
                new = [(float(s[i, j]), int(own[j]), v[j]) for j in top[i] if s[i, j] >= floor]
                if new:
                    best[i] = sorted(best[i] + new, key=lambda r: (-r[0], r[1]))[:k]
        rows = [(i, c, n, v.tolist()) for i, r in enumerate(best) for c, n, v in r]
        c = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.float64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.list_(pa.float32()))], names=["q", "c", "near", "vec"])

    found = entries.filter(F.col("grp") == grp).select("key", "vec").mapInArrow(run, "q int, c double, near long, vec array<float>")
    best = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "near", "vec"))), 1, k).alias("b")).select("q", F.explode("b.vec").alias("vec")).collect()
    return x[[r.q for r in best]], np.array([r.vec for r in best], np.float32).reshape(-1, x.shape[1])


def fit_groups(entries: DataFrame, counts: dict[str, int], *, k: int = 5, recall: float | None = None, least: float | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> dict[str, tuple[np.ndarray, np.ndarray, float, np.ndarray]]:
    """(weights, bias, tail, cosines of true neighbours) for each group that is larger than a partition.

    The sample are vectors chosen by their hash; it is bounded by ``sample`` for each group. How far
    queries look is measured on at most ``MEASURED`` of them against all entries.
    """
    out: dict[str, tuple[np.ndarray, np.ndarray, float]] = {}
    recall = recall or (RECALL if least is None else CLOSE_RECALL)
    for g, n in counts.items():
        if not (depth := depth_for(n, part_rows, sample)):
            continue
        rate = min(1.0, 1.3 * sample / n)
        rows = entries.filter((F.col("grp") == g) & (F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(rate * 1_000_000))).orderBy("key").limit(sample).select("key", "vec").collect()
        x = np.array([r.vec for r in rows], np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        few = np.random.default_rng(3).permutation(len(x))[:MEASURED]
        pairs = true_neighbours(entries, g, np.array([rows[i].key for i in few], np.int64), x[few], k, least)
        out[g] = *learn(x, depth, k, recall, least, pairs), np.einsum("ij,ij->i", *pairs).astype(np.float32)
    return out


def routed_rows(x: np.ndarray, router: tuple, base: np.ndarray, upward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, partitions, whether as a base): each row in its likeliest partition, then in those worth a look.

    ``upward``: bases look only into partitions of higher numbers than their own.
    """
    w, b, tail = router[:3]
    for a in range(0, len(x), 4096):
        order, left = tails(probabilities(x[a : a + 4096], w, b))
        rows = np.arange(a, a + len(order))
        yield rows, order[:, 0], base[rows]
        for c in range(1, order.shape[1]):
            on = np.flatnonzero((left[:, c] >= tail) | (c < PROBES))
            if not len(on):
                break
            if upward:
                on = on[~base[rows[on]] | (order[on, c] > order[on, 0])]
            if len(on):
                yield rows[on], order[on, c], np.zeros(len(on), bool)


def _unit(col: pa.Array, n: int) -> np.ndarray:
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(n, -1)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def encode(x: np.ndarray) -> pa.Array:
    """Unit rows as codes: step and distance from the row (half precision), then four bits a dimension."""
    if x.shape[1] % 2:
        x = np.concatenate([x, np.zeros((len(x), 1), np.float32)], 1)
    step = (np.abs(x).max(1, initial=0) / 8).astype(np.float16)
    s = np.maximum(step.astype(np.float32), 1e-7)[:, None]
    q = np.clip(np.floor(x / s) + 8, 0, 15).astype(np.uint8)
    gap = np.linalg.norm(((q - np.float32(7.5)) * step.astype(np.float32)[:, None] - x).astype(np.float64), axis=1) * 1.0001
    half = gap.astype(np.float16)
    half = np.where(half < gap, np.nextafter(half, np.float16(np.inf)), half)
    out = np.concatenate([np.stack([step, half], 1).view(np.uint8).reshape(len(x), 4), q[:, ::2] << 4 | q[:, 1::2]], 1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(out.shape[1]), len(out), [None, pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.binary())


def decode(codes: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows as their codes say, distance of each from the true row)."""
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    head = np.ascontiguousarray(raw[:, :4]).view(np.float16).astype(np.float32)
    q = np.stack([raw[:, 4:] >> 4, raw[:, 4:] & 15], 2).reshape(len(raw), -1)
    return (q - np.float32(7.5)) * head[:, :1], head[:, 1]


def _rows(col: pa.Array | pa.ChunkedArray, n: int) -> tuple[np.ndarray, float]:
    """(unit rows, mean distance from the true ones) of vectors or of their codes."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not pa.types.is_binary(col.type):
        return _unit(col, n), 0.0
    x, gap = decode(col)
    return x / np.linalg.norm(x, axis=1, keepdims=True), float(gap.mean()) if n else 0.0


def usable(vectors: DataFrame, id_col: str, vec_col: str, group_col: str, dim_col: str | None) -> DataFrame:
    """(id, grp, vec): rows whose vector is whole, finite and not zero."""
    v = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(vec_col).cast("array<float>").alias("vec"), (F.col(dim_col) if dim_col else F.lit(None)).cast("int").alias("dim"))
    v = v.filter("id is not null and vec is not null and size(vec) > 0")
    v = v.filter(F.col("dim").isNull() | (F.size("vec") == F.col("dim")))
    v = v.filter(F.exists("vec", lambda x: x != 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return v.select("id", F.coalesce("grp", F.lit("")).alias("grp"), "vec")


def _schema(coded: bool) -> str:
    return f"grp string, node long, key long, vec {'binary' if coded else 'array<float>'}, base boolean"


def _listed(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x, np.float32).ravel(), pa.float32()), x.shape[1]).cast(pa.list_(pa.float32()))


def _placed(grp: pa.Array, node: np.ndarray, key: pa.Array, vec: pa.Array, base: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([grp, pa.array(node, pa.int64()), key, vec, pa.array(base)], names=["grp", "node", "key", "vec", "base"])


def first_level(entries: DataFrame, routers: dict[str, tuple], coded: bool = False) -> DataFrame:
    """Each entry once as a base of its partition and as a query of the partitions it looks into; node 0 in small groups."""
    shared = entries.sparkSession.sparkContext.broadcast(routers)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = np.array(b.column(0).to_pylist(), object)
            for g in dict.fromkeys(groups):
                part = b.take(pa.array(np.flatnonzero(groups == g)))
                x = _unit(part.column(2), part.num_rows)
                vec = encode(x) if coded else _listed(x)
                base = np.ones(len(x), bool)
                if g not in shared.value:
                    yield _placed(part.column(0), np.zeros(len(x), np.int64), part.column(1), vec, base)
                    continue
                for rows, node, is_base in routed_rows(x, shared.value[g], base, coded):
                    at = pa.array(rows)
                    yield _placed(part.column(0).take(at), node + 1, part.column(1).take(at), vec.take(at), is_base)

    return entries.mapInArrow(route, _schema(coded))


def next_level(placed: DataFrame, large: DataFrame, cosines: dict[str, np.ndarray], k: int, recall: float, least: float | None, sample: int, part_rows: int) -> DataFrame:
    """The rows of too large nodes in partitions of their own, the others as they are.

    A node's router is fitted on an executor, on a sample of its bases of at most ``sample`` rows, and
    meets the node's rows in salted parts: neither the routers nor a node's rows are ever in one place.
    """
    coded = dict(placed.dtypes)["vec"] == "binary"
    rate = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1_000_000)) < F.least(F.lit(1_000_000.0), F.lit(1.1e6 * sample) / F.col("nb"))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("key").slice(0, sample)
        x, gap = _rows(t.column("vec"), t.num_rows)
        near = 1 - gap * gap  # codes of close vectors are so much less close
        n = t.column("nb")[0].as_py()
        depth = max(1, depth_for(n, part_rows, min(sample, len(x))))
        w, b, tail = learn(x, min(depth, int(math.log2(max(2, len(x))))), k, recall, least and least * near, cosines=cosines[t.column("grp")[0].as_py()] * near)
        return pa.table({"grp": t.column("grp").slice(0, 1), "node": t.column("node").slice(0, 1), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "b": pa.array([b.astype(np.float32).tobytes()], pa.binary()), "tail": pa.array([tail], pa.float64())})

    learned = cut(placed.filter("base").join(large.select("grp", "node", "nb"), ["grp", "node"]).filter(rate).groupBy("grp", "node").applyInArrow(fit, "grp string, node long, w binary, b binary, tail double"))
    salts = large.select("grp", "node", F.ceil(F.col("nq") / ROUTED_ROWS).cast("int").alias("salts"))
    rows = placed.join(salts, ["grp", "node"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts").cast("long")).cast("int")).drop("salts")
    models = learned.join(salts, ["grp", "node"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        x, _ = _rows(left.column("vec"), left.num_rows)
        b = np.frombuffer(right.column("b")[0].as_py(), np.float32)
        router = np.frombuffer(right.column("w")[0].as_py(), np.float32).reshape(x.shape[1], len(b)), b, right.column("tail")[0].as_py()
        base = np.asarray(left.column("base").to_numpy(zero_copy_only=False), bool)
        grp, key, vec, old = left.column("grp").combine_chunks(), left.column("key").combine_chunks(), left.column("vec").combine_chunks(), left.column("node").to_numpy()
        out = [_placed(grp.take(pa.array(r)), old[r] * NODE_STEP + node + 1, key.take(pa.array(r)), vec.take(pa.array(r)), is_base) for r, node, is_base in routed_rows(x, router, base, coded)]
        return pa.Table.from_batches(out)

    deeper = rows.groupBy("grp", "node", "salt").cogroup(models.groupBy("grp", "node", "salt")).applyInArrow(route, _schema(coded))
    return placed.join(large.select("grp", "node"), ["grp", "node"], "left_anti").select("grp", "node", "key", "vec", "base").unionByName(deeper)


def in_cells(placed: DataFrame, sizes: DataFrame | None, part_rows: int) -> DataFrame:
    """Adds (block, turn, asks, home): the rows of nodes that stayed too large meet in blocks of bases and turns of queries.

    A base stands in its block for every turn, a query in its turn for every block; so each pair meets
    once, and no cell is larger than a block and a turn. ``home``: a base of the node, in whichever block.
    """
    plain = placed.withColumn("block", F.lit(0)).withColumn("turn", F.lit(0)).withColumn("asks", F.lit(True)).withColumn("home", F.col("base"))
    if sizes is None:
        return plain
    cells = sizes.select("grp", "node", *(F.greatest(F.lit(1), F.ceil(F.col(c) / (m * part_rows)).cast("int")).alias(a) for c, m, a in (("nb", SLACK, "blocks"), ("nq", TURN, "turns")))).filter("blocks > 1 or turns > 1")
    if not cells.limit(1).count():
        return plain
    j = placed.withColumn("home", F.col("base")).join(cells, ["grp", "node"], "left").fillna(1, ["blocks", "turns"])
    j = j.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int")).withColumn("mine", F.pmod(F.xxhash64("key", F.lit(1)), F.col("turns").cast("long")).cast("int"))
    j = j.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    j = j.withColumn("base", F.col("base") & (F.col("block") == F.col("own"))).withColumn("asks", F.col("turn") == F.col("mine"))
    return j.filter("base or asks").select("grp", "node", "key", "vec", "base", "block", "turn", "asks", "home")


def possible(placed: DataFrame, floor: float) -> DataFrame:
    """(grp, node, key, base): the rows of coded cells that may have a neighbour of at least ``floor`` there."""

    def look(table: pa.Table) -> pa.Table:
        base = np.flatnonzero(np.asarray(table.column("base").to_numpy(zero_copy_only=False), bool))
        asks = np.flatnonzero(np.asarray(table.column("asks").to_numpy(zero_copy_only=False), bool))
        x, gap = decode(table.column("vec"))
        size = np.linalg.norm(x, axis=1)
        # x.y + |x| gap y + gap x |y| + gap x gap y, as one product
        ask, own = np.column_stack([x, size + gap, -size]), np.column_stack([x, size + gap, size])[base]
        place = np.full(len(x), -1)
        place[base] = np.arange(len(base))
        hit = np.zeros(len(x), bool)
        for a in range(0, len(asks) if len(base) else 0, QUERY_BLOCK):
            at = asks[a : a + QUERY_BLOCK]
            on = ask[at] @ own.T >= floor - 1e-4
            same = np.flatnonzero(place[at] >= 0)
            on[same, place[at[same]]] = False
            hit[at] |= on.any(1)
            hit[base] |= on.any(0)
        return table.select(["grp", "node", "key", "base"]).take(pa.array(np.flatnonzero(hit)))

    found = placed.groupBy("grp", "node", "block", "turn").applyInArrow(look, "grp string, node long, key long, base boolean")
    return found.groupBy("grp", "node", "key").agg(F.max("base").alias("base"))


def members_of(rows: DataFrame) -> DataFrame:
    """(grp, id, key): the vector of each id by its key, the smallest of several; vectors move only for ids that have several."""
    ids = cut(rows.groupBy("grp", "id").agg(F.min(F.struct("key", "dims")).alias("a"), F.max(F.struct("key", "dims")).alias("b")), release=True)
    one = ids.filter("a.key = b.key").select("grp", "id", F.col("a.key").alias("key"), F.col("a.dims").alias("dims"))
    several = ids.filter("a.key <> b.key").select("grp", "id")
    if not several.isEmpty():
        own = rows.join(several, ["grp", "id"]).groupBy("grp", "id").agg(F.min(F.struct("vec", "key", "dims")).alias("v"))
        one = cut(one.unionByName(own.select("grp", "id", "v.key", "v.dims")), release=True)
    return one.select(F.concat_ws("\t", "grp", "dims").alias("grp"), "id", "key")


def most_similar(vectors: DataFrame, id_col: str = "chunk_id", vec_col: str = "vec", group_col: str = "model", dim_col: str | None = "dim", *, k: int = 5, least: float | None = None, recall: float | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> DataFrame:
    """(grp, id, neighbour, rank, cosine): the k most similar other ids of the same group for every usable vector.

    With ``least`` only neighbours of at least that cosine are wanted: they stand close in few
    partitions, so far fewer are looked into.

    Cosines are rounded to six digits and ties broken by id, so that equal vectors order alike at any
    size. Null, zero, short and non-finite vectors are left out; an id that comes with several
    different vectors keeps the smallest; fewer than k others give fewer rows. Approximate: with more than
    one partition a neighbour outside the partitions looked into is missed; their number is set so that
    they hold ``recall`` of the sample's neighbours, and README has the recall measured by brute force.
    """
    rows = usable(vectors, id_col, vec_col, group_col, dim_col).withColumn("dims", F.size("vec"))
    rows = rows.withColumn("key", F.xxhash64("grp", F.col("dims").cast("string"), "vec"))
    members = members_of(rows)
    # one entry for equal vectors: the group's size and its first k + 1 ids, never the whole group
    whole = rows.select(F.concat_ws("\t", "grp", "dims").alias("grp"), "key", "vec").groupBy("grp", "key").agg(F.any_value("vec").alias("vec"))
    entries = cut(members.groupBy("grp", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).join(whole, ["grp", "key"]), release=True)
    counts = {r.grp: r.n for r in entries.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > part_rows).collect()}
    routers = fit_groups(entries, counts, k=k, recall=recall, least=least, sample=sample, part_rows=part_rows)
    recall = recall or (RECALL if least is None else CLOSE_RECALL)
    coded = least is not None and bool(routers)
    placed = first_level(entries.select("grp", "key", "vec"), routers, coded)
    sizes = None
    for level in range(LEVELS if routers else 0):
        if level:  # what is read twice is written once
            placed = cut(placed, release=True)
        sizes = cut(placed.groupBy("grp", "node").agg(F.count_if("base").alias("nb"), F.count("*").alias("nq")))
        if level == LEVELS - 1 or not sizes.filter(F.col("nb") > SLACK * part_rows).limit(1).count():
            break
        placed = next_level(placed, sizes.filter(F.col("nb") > SLACK * part_rows), {g: r[3] for g, r in routers.items()}, k, recall, least, sample, part_rows)
    cells = ["grp", "node", "block", "turn"]
    placed = in_cells(placed, sizes, part_rows)

    floor = None if least is None else least - 1e-5
    if coded:
        live = cut(possible(placed, floor), release=True)
        sizes = live.groupBy("grp", "node").agg(F.count_if("base").alias("nb"), F.count("*").alias("nq"))
        placed = in_cells(live.join(entries.select("grp", "key", "vec"), ["grp", "key"]), sizes, part_rows)

    def search(table: pa.Table) -> pa.Table:
        base = np.asarray(table.column("base").to_numpy(zero_copy_only=False), bool)
        asks = np.flatnonzero(np.asarray(table.column("asks").to_numpy(zero_copy_only=False), bool))
        keys = table.column("key").to_numpy()
        vec = table.column("vec").combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        x = _unit(vec, table.num_rows) if coded else np.asarray(vec.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(table.num_rows, -1)
        out_q, out_n, out_c = [], [], []

        def meet(asking: np.ndarray, asked: np.ndarray) -> None:
            bx, bk = x[asked], keys[asked]
            m = min(k + 1, len(bk))
            for a in range(0, len(asking) if m else 0, QUERY_BLOCK):
                at = asking[a : a + QUERY_BLOCK]
                s = x[at] @ bx.T
                top = np.argpartition(-s, m - 1, 1)[:, :m]
                if floor is not None:  # few are close: only those are measured exactly
                    i, j = np.nonzero(np.take_along_axis(s, top, 1) >= floor - 1e-4)
                    rows, top = at[i], top[i, j]
                else:
                    rows, top = np.repeat(at, m), top.ravel()
                c = np.einsum("ij,ij->i", x[rows].astype(np.float64), bx[top].astype(np.float64))
                q, n = keys[rows], bk[top]
                ok = (q != n) if floor is None else (q != n) & (c >= floor)
                out_q.append(q[ok])
                out_n.append(n[ok])
                out_c.append(c[ok])

        own = np.flatnonzero(base)
        meet(asks, own)
        if coded:  # bases didn't look into the partitions of those that look in here
            meet(own, asks[~np.asarray(table.column("home").to_numpy(zero_copy_only=False), bool)[asks]])
        g = table.column("grp")[0].as_py() if table.num_rows else ""
        q = np.concatenate(out_q) if out_q else np.empty(0, np.int64)
        return pa.table({"grp": pa.array([g] * len(q), pa.string()), "key": pa.array(q, pa.int64()), "near": pa.array(np.concatenate(out_n) if out_n else np.empty(0, np.int64), pa.int64()), "cosine": pa.array(np.round(np.concatenate(out_c), DIGITS) if out_c else np.empty(0), pa.float64())})

    found = placed.groupBy(*cells).applyInArrow(search, "grp string, key long, near long, cosine double")
    # a query meets each entry in one partition only; the best k + 1 entries of all its partitions
    best = found.groupBy("grp", "key").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "near"))), 1, k + 1).alias("best"))
    # the first ids of each entry in order: enough to fill k places with ties by id
    ranked = members.select("grp", "key", "id")
    heads = first_ids(ranked, entries, k + 1)
    near = best.select("grp", "key", F.explode("best").alias("b")).select("grp", "key", F.col("b.near").alias("near"), (-F.col("b.c")).alias("cosine"))
    near = near.join(heads.select("grp", F.col("key").alias("near"), "ids"), ["grp", "near"]).select("grp", "key", "cosine", "ids")
    own = heads.filter(F.size("ids") > 1).select("grp", "key", F.lit(1.0).alias("cosine"), "ids")
    lists = near.unionByName(own).groupBy("grp", "key").agg(F.collect_list(F.struct("cosine", "ids")).alias("lists"))
    flat = F.flatten(F.transform("lists", lambda x: F.transform(x.ids, lambda i: F.struct((-x.cosine).alias("c"), i.alias("id")))))
    lists = lists.select("grp", "key", F.slice(F.sort_array(flat), 1, 2 * (k + 1)).alias("all"))
    every = members.select("grp", "key", "id").join(lists, ["grp", "key"])
    top = F.slice(F.filter("all", lambda x: x.id != F.col("id")), 1, k)
    out = every.select("grp", "id", F.posexplode(top).alias("p", "x"))
    if least is not None:
        out = out.filter(-F.col("x.c") >= least)
    return out.select(F.element_at(F.split("grp", "\t"), 1).alias("grp"), "id", F.col("x.id").alias("neighbour"), (F.col("p") + 1).alias("rank"), (-F.col("x.c")).alias("cosine"))


def first_ids(members: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(grp, key, ids): the k smallest ids of each entry; large groups are pre-ranked in salted parts."""
    alone = entries.filter("n = 1").select("grp", "key", F.array("first").alias("ids"))
    several = members.join(entries.filter("n > 1").select("grp", "key", "n"), ["grp", "key"])
    salted = several.withColumn("salt", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / 2000))))
    small = salted.groupBy("grp", "key", "salt").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("ids"))
    merged = small.groupBy("grp", "key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))
    return alone.unionByName(merged)


def mutual(neighbours: DataFrame, least: float = 0.9) -> DataFrame:
    """(id_a, id_b): ids that are each among the other's neighbours with a cosine of at least ``least``; id_a < id_b."""
    n = neighbours.filter(F.col("cosine") >= least)
    pair = n.select("grp", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"), (F.col("id") < F.col("neighbour")).alias("up"))
    both = pair.groupBy("grp", "id_a", "id_b").agg(F.count_if("up").alias("a"), F.count_if(~F.col("up")).alias("b")).filter("a > 0 and b > 0")
    return both.select("id_a", "id_b").distinct()
