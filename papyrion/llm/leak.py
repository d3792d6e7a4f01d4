"""Problem 9: evaluation texts inside training documents.

The test items' words form one generalised suffix automaton, and every document streams through it
once, tracking the longest match that ends at each word. A qualifying stretch (at least 18 item
words, at most one in eight changed, missing or added) always holds one of 18 to 35 words, since
any longer one splits into two of which one qualifies; with at most 2, 3 or 4 errors in up to 23,
31 or 35 words it holds an unbroken run of at least six. So matches of six words lose nothing, and
each is extended to both sides with up to four errors by furthest-reaching diagonals.

Items travel to the executors in blocks of bounded size; each block is one narrow pass over the
documents, without a shuffle beyond the final distinct over the few hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.fold import latin
from papyrion.session import spread

#: Least item words of a leaked stretch, item words per error, and the exact run each such stretch holds.
LEAST, PER_ERROR, RUN, MOST_ERRORS = 18, 8, 6, 4
#: Item words in one block (one automaton, some 100 MB at most); more items make more blocks.
BLOCK_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(latin(text).lower())


class ItemAutomaton:
    """Generalised suffix automaton over the items' words, with the places of its longer states."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        self.texts = [[self.vocab.setdefault(w, len(self.vocab)) for w in words_of(t)] for _, t in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for n, text in enumerate(self.texts):
            last = 0
            for at, w in enumerate(text):
                last = self._add(last, w)
                self.places[last].append((n, at))
        # states that hold each place: itself and what its suffix links lead to, down to RUN words
        full: list[list[tuple[int, int]]] = [[] for _ in self.len]
        for v in sorted(range(len(self.len)), key=self.len.__getitem__, reverse=True):
            full[v].extend(self.places[v])
            if self.len[v] >= RUN and (p := self.link[v]) >= 0 and self.len[p] >= RUN:
                full[p].extend(full[v])
        self.places = full

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(nxt)
        self.places.append([])
        return len(self.len) - 1

    def _add(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:  # the word follows here already
            if self.len[q] == self.len[last] + 1:
                return q
            return self._split(last, w, q)
        cur, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def runs(self, ids: list[int]) -> set[tuple[int, int, int]]:
        """(item, item place - document place, document place) of the matches of at least RUN words, one a run."""
        seen: dict[tuple[int, int], int] = {}
        nxt, link, length = self.next, self.link, self.len
        out = set()
        v = m = 0
        for j, w in enumerate(ids):
            while v and w not in nxt[v]:
                v = link[v]
                m = length[v]
            v = nxt[v].get(w, 0)
            m = m + 1 if v else 0
            if m >= RUN:
                # the state's own places match m words, those of its suffix links fewer
                for n, at in self.places[v] if length[link[v]] < RUN else self._all(v):
                    key = (n, at - j)
                    if seen.get(key, -2) != j - 1:
                        out.add((n, at - j, j))
                    seen[key] = j
        return out

    def _all(self, v: int) -> set[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        while self.len[v] >= RUN:
            out.update(self.places[v])
            v = self.link[v]
        return out

    def found(self, words: list[str]) -> dict[int, tuple[int, int]]:
        """Item number -> (first, end) of the widest leaked stretch in the document's words."""
        get = self.vocab.get
        ids = [get(w, -1) for w in words]
        # only stretches of six known words can hold a match
        spans, start = [], None
        for j, w in enumerate(ids):
            if w < 0:
                if start is not None and j - start >= RUN:
                    spans.append((start, j))
                start = None
            elif start is None:
                start = j
        if start is not None and len(ids) - start >= RUN:
            spans.append((start, len(ids)))
        best: dict[int, tuple[int, int]] = {}
        for a, b in spans:
            for n, d, j in self.runs(ids[a:b]):
                j += a
                i = d + j - a  # item place of the run's last known word
                text = self.texts[n]
                if n in best and best[n][0] <= j < best[n][1]:
                    continue
                right = _reach(text, ids, i + 1, j + 1, 1)
                left = _reach(text, ids, i, j, -1)
                for e1, (li, lj) in enumerate(left):
                    for e2, (ri, rj) in enumerate(right):
                        size = li + ri
                        if size >= LEAST and PER_ERROR * (e1 + e2) <= size:
                            old = best.get(n)
                            if old is None or lj + rj > old[1] - old[0]:
                                best[n] = (j + 1 - lj, j + 1 + rj)
        return best


def _reach(item: list[int], doc: list[int], i: int, j: int, step: int) -> list[tuple[int, int]]:
    """For 0..MOST_ERRORS errors, the most (item words, document words) from (i, j) on that end in a match.

    Step 1 reads on from i and j, step -1 back from them.
    """
    if step > 0:
        a, b = item[i:], doc[j : j + len(item) - i + MOST_ERRORS + 1]
    else:
        a, b = item[i::-1], doc[max(0, j - i - MOST_ERRORS - 1) : j + 1][::-1]
    out: list[tuple[int, int]] = []
    front = {0: 0}  # document place less item place -> item words read, before this number of errors
    best = (0, 0)
    for _ in range(MOST_ERRORS + 1):
        after: dict[int, int] = {}
        for k, x in front.items():
            y = x + k
            s = x
            while x < len(a) and y < len(b) and a[x] == b[y]:
                x += 1
                y += 1
            if x > s and x > best[0]:
                best = (x, y)
            for kk, xx in ((k, x + 1), (k - 1, x + 1), (k + 1, x)):  # changed, missing, added
                if xx <= len(a) and 0 <= xx + kk <= len(b) and after.get(kk, -1) < xx:
                    after[kk] = xx
        out.append(best)
        front = after
    return out


_BUILT: dict[int, ItemAutomaton] = {}


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    block, words = [], 0
    for i, t in items.select(items[id_col], items[text_col]).distinct().toLocalIterator():
        if t is None or i is None:
            continue
        n = t.count(" ") + 1
        if block and words + n > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((i, t))
        words += n
    if block:
        yield block


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(document id, item id, first_word, n_words): the widest leaked stretch of each item in each document.

    Words are runs of letters and digits after folding case and look-alike characters. Null and
    empty texts and items of fewer than 18 words give nothing. Repeated rows count once. The items
    are a set of test material read in blocks of ``BLOCK_WORDS`` words; no part of the documents
    leaves the executors.
    """
    spark = docs.sparkSession
    kept = spread(docs.select(docs[doc_id], docs[text]))
    types = (dict(kept.dtypes)[doc_id], dict(items.dtypes)[item_id])
    schema = f"`{doc_id}` {types[0]}, `{item_id}` {types[1]}, first_word int, n_words int"
    parts = []
    for block in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)
        key = hash(tuple(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = ItemAutomaton(shared.value)
            auto = _BUILT[key]
            for b in batches:
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if t:
                        rows.extend((i, auto.ids[n], s, e - s) for n, (s, e) in auto.found(words_of(t)).items())
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field(0).type), pa.array(c[1]), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], names=[doc_id, item_id, "first_word", "n_words"])

        parts.append(kept.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts).distinct()


#: A stretch is taken out of a text if it has so many words, or is such a share of its item.
REMOVED_WORDS, REMOVED_SHARE = 18, 0.5


def cleaned(docs: DataFrame, items: DataFrame, hits: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, words: int = REMOVED_WORDS, share: float = REMOVED_SHARE) -> DataFrame:
    """(document id, text, removed, coverage): documents with leaked stretches taken out.

    A stretch goes if it has ``words`` words or is ``share`` of its item's words. ``removed`` counts the
    stretches, ``coverage`` is the largest share of an item that the document held. Documents without a
    leak give no row; overlapping stretches are taken out once. Of the documents only those with hits are
    joined, and their stretches are at most one an item.
    """
    hits = leaked(docs, items, doc_id, text, item_id, item_text) if hits is None else hits
    size = items.filter(items[item_text].isNotNull()).select(item_id, item_text).distinct().mapInArrow(_sizes, f"`{item_id}` {dict(items.dtypes)[item_id]}, size int").groupBy(item_id).agg(F.min("size").alias("size"))
    h = hits.join(size, item_id).withColumn("_share", F.col("n_words") / F.greatest("size", F.lit(1))).filter((F.col("n_words") >= words) | (F.col("_share") >= share))
    g = h.groupBy(doc_id).agg(F.sort_array(F.collect_set(F.struct("first_word", "n_words"))).alias("_spans"), F.count("*").alias("removed"), F.round(F.least(F.max("_share"), F.lit(1.0)), 4).alias("coverage"))
    j = docs.select(doc_id, text).distinct().join(g, doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [without_spans(t, [(s["first_word"], s["n_words"]) for s in spans]) for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(3), b.column(4)], names=[doc_id, text, "removed", "coverage"])

    return j.select(doc_id, text, "_spans", "removed", "coverage").mapInArrow(run, f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, `{text}` string, removed long, coverage double")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words_of(t)) for t in b.column(1).to_pylist()], pa.int32())], names=[b.schema.names[0], "size"])


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the given (first word, words) stretches."""
    if not text or not spans:
        return text
    at = [m.span() for m in _WORD.finditer(latin(text))] if text.isascii() else None
    if at is None:  # folding may change lengths: find the words in the text itself
        at = [m.span() for m in _WORD.finditer(text)]
        if len(at) != len(words_of(text)):
            return latin_without(text, spans)
    return _drop(text, at, spans)


def latin_without(text: str, spans: list[tuple[int, int]]) -> str:
    t = latin(text)
    return _drop(t, [m.span() for m in _WORD.finditer(t)], spans)


def _drop(text: str, at: list[tuple[int, int]], spans: list[tuple[int, int]]) -> str:
    out, pos = [], 0
    for first, n in sorted(spans):
        a, b = at[first][0], at[min(first + n, len(at)) - 1][1]
        if b > pos:
            out.append(text[pos : max(a, pos)])
            pos = b
    return "".join(out) + text[pos:]
