"""Problem 8: encode a whole corpus with a public byte-level BPE tokenizer.

Forced-boundary splitting. A merge can only ever build a byte string that is a vocabulary token,
so two neighbouring bytes that stand side by side in no token can never end up in one token: the
place between them is a certain cut, and the parts on its two sides are encoded independently and
concatenated. A blank after a byte that is not white space is such a place, which cuts running text
into short fragments that repeat all over a corpus; inside a fragment the tokenizer's own pattern
and the remaining forced cuts apply. Each distinct fragment is encoded once per worker (bounded
memo), the rest is dictionary look-ups. One narrow stage: no shuffle, no driver work.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from papyrion.session import spread

#: Entries of a worker's memo before it is emptied; keeps a worker below some 200 MB.
MEMO = 400_000


def default_path() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers as P

    return P.PATTERN


class ForcedBoundaryBPE:
    """Encoder for one rank file (``base64-token rank`` a line) and its splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        inside = bytearray(65536)
        for t in self.ranks:
            for a, b in zip(t, t[1:]):
                inside[a << 8 | b] = 1
        self.inside = inside
        #: Whether no token holds a blank after anything but white space: such blanks are forced cuts.
        self.blank_cuts = all(x == "" or x[-1].isspace() for t in self.ranks for x in t.decode("utf-8", "surrogateescape").split(" ")[:-1])
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Rank-order merging with a heap over a linked list: n log n, also for very long pieces."""
        ranks = self.ranks
        n = len(piece)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0: merged away
        prev = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                if (q := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (q, i, end[stop]))
            if (p := prev[i]) >= 0 and (q := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (q, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def fragment(self, text: str) -> tuple[int, ...]:
        """Ids of one fragment: the pattern, then the forced cuts, then merging."""
        ids: list[int] = []
        ranks, inside = self.ranks, self.inside
        for word in self.pattern.findall(text):
            piece = word.encode("utf-8", "replace")
            if (r := ranks.get(piece)) is not None:
                ids.append(r)
                continue
            start = 0
            for i in range(1, len(piece) + 1):
                if i == len(piece) or not inside[piece[i - 1] << 8 | piece[i]]:
                    part = piece[start:i]
                    if (r := ranks.get(part)) is not None:
                        ids.append(r)
                    else:
                        ids.extend(self.merge(part))
                    start = i
        return tuple(ids)

    def cuts(self, text: str) -> list[str]:
        """Fragments of a text: a cut before each blank that follows a non-blank and starts a word."""
        if not self.blank_cuts:
            return [text]
        head, *rest = text.split(" ")
        out = [head] if head else []
        glue = "" if head else None  # white space that the next fragments may still join
        for u in rest:
            if u and not u[0].isspace():
                if glue is not None:
                    if glue:
                        out.append(glue)
                    glue = None
                out.append(" " + u)
                if u[-1].isspace():
                    glue = out.pop()
            else:
                glue = (out.pop() if glue is None and out else glue or "") + " " + u
        if glue:
            out.append(glue)
        return out

    def encode(self, text: str | None, out: list[int]) -> None:
        """Append the ids of a text; null and empty texts have none."""
        if not text:
            return
        memo = self.memo
        for f in self.cuts(text):
            ids = memo.get(f)
            if ids is None:
                ids = self.fragment(f)
                if len(f) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[f] = ids
            out.extend(ids)


_ENCODERS: dict[int, ForcedBoundaryBPE] = {}


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row.

    Null, empty: an empty list (never a null list). Blank text: the ids of its white space.
    Repeated rows come out as often as they come in. Other columns are ignored, whatever their names.
    The rank file (below 1 MB) is read once on the driver and shipped with the function.
    """
    with open(path or default_path(), "rb") as f:
        ranks = f.read()
    rule = pattern or default_pattern()
    shared = docs.sparkSession.sparkContext.broadcast((ranks, rule))
    key = hash((ranks, rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS[key] = ForcedBoundaryBPE(*shared.value)
        bpe = _ENCODERS[key]
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for text in b.column(1).to_pylist():
                bpe.encode(text, flat)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    kept = spread(docs.select(docs[id_col], docs[text_col]))
    kind = dict(kept.dtypes)[id_col]
    return kept.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
