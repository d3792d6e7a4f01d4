"""Shapes of slides, lectures, cards and page regions: rules and flattenings as column expressions, greedy choices as folds of one page."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import norm_title
from papyrion.operators.biblio import title_overlap
from papyrion.operators.geometry import GAP


def slide_layout(kind: Column, figure_shape: Column, drawn: Column, cards: Column, bullets: Column) -> Column:
    """The layout of a slide from what it holds; ``figure_shape`` is null without a picture."""
    text = cards | bullets
    seen = figure_shape.isNotNull() | drawn
    return (
        F.when(kind.isin("title", "agenda", "section"), kind)
        .when(kind.isin("closing", "thanks"), "closing")
        .when(cards & seen, "figwide")
        .when(figure_shape == "wide", "figwide")
        .when(figure_shape.isNotNull(), F.when(text, "figside").otherwise("figfull"))
        .when(drawn, F.when(text, "split").otherwise("figfull"))
        .when(cards, "cards")
        .otherwise("list")
    )


def figure_shape(width: Column, height: Column) -> Column:
    """wide, tall or square by the ratio of its sides."""
    r = F.when(height > 0, width / height).otherwise(1.0)
    return F.when(r >= 1.9, "wide").when(r <= 0.85, "tall").otherwise("square")


def accepted_title(a: Column, b: Column) -> Column:
    """Whether a fuzzy hit is the same work: one title within the other, or six tenths of the shorter's words common."""
    x, y = norm_title(a), norm_title(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | (title_overlap(x, y) >= 0.6))


#: Titles of a side that meet at once, and words that are counted at once.
TITLE_ROWS, TITLE_WORDS = 2000, 2048


def accepted_pairs(a: DataFrame, b: DataFrame, rows: int = TITLE_ROWS) -> DataFrame:
    """(id, doc_id) of (id, title) and (doc_id, title) that begin with the same two words and are the same work by ``accepted_title``.

    Titles are put in form once. Those of a frequent beginning meet in blocks of ``rows`` on either side, each two
    blocks once; rarer beginnings share a block. Common words of all pairs of a block are one matrix product.
    """
    form = lambda x, i: x.select(i, norm_title(F.col("title")).alias("t")).filter("t <> ''").distinct().withColumn("k", F.array_join(F.slice(F.split("t", " "), 1, 2), " "))
    a, b = form(a, "id"), form(b, "doc_id")
    sizes = a.groupBy("k").agg(F.count("*").alias("n")).join(b.groupBy("k").agg(F.count("*").alias("m")), "k")
    parts = max(1, math.ceil((sizes.agg(F.sum(F.col("n") + F.col("m")).alias("n")).first().n or 0) / rows))
    sizes = sizes.select("k", F.ceil(F.col("n") / rows).alias("xs"), F.ceil(F.col("m") / rows).alias("ys"))

    def blocks(t: DataFrame, i: str, own: str, other: str) -> DataFrame:
        j = t.join(sizes, "k").withColumn(own, F.pmod(F.xxhash64(i, "t"), F.col(own + "s")))
        return j.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other + "s") - 1))).select(F.pmod(F.xxhash64("k"), F.lit(parts)).alias("part"), "x", "y", "k", i, "t")

    left, right = blocks(a, "id", "x", "y"), blocks(b, "doc_id", "y", "x")

    def meet(p: pa.Table, q: pa.Table) -> pa.Table:
        mine, yours = _by_beginning(p), _by_beginning(q)
        at, to = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in mine.keys() & yours.keys():
            (s, si), (t, ti) = mine[k], yours[k]
            i, j = np.nonzero(_same_works(s, t))
            # copies of a title: every row of one with every row of the other
            ni, nj = np.array([len(r) for r in si]), np.array([len(r) for r in ti])
            if ni.max() == nj.max() == 1:
                at.append(np.concatenate(si)[i])
                to.append(np.concatenate(ti)[j])
                continue
            for u, v in zip(i, j):
                at.append(np.repeat(si[u], nj[v]))
                to.append(np.tile(ti[v], ni[u]))
        return pa.table({"id": p.column("id").take(pa.array(np.concatenate(at))), "doc_id": q.column("doc_id").take(pa.array(np.concatenate(to)))})

    cell = ["part", "x", "y"]
    types = f"id {a.schema['id'].dataType.simpleString()}, doc_id {b.schema['doc_id'].dataType.simpleString()}"
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, types).distinct()


def _by_beginning(t: pa.Table) -> dict[str, tuple[list[str], list[np.ndarray]]]:
    """Titles by their beginning, each once with its rows."""
    found: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
    for i, (k, x) in enumerate(zip(t.column("k").to_pylist(), t.column("t").to_pylist())):
        found[k][x].append(i)
    return {k: (list(v), [np.array(r, np.int64) for r in v.values()]) for k, v in found.items()}


def _same_works(a: list[str], b: list[str]) -> np.ndarray:
    """Whether titles of one beginning are the same work, all a by all b.

    A title within another shares all its words but the last one with it, as the beginning is the same; with three
    words or more that is six tenths, so only titles of two different words are looked up as strings.
    """
    x, y = [set(t.split(" ")) for t in a], [set(t.split(" ")) for t in b]
    words = {w: i for i, w in enumerate(set().union(*x) & set().union(*y))}
    own = [np.array([(i, words[w]) for i, s in enumerate(z) for w in s if w in words], np.int64).reshape(-1, 2) for z in (x, y)]
    common = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(words), TITLE_WORDS):
        m = []
        for at, n in zip(own, common.shape):
            at = at[(at[:, 1] >= lo) & (at[:, 1] < lo + TITLE_WORDS)]
            m.append(np.zeros((n, min(TITLE_WORDS, len(words) - lo)), np.float32))
            m[-1][at[:, 0], at[:, 1] - lo] = 1
        common += m[0] @ m[1].T
    nx, ny = np.array([len(s) for s in x], np.float32), np.array([len(s) for s in y], np.float32)
    ok = 5 * common >= 3 * np.minimum(nx[:, None], ny[None, :])
    for i in np.flatnonzero(nx < 3):
        ok[i] |= [a[i] in t for t in b]
    for j in np.flatnonzero(ny < 3):
        ok[:, j] |= [b[j] in t for t in a]
    return ok


def to_top_left(boxes: DataFrame) -> DataFrame:
    """Boxes of (.., page, page_h, x0, y0, x1, y1) with the origin at the bottom left, counted from page 1, as boxes from the top left and page 0."""
    h = F.coalesce("page_h", F.lit(792.0))
    return boxes.withColumns({"page": F.col("page") - 1, "y0": h - F.col("y1"), "y1": h - F.col("y0")})


def graphic_clusters(boxes: DataFrame, gap: float = GAP) -> DataFrame:
    """(doc, page, band, x0, y0, x1, y1, n): rectangles merged by one vertical sweep; lines count as two points thick, slivers go."""
    b = boxes.withColumn("y1", F.greatest("y1", F.col("y0") + 2)).withColumn("x1", F.greatest("x1", F.col("x0") + 2))
    w = Window.partitionBy("doc", "page").orderBy("y0", "y1", "x0", "x1")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("_n", F.coalesce(F.col("y0") > reach + gap, F.lit(True)).cast("int")).withColumn("band", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = b.groupBy("doc", "page", "band").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))
    return g.filter((F.col("y1") - F.col("y0") >= 14) & (F.col("x1") - F.col("x0") >= 18))


def body_text(items: DataFrame) -> DataFrame:
    """Adds ``body``: whether a block is the text's own rather than a picture's.

    Of (.., heading, in_graphic, size, modal, width, modal_width, at_margin, centred, wide_gaps, lines); headings and
    captions always are, what lies on a drawing never; then type size, wide gaps between words, width and margin decide.
    """
    rule = (
        F.when(F.col("heading"), True)
        .when(F.col("in_graphic"), False)
        .when((F.col("size") > F.col("modal") + 0.4) & (F.col("at_margin") | F.col("centred")), True)
        .when(F.col("size") < F.col("modal") - 0.6, False)
        .when(F.col("wide_gaps") >= 0.25, False)
        .when((F.col("lines") >= 2) & (F.abs(F.col("width") - F.col("modal_width")) <= 10), True)
        .otherwise(F.col("at_margin"))
    )
    return items.withColumn("body", rule)


def captions_to_regions(captions: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc, id, region): captions (doc, page, pos, id, key, y) to regions (doc, page, region, key, y).

    First by their key (the first region of a key), then, in reading order, the nearest region of the page that
    is still free. The second is a fold over one page's captions.
    """
    first = regions.filter("key <> ''").groupBy("doc", "key").agg(F.min("region").alias("region"))
    once = captions.filter("key <> ''").join(first, ["doc", "key"]).groupBy("doc", "region").agg(F.min_by("id", "pos").alias("id"))
    left_c = captions.join(once.select("doc", "id"), ["doc", "id"], "left_anti").groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "y"))).alias("cs"))
    left_r = regions.join(once.select("doc", "region"), ["doc", "region"], "left_anti").groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("region", "y"))).alias("rs"))
    zero = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<id:string,region:string>>").alias("out"))

    def step(s, c):
        free = F.filter(F.col("rs"), lambda r: ~F.array_contains(s.used, r.region))
        best = F.element_at(F.array_sort(F.transform(free, lambda r: F.struct(F.abs(r.y - c.y).alias("d"), r.region.alias("region")))), 1)["region"]
        none = F.size(free) == 0
        return F.struct(F.when(none, s.used).otherwise(F.array_append(s.used, best)).alias("used"), F.when(none, s.out).otherwise(F.array_append(s.out, F.struct(c.id.alias("id"), best.alias("region")))).alias("out"))

    near = left_c.join(left_r, ["doc", "page"]).select("doc", F.explode(F.aggregate("cs", zero, step, lambda s: s.out)).alias("x")).select("doc", "x.id", "x.region")
    return once.select("doc", "id", "region").unionByName(near)


#: Section: its list, label and texts of an entry (fixed values).
LECTURE = {"mechanism": ("steps", None, ("do", "why")), "prereq": ("items", "term", ("why",)), "compare": ("items", "paper", ("took", "differs")), "limits": ("items", "point", ("so_what",))}


def lecture_texts(sections: DataFrame) -> DataFrame:
    """(doc, name, i, label, text): the prose of each section of (doc, name, entries, body); entries are maps.

    Sections of a known shape give an entry's texts, evidence what limits it, self-check questions nothing, the
    others their body; blanks go.
    """
    e = sections.select("doc", "name", F.posexplode("entries").alias("i", "m"))
    out = None
    for name, (_, label, parts) in LECTURE.items():
        own = e.filter(F.col("name") == name)
        tag = F.concat(F.lit("bước "), (F.col("i") + 1).cast("string")) if label is None else F.left(F.coalesce(F.col("m")[label], F.lit("")), F.lit(30))
        x = own.select("doc", "name", "i", tag.alias("label"), F.concat_ws(" ", *(F.coalesce(F.col("m")[p], F.lit("")) for p in parts)).alias("text"))
        out = x if out is None else out.unionByName(x)
    plain = sections.filter(~F.col("name").isin(*LECTURE, "check")).select("doc", "name", F.lit(0).alias("i"), F.lit("").alias("label"), F.coalesce("body", F.lit("")).alias("text"))
    return out.unionByName(plain).filter(F.trim("text") != "")


def first_warnings(warnings: DataFrame, kinds: list[str], most: int = 4) -> DataFrame:
    """(doc, section, msg): the first warning of the kinds in each section, of the first ``most`` sections that have one."""
    g = warnings.filter(F.col("kind").isin(*kinds)).groupBy("doc", "section").agg(F.min_by("msg", "pos").alias("msg"), F.min("pos").alias("pos"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).filter(F.col("r") <= most).select("doc", "section", "msg")


def summary_tree(leaves: DataFrame, most: int = 3, stop: int = 3) -> DataFrame:
    """(paper_id, level, ord, id, section, text, children): summaries over summaries, at most three levels.

    A paper stops where it has ``stop`` nodes or fewer, or where clustering joins nothing. One stage of
    DataFrames a level, for all papers at once.
    """
    from papyrion.operators.tree import fixed_clusters
    from papyrion.session import cut

    cur = leaves.select("paper_id", "id", "ord", "section", "text")
    made = None
    for level in range(1, most + 1):
        n = cur.groupBy("paper_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > stop)
        cur = cur.join(n, "paper_id")
        c = fixed_clusters(cur).join(cur.select("id", "ord", "section", "text", "_n"), "id")
        g = c.groupBy("paper_id", "run", "cluster", "_n").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "section", F.left(F.coalesce("text", F.lit("")), F.lit(220)).alias("t")))).alias("l"))
        k = F.count("*").over(Window.partitionBy("paper_id"))
        g = g.withColumn("_k", k).filter(F.col("_k") < F.col("_n")).withColumn("ord", F.row_number().over(Window.partitionBy("paper_id").orderBy("run", "cluster")))
        before = None if made is None else made.groupBy("paper_id").agg(F.max("ord").alias("_top"))
        if before is not None:
            g = g.join(before, "paper_id", "left").withColumn("ord", F.col("ord") + F.coalesce("_top", F.lit(0)))
        first = F.element_at("l", 1)
        s = cut(g.select("paper_id", F.lit(level).alias("level"), "ord", F.concat("paper_id", F.lit("s"), F.col("ord").cast("string")).alias("id"), first["section"].alias("section"), F.left(F.array_join(F.transform("l", lambda x: x.t), " "), F.lit(1200)).alias("text"), F.transform("l", lambda x: x.id).alias("children")))
        made = s if made is None else made.unionByName(s)
        cur = s.select("paper_id", "id", "ord", "section", "text")
    return made
