"""Page geometry over tables of glyph runs and boxes: (doc, page, x0, y0, x1, y1).

Joins are equi-joins on document and page with a range condition on top, so what is compared is
bounded by a page; sweeps are windows over one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of a run that a box must cover, and the gap within which rectangles merge (fixed values).
COVER, GAP = 0.33, 26.0


def _pairs(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    b = boxes.select("doc", "page", F.col("box_id"), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    return spans.join(b, ["doc", "page"])


def assign_spans(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """(span_id, box_id): each run to the smallest box that holds its centre, else to the box that covers most of it.

    Runs that no box covers by a third go to none; ties by box id.
    """
    p = _pairs(spans, boxes)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (cx >= F.col("bx0")) & (cx <= F.col("bx1")) & (cy >= F.col("by0")) & (cy <= F.col("by1"))
    w = F.greatest(F.lit(0.0), F.least("x1", "bx1") - F.greatest("x0", "bx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "by1") - F.greatest("y0", "by0"))
    area = F.greatest(F.lit(1e-9), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    p = p.withColumn("_in", inside).withColumn("_share", F.round(w * h / area, 9)).withColumn("_box", (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))).filter(F.col("_in") | (F.col("_share") >= COVER))
    # inside first and smallest, else most covered: one arg-min instead of two passes
    key = F.struct((~F.col("_in")).cast("int"), F.when(F.col("_in"), F.col("_box")).otherwise(-F.col("_share")), F.col("box_id"))
    return p.groupBy("doc", "page", "span_id").agg(F.min_by("box_id", key).alias("box_id"))


def uncovered(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """Runs whose centre lies in no box."""
    s, b = spans.alias("s"), boxes.alias("b")
    cx, cy = (F.col("s.x0") + F.col("s.x1")) / 2, (F.col("s.y0") + F.col("s.y1")) / 2
    cond = (F.col("s.doc") == F.col("b.doc")) & (F.col("s.page") == F.col("b.page")) & (cx >= F.col("b.x0")) & (cx <= F.col("b.x1")) & (cy >= F.col("b.y0")) & (cy <= F.col("b.y1"))
    return s.join(b, cond, "left_anti")


def merged_bands(boxes: DataFrame, gap: float = GAP) -> DataFrame:
    """(doc, page, band, y0, y1, n): rectangles whose vertical ranges touch within the gap, by one sweep."""
    w = Window.partitionBy("doc", "page").orderBy("y0", "y1", "box_id")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("y0") > reach + gap, F.lit(True)).cast("int")
    b = boxes.withColumn("_n", new).withColumn("band", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("doc", "page", "band").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def body_size(spans: DataFrame) -> DataFrame:
    """(doc, size): the font size most characters are set in; the smaller where it ties."""
    n = spans.groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return n.groupBy("doc").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("size"))


def reading_order(boxes: DataFrame, middle: float) -> DataFrame:
    """(doc, box_id, place): by page, column, line (a tenth), and left edge."""
    w = Window.partitionBy("doc").orderBy("page", (F.col("x0") >= middle).cast("int"), F.round("y0", 1), "x0", "box_id")
    return boxes.select("doc", "box_id", F.row_number().over(w).alias("place"))


def line_gaps(spans: DataFrame) -> DataFrame:
    """(doc, page, line, gap, n): the upper median of the gaps between neighbouring runs of a line, and their number."""
    w = Window.partitionBy("doc", "page", "line").orderBy("x0", "span_id")
    g = spans.withColumn("line", F.round("y0", 0)).withColumn("gap", F.round(F.col("x0") - F.lag("x1").over(w), 6)).filter("gap is not null")
    a = g.groupBy("doc", "page", "line").agg(F.array_sort(F.collect_list("gap")).alias("l"))
    return a.select("doc", "page", "line", F.element_at("l", (F.floor(F.size("l") / 2) + 1).cast("int")).alias("gap"), F.size("l").alias("n"))


def page_stats(boxes: DataFrame) -> DataFrame:
    """(doc, width, margins, gap): the modal width, up to six left margins of three boxes or more, and the upper median gap."""
    w = boxes.groupBy("doc", F.round(F.col("x1") - F.col("x0"), 0).alias("w")).agg(F.count("*").alias("n")).groupBy("doc").agg(F.max_by("w", F.struct("n", -F.col("w"))).alias("width"))
    m = boxes.groupBy("doc", F.round("x0", 0).alias("x")).agg(F.count("*").alias("n")).filter("n >= 3").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "x"))).alias("l"))
    m = m.select("doc", F.slice(F.transform("l", lambda s: s.x), 1, 6).alias("margins"))
    g = boxes.withColumn("gap", F.round(F.col("y0") - F.lag("y1").over(Window.partitionBy("doc", "page").orderBy("y0", "box_id")), 6)).filter("gap > 0")
    g = g.groupBy("doc").agg(F.array_sort(F.collect_list("gap")).alias("l")).select("doc", F.element_at("l", (F.floor(F.size("l") / 2) + 1).cast("int")).alias("gap"))
    return w.join(m, "doc", "left").join(g, "doc", "left").withColumn("margins", F.coalesce("margins", F.array().cast("array<double>")))


#: Share of a page's width around its middle, share of runs that may cross it, line gaps within a paragraph (fixed values).
SLACK, CROSSING, WITHIN = 0.02, 0.10, 1.6


def loose_paragraphs(spans: DataFrame) -> DataFrame:
    """(doc, page, col, para, y0, text, lines): runs that no box holds as paragraphs, of (doc, page, page_w, span_id, x0, y0, x1, y1, text).

    A page has two columns where hardly any run crosses its middle and both sides hold some; then runs of one
    height are lines, and lines closer than 1.6 heights one paragraph.
    """
    mid, slack = F.col("page_w") / 2, F.col("page_w") * SLACK
    w = Window.partitionBy("doc", "page")
    cross = F.count_if((F.col("x0") < mid - slack) & (F.col("x1") > mid + slack)).over(w)
    left, right = F.count_if(F.col("x1") <= mid).over(w), F.count_if(F.col("x0") >= mid).over(w)
    two = (cross <= F.greatest(F.lit(2.0), F.count("*").over(w) * CROSSING)) & (left > 0) & (right > 0)
    s = spans.withColumn("_two", two).withColumn("col", F.when(F.col("_two") & ((F.col("x0") + F.col("x1")) / 2 >= mid), 1).otherwise(0))
    rows = s.groupBy("doc", "page", "col", F.round("y0", 0).alias("line")).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.array_sort(F.collect_list(F.struct("x0", "span_id", "text"))).alias("l"))
    rows = rows.withColumn("text", F.array_join(F.transform("l", lambda x: x.text), " "))
    v = Window.partitionBy("doc", "page", "col").orderBy("y0", "line")
    h = F.col("y1") - F.col("y0")
    gap = F.col("y0") - F.lag("y1").over(v)
    near = (gap >= 0) & (gap <= F.greatest(h, F.lag(h).over(v)) * WITHIN)
    rows = rows.withColumn("_n", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("para", F.sum("_n").over(v))
    g = rows.groupBy("doc", "page", "col", "para").agg(F.array_sort(F.collect_list(F.struct("y0", "line", "text"))).alias("l"), F.min("y0").alias("y0"))
    return g.select("doc", "page", "col", "para", "y0", F.array_join(F.transform("l", lambda x: x.text), " ").alias("text"), F.size("l").alias("lines"))
