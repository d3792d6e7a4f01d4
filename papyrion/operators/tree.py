"""Summary tree: clusters of neighbouring passages and their fallback summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST = 2, 6


def section_runs(chunk: DataFrame) -> DataFrame:
    """Adds the number of the run of equal sections each passage stands in (gaps and islands)."""
    w = Window.partitionBy("paper_id").orderBy("ord", "id")
    new = (F.coalesce("section", F.lit("")) != F.coalesce(F.lag("section").over(w), F.lit(""))) | (F.row_number().over(w) == 1)
    return chunk.withColumn("run", F.sum(new.cast("int")).over(w))


def fixed_clusters(chunk: DataFrame) -> DataFrame:
    """(paper_id, id, run, cluster): without vectors, runs are cut every six passages; a run of one joins the run before."""
    r = section_runs(chunk)
    n = r.withColumn("n", F.count("*").over(Window.partitionBy("paper_id", "run")))
    w = Window.partitionBy("paper_id").orderBy("ord", "id")
    start = ((F.col("n") >= LEAST) & (F.coalesce(F.lag("run").over(w), F.lit(0)) != F.col("run"))) | (F.row_number().over(w) == 1)
    g = n.withColumn("grp", F.sum(start.cast("int")).over(w))
    k = F.row_number().over(Window.partitionBy("paper_id", "grp").orderBy("ord", "id")) - 1
    return g.withColumn("cluster", F.floor(k / MOST).cast("int")).select("paper_id", "id", F.col("grp").alias("run"), "cluster")


def cut_group(sims: np.ndarray, size: int) -> list[int]:
    """Places to cut a run of ``size`` passages where neighbours are least alike, so that no part is a lone passage.

    ``size / MOST`` parts are wanted. A place that would leave fewer than ``LEAST`` passages at an end or
    beside an earlier cut is closed; of the open places the lowest similarity is taken, the first of equals.
    """
    open_ = np.where((np.arange(size - 1) >= LEAST - 1) & (np.arange(size - 1) <= size - 1 - LEAST), np.asarray(sims, float), np.inf)
    cuts = []
    for _ in range(round(size / MOST) - 1 if size > MOST else 0):
        at = int(np.argmin(open_))
        if not np.isfinite(open_[at]):
            break
        cuts.append(at)
        open_[max(0, at - LEAST + 1) : at + LEAST] = np.inf
    return sorted(cuts)


def similar_clusters(chunk: DataFrame, emb: DataFrame) -> DataFrame:
    """(paper_id, id, run, cluster) with vectors: long runs are cut where the topic turns.

    The work is per run of one section. A collected volume may be one hot paper, so the group key is
    (paper, run): a run is the longest thing that must be seen at once.
    """
    base = fixed_clusters(chunk)
    x = base.join(chunk.select("id", "ord"), "id").join(emb.select(F.col("chunk_id").alias("id"), "vec"), "id", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "id"])
        vecs = list(pdf["vec"])
        out = pdf[["paper_id", "id", "run", "cluster"]].copy()
        if len(pdf) > MOST and all(v is not None for v in vecs) and len({len(v) for v in vecs}) == 1:
            m = np.array([np.asarray(v, float) for v in vecs])
            cuts = cut_group((m[:-1] * m[1:]).sum(1), len(m))
            out["cluster"] = np.searchsorted(np.array(cuts), np.arange(len(m)), "left") if cuts else 0
        return out

    return x.groupBy("paper_id", "run").applyInPandas(fold, "paper_id string, id string, run long, cluster int")


def summaries(chunk: DataFrame, clusters: DataFrame) -> DataFrame:
    """(paper_id, run, cluster, n, text): the first 220 characters of each child in order, at most 1,200."""
    x = clusters.join(chunk.select("id", "ord", "text"), "id")
    g = x.groupBy("paper_id", "run", "cluster").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "id", F.left(F.coalesce("text", F.lit("")), F.lit(220)).alias("t")))).alias("l"))
    return g.select("paper_id", "run", "cluster", "n", F.left(F.array_join(F.transform("l", lambda s: s.t), " "), F.lit(1200)).alias("text"))
