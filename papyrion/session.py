"""Session helpers: one factory for tests and benches, and checkpoint-safe lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cpus: int | str = "*", app: str = "papyrion", **conf: str) -> SparkSession:
    """Local session for tests and benches; a cluster brings its own session."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset (tests, one machine) is a folder of our own set.
    """
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if where.isDefined():
        return where.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "papyrion-checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, *, release: bool = False) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor loses nothing.

    With ``release`` the shuffle files that led to the checkpoint are removed once it is written,
    not when the driver's garbage is next collected.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not release:
        return df.checkpoint(eager=True)
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:  # a frame takes the setting when it is made
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, was)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system, with or without a scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def path_state(spark: SparkSession, path: str) -> str:
    """Size, number of files and time of change of a path: what tells a rewritten table from the old one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    c, at = fs.getContentSummary(p), fs.getFileStatus(p)
    return f"{at.getPath()}:{c.getLength()}:{c.getFileCount()}:{at.getModificationTime()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where the input comes in fewer parts than half of them.

    A small file is one split and so one task. With as many splits as cores, as in any large input,
    nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def sample_by_hash(df: DataFrame, key: str, n: int, total: int | None = None) -> DataFrame:
    """At most ``n`` rows, chosen by the hash of a key: the same at any partitioning.

    A threshold from the number of rows comes first, so that each part sends but its share to the
    sort; the sort then settles the exact rows.
    """
    from pyspark.sql import functions as F

    total = df.count() if total is None else total
    rate = min(1.0, 1.5 * n / max(total, 1) + 100 / max(total, 1))
    h = F.xxhash64(key)
    few = df if rate >= 1 else df.filter(F.pmod(h, F.lit(1_000_000)) < max(1, int(rate * 1_000_000)))
    return few.orderBy(h, key).limit(n)
