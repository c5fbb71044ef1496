"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

U64 = np.uint64


#: Removes a job's shuffle files as soon as its rows are written.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only in local mode without that setting (tests, a laptop) a temporary folder
    of this machine is set instead; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This ends the lineage: a lost executor costs one re-read of files, never a
    recomputation of what came before, and the table can be scanned many times.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hub_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", least: int = 2_000) -> DataFrame:
    """``big`` joined with ``small``, a written table of one row a key that counts big's rows of the key in ``rows``.

    Rows of a key over ``least`` and over a ten thousandth of all meet its row by
    broadcast, where they are: these keys are ten thousand at most.
    """
    total = small.agg(F.sum("rows")).first()[0] or 0
    limit = max(least, total // 10_000)
    hubs = small.where(F.col("rows") > limit)
    small = small.where(F.col("rows") <= limit).drop("rows")
    if hubs.isEmpty():
        return big.join(small, keys, how)
    hubs = hubs.drop("rows")
    warm = big.join(F.broadcast(hubs), keys, "inner" if how == "left" else how)
    return big.join(F.broadcast(hubs.select(*keys)), keys, "left_anti").join(small, keys, how).unionByName(warm)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def as_int64(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def bucket_runs(keys: list[np.ndarray]) -> np.ndarray:
    """Start offsets of runs of equal keys in sorted columns."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


#: Edges at one node from which they are not sent to the task of that node.
HUB = 100_000


def _lowest(edges: DataFrame, count: int) -> DataFrame:
    """``u, v, m`` for each edge, m the least neighbour of u.

    The rows of a hub meet its one value by broadcast: over ``HUB`` and a ten
    thousandth of all edges there are ten thousand hubs at most.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    if count <= HUB:
        return edges.join(low.select("u", "m"), "u")
    low = low.withColumn("hub", F.col("c") > max(HUB, count // 10_000)).checkpoint()
    hubs = low.where("hub")
    if hubs.isEmpty():
        return edges.join(low.select("u", "m"), "u")
    marked = edges.join(F.broadcast(hubs.select("u", F.col("m").alias("h"))), "u", "left")
    rest = marked.where("h is null").select("u", "v").join(low.where("not hub").select("u", "m"), "u")
    return rest.select("u", "v", "m").union(marked.where("h is not null").select("u", "v", F.col("h").alias("m")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as ``(a, b)`` longs.

    Returns ``(node, label)`` with the smallest node of each component as label,
    for nodes that have an edge.  Alternating large-star and small-star rounds;
    each round is checkpointed in the shared folder.  Only row counts and two
    sums reach the driver.  Stars of any size are fine: a round keeps a minimum
    per node, which is combined before the shuffle, and a hub's edges stay where
    they are.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    mark = F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = None
    while True:
        now = tuple(e.agg(*mark).first())
        if now == seen or not now[0]:
            break
        seen = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        e = (
            _lowest(large, now[0])
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct().checkpoint()
        )
    nodes = e.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
