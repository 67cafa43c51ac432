"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnql.session import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (single-machine tests) a temporary folder is made.
    """
    named = shared_folder(spark) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairnql-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def save(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike a local checkpoint the files outlive a lost executor; unlike ``checkpoint()``
    they are compressed and column-pruned.  They go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairnql-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


_worker: dict[str, dict] = {"": {}}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps for one operator between its tasks.

    Workers outlive a query; when another operator starts in one, what the last one kept goes,
    so that a worker never holds the vocabularies and caches of several.
    """
    if owner not in _worker:
        _worker.clear()
        _worker[owner] = {}
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _worker[owner]


def slices(batches: Iterable[pa.RecordBatch], owner: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A task's batches in slices of at most ``rows`` rows and about ``size`` bytes, so that few texts are Python objects at a time."""
    worker_cache(owner)
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for o in range(0, b.num_rows, step):
            yield b.slice(o, step)


def unused(names: list[str], like: str) -> str:
    """A column name that none of ``names`` equals, whatever the case."""
    taken = {n.lower() for n in names}
    while like.lower() in taken:
        like += "_"
    return like


def positions(df: DataFrame, cls: str, order: list[str], out: str, rows: int) -> DataFrame:
    """Gapless 0-based position ``out`` of every row within its class, without a global sort.

    Rows of a class are dealt to hash buckets of about 20,000 rows; a row's position is the
    number of rows in earlier buckets plus its number in its own, so that no task ever holds
    a whole (possibly hot) class.  ``order`` names columns that set the order in a bucket;
    a number of the row is hashed with them, as wholly repeated rows have all of them in
    common.  ``df`` must be saved, for it is read twice and rows must keep their numbers.
    """
    buckets = max(64, rows // 20_000)
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id() % 64), F.lit(buckets)))
    counts = b.groupBy(cls, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(cls).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(cls).alias("_cls"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(cls, "_b").orderBy(*order)
    numbered = b.withColumn("_k", F.row_number().over(within) - 1)
    joined = numbered.join(starts, (F.col(cls) == F.col("_cls")) & (F.col("_b") == F.col("_b2")))
    return joined.withColumn(out, (F.col("_start") + F.col("_k")).cast("long")).drop("_b", "_k", "_cls", "_b2", "_start")


#: Rows of two numbers that a join may send to every executor: some 10 MB.
BROADCAST_ROWS = 250_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (saved, a few numbers a row) for a join: broadcast if counted within the bound, else as Spark plans it."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as rows (u, v) of longs: rows (node, comp).

    ``comp`` is the smallest node of the component; nodes without an edge do not appear.
    Every round hooks each node to its smallest neighbour, jumps pointers until all trees are
    stars and contracts the edges; at least half of the nodes with edges go each round.  All
    state stays in distributed tables; only row counts reach the driver.  The side of a join
    with one row a node is broadcast while it is small; beyond that a frequent key is all on
    the other side, whose rows adaptive execution splits.
    """
    spark = edges.sparkSession
    cur = save(edges.where("u <> v").selectExpr("least(u, v) AS u", "greatest(u, v) AS v").distinct())
    maps: list[DataFrame] = []
    while not cur.isEmpty():
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = save(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS node", "least(u, m) AS parent"))
        nodes = parent.count()
        while True:
            up = small_side(parent.selectExpr("node AS parent", "parent AS up"), nodes)
            jumped = save(parent.join(up, "parent").selectExpr("node", "up AS parent", "up <> parent AS moved"))
            parent = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        maps.append(parent)
        pu = parent.selectExpr("node AS u", "parent AS pu")
        pv = parent.selectExpr("node AS v", "parent AS pv")
        cur = save(
            cur.join(small_side(pu, nodes), "u").join(small_side(pv, nodes), "v").where("pu <> pv")
            .selectExpr("least(pu, pv) AS u", "greatest(pu, pv) AS v").distinct()
        )
    if not maps:
        return spark.createDataFrame([], "node long, comp long")
    # every contraction keeps the smallest node of a star as its root, so the last root is the smallest of all
    comp = maps[-1].selectExpr("node", "parent AS comp")
    for earlier in reversed(maps[:-1]):
        later = comp.selectExpr("node AS parent", "comp")
        comp = earlier.join(later, "parent", "left").selectExpr("node", "coalesce(comp, parent) AS comp")
    return comp
