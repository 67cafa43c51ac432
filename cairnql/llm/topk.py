"""Exact top-k search by distributed histogram selection.

Every score is computed; the k-th value of each query is located by histograms of scores
that are summed over all tasks and refined in the bin where the k-th value lies, until that
bin is one integer wide.  Then the rows at or above it are filtered and ties broken by id.
The query set is worked off in blocks of bounded size, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .vectors import by_dimension, finite

BINS = 256
BLOCK = 16_384  # queries held by the driver and by each task at a time
AT_ONCE = 512


def quantise(x: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * x)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; raises if one might not fit in a long."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q @ c.T).astype(np.int64)
    if top < 2**63:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    raise OverflowError("an inner product does not fit in a long")


class _Block:
    """Up to ``BLOCK`` queries by dimension, with the state of the search."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids = ids
        sizes = np.array([len(v) for v in vectors])
        self.parts = {int(d): (at := np.flatnonzero(sizes == d), quantise(np.stack([vectors[i] for i in at]))) for d in np.unique(sizes)}
        self.low = np.zeros(len(ids), np.int64)

    def against(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, candidate ids, scores with own rows masked) in pieces."""
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at, x in by_dimension(batch.column(1)):
            if x.shape[1] not in self.parts:
                continue
            numbers, q = self.parts[x.shape[1]]
            c = quantise(x)
            for j in range(0, len(c), 4096):
                own = ids[at[j : j + 4096]]
                for i in range(0, len(q), AT_ONCE):
                    s = _scores(q[i : i + AT_ONCE], c[j : j + 4096])
                    n = numbers[i : i + AT_ONCE]
                    yield n, own, np.ma.MaskedArray(s, self.ids[n][:, None] == own[None, :])


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best other rows by integer inner product.

    Component x counts as floor(256 x).  Ties go to the smaller id.  Vectors that are null,
    empty or hold null or non-finite components take no part, nor do rows with a null id;
    vectors of another length than the query's are not its candidates.  Rows that repeat the
    query's id are its own; another id's repeated rows are candidates of their own.  A query
    with fewer candidates returns all of them.  A vector with a component so large that its
    product with itself might not fit in a long (beyond a million at 64 components) takes no
    part either, so that it costs no other query its answer.  Very long vectors are read
    whole; an empty table gives no rows; columns beside the id and the vector may have any
    names, as they are not read.
    """
    wide = F.aggregate(vector_col, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))) * 256.0 + 1.0
    rows = vectors.where(finite(vector_col) & F.col(id_col).isNotNull())
    rows = rows.where(wide * wide * F.size(vector_col) < float(1 << 62))
    asked = rows.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = save(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")))
    asked = save(asked.dropDuplicates(["id"]).repartitionByRange(F.col("id")).withColumn("block", F.lit(0)))
    n = asked.count()
    spark = vectors.sparkSession
    bound = rows.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))), F.max(F.size("v"))).first()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return out
    peak = (256 * bound[0] + 1) ** 2 * bound[1]
    if peak >= 2**62:
        raise OverflowError("an inner product does not fit in a long")
    pieces = [F.pmod(F.xxhash64("id"), F.lit(-(-n // BLOCK) * 2)) == b for b in range(-(-n // BLOCK) * 2)] if n > BLOCK else [F.lit(True)]
    for piece in pieces:
        held = asked.where(piece).select("id", "v").toPandas()
        if len(held):
            out = out.unionByName(_search(rows, _Block(held["id"].to_numpy(), [np.asarray(v, np.float64) for v in held["v"]]), k, int(peak)))
    return out


def _search(rows: DataFrame, block: _Block, k: int, peak: int) -> DataFrame:
    spark = rows.sparkSession
    n = len(block.ids)
    width = 1
    while width * BINS <= 2 * peak:
        width *= BINS
    low, need, whole = np.full(n, -peak, np.int64), np.full(n, k, np.int64), np.zeros(n, bool)
    while True:
        shared = spark.sparkContext.broadcast((block, low, width))

        def histogram(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, low, width = shared.value
            counts = np.zeros((n, BINS), np.int64)
            for b in batches:
                for q, _, s in block.against(b):
                    d = s.data - low[q][:, None]
                    ok = (d >= 0) & (d < width * BINS) & ~np.ma.getmaskarray(s)
                    i, j = np.nonzero(ok)
                    counts += np.bincount(q[i] * BINS + d[i, j] // width, minlength=n * BINS).reshape(n, BINS) if len(i) > 1 << 20 else 0
                    if len(i) <= 1 << 20:
                        np.add.at(counts, (q[i], d[i, j] // width), 1)
            # below its own k-th value a task's counts cannot hold the k-th of all
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            q, bins = np.nonzero((counts > 0) & (above < k))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(counts[q, bins])], ["q", "bin", "n"])

        hist = rows.mapInArrow(histogram, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        state = spark.createDataFrame(pa.table({"q": pa.array(np.arange(n), pa.int32()), "need": need}))
        from_top = Window.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
        cum = hist.withColumn("cum", F.sum("n").over(from_top)).join(F.broadcast(state), "q")  # at most BLOCK rows
        found = cum.where("cum >= need AND cum - n < need").selectExpr("q", "bin", "cum - n AS above").toPandas()
        got = np.zeros(n, bool)
        got[found["q"]] = True
        whole |= ~got  # fewer than k candidates: all of them are wanted
        low[found["q"]] += found["bin"].to_numpy().astype(np.int64) * width
        need[found["q"]] -= found["above"].to_numpy()
        if width == 1:
            break
        width //= BINS
    low[whole] = -peak
    shared = spark.sparkContext.broadcast((block, low))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low = shared.value
        keep = [np.empty((0, 3), np.int64)]
        for b in batches:
            for q, ids, s in block.against(b):
                i, j = np.nonzero((s.data >= low[q][:, None]) & ~np.ma.getmaskarray(s))
                keep.append(np.stack([q[i], s.data[i, j], ids[j]], axis=1))
            if sum(map(len, keep)) > 1 << 18:
                keep = [_first(np.concatenate(keep), k)]
        t = _first(np.concatenate(keep), k)
        if len(t):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[t[:, 0]]), pa.array(t[:, 2]), pa.array(t[:, 1])], ["query_id", "vec_id", "score"])

    kept = rows.mapInArrow(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first(t: np.ndarray, k: int) -> np.ndarray:
    """The first k rows (query, score, id) of each query, higher scores and then smaller ids first."""
    t = t[np.lexsort((t[:, 2], -t[:, 1], t[:, 0]))]
    start = np.flatnonzero(np.r_[True, t[1:, 0] != t[:-1, 0]]) if len(t) else np.empty(0, int)
    place = np.arange(len(t)) - np.repeat(start, np.diff(np.r_[start, len(t)]))
    return t[place < k]


TOP_K_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
