"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one row throughout.  A pass orders the others lexicographically by a key of
concatenated random hashes (signs of random projections) and compares each with a window of
neighbours in that order; a window has the same number of vectors wherever it lies.  Links
found are verified in double precision and united across passes.  Passes are added, a few at
a time, until the links of a sample of vectors, found by comparing the sample with all rows,
lie within components; if that never comes about, as in a dense crowd of vectors that are
all a little less alike than the threshold, all pairs are compared, tile against tile.  The
number of links of a vector is then counted exactly within its component.

So a link can be lost only between two components that no pass brought together, and the
sample bounds how often that happens; up to ``BLOCK`` different vectors nothing is lost.
Products in single precision set aside the pairs that cannot reach the threshold by more
than their rounding error; all others are decided in double precision.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
Very long vectors are compared whole.  Repeated rows and equal vectors count each other as
links.  Of several smallest ids the smallest is the component.  An empty table gives no rows;
only the id and the vector are read, so other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, save, small_side
from .vectors import by_dimension, finite, unit

#: Rows and columns of a block of products, and vectors of a tile; none of them changes a result.
CHUNK, COLUMNS, TILE = 1024, 256, 8192
#: Vectors compared as one block, and how many of those that follow it are compared with them.
BLOCK, WINDOW = 1024, 256
#: Passes made at a time, the first number of them and the last, and bits of a key.
AT_ONCE, LEAST, MOST, BITS = 4, 8, 48, 60
#: Vectors whose links are looked for in all rows, and the share of these that the passes must have found.
SAMPLE, FOUND = 1024, 0.995


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of ``a`` and ``b``; ``label`` holds the smallest member of each."""
    while len(a):
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        label[:] = up[label]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]


def _compare(x: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each unit vector, weighed by ``m``, and its component, from all pairs of left and right.

    Left and right are the same rows or have none in common."""
    label, n = np.arange(len(x)), np.zeros(len(x), np.int64)
    same = left is right
    low = threshold - (x.shape[1] + 8) * 2.0**-22  # beyond the rounding of single precision
    y = x.astype(np.float32)
    for i in range(0, len(left), CHUNK):
        rows = left[i : i + CHUNK]
        for j in range(0, len(right), COLUMNS):
            cols = right[j : j + COLUMNS]
            maybe = y[rows] @ y[cols].T >= low
            r, c = rows[maybe.any(axis=1)], cols[maybe.any(axis=0)]
            if not len(r):
                continue
            near = (x[r] @ x[c].T >= threshold) & (r[:, None] != c[None, :])
            n[r] += (near * m[c][None, :]).sum(axis=1)
            if not same:
                n[c] += (near * m[r][:, None]).sum(axis=0)
            u, v = np.nonzero(near)
            u, v = label[r[u]], label[c[v]]
            _unite(label, u[u != v], v[u != v])
    return n, label


def _keys(reps: DataFrame, first: int, passes: int) -> DataFrame:
    """(rid, d, p, key): for each vector its dimension and, for each pass, the signs of its projections."""

    def run(batches):
        for b in batches:
            rid = b.column(0).to_numpy()
            for at, x in by_dimension(b.column(1)):
                x = unit(x).astype(np.float32)
                for p in range(first, first + passes):
                    r = np.random.default_rng((p, x.shape[1])).standard_normal((x.shape[1], BITS)).astype(np.float32)
                    key = np.zeros(len(x), np.int64)
                    for bit in (x @ r > 0).T:
                        key = 2 * key + bit
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid[at]), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(np.full(len(x), p, np.int32)), pa.array(key)], ["rid", "d", "p", "key"]
                    )

    return reps.select("rid", "v").mapInArrow(run, "rid long, d int, p int, key long")


def _pass(reps: DataFrame, rows: int, first: int, passes: int, threshold: float) -> DataFrame:
    """Verified links (u, v) from windows of the orders of some passes; their closure is that of all pairs within windows."""
    keys = _keys(reps, first, passes)
    order = ["p", "d", "key", "rid"]
    # an order by ranges, saved with the number of each range, so that places are counted in what was written
    ranged = save(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    at = ranged.withColumn("k", own).join(F.broadcast(starts), "part").select("rid", "p", ((F.col("start") + F.col("k")) % F.lit(rows)).alias("at"))
    block = F.floor(F.col("at") / BLOCK)
    # the first vectors of a block are also the window behind the block before
    roles = F.when((F.col("at") % BLOCK < WINDOW) & (block > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    placed = at.select("rid", "p", block.alias("block"), F.explode(roles).alias("behind")).withColumn("block", F.col("block") - F.col("behind"))
    met = placed.join(reps.select("rid", "v"), "rid")

    def run(table: pa.Table) -> pa.Table:
        b = table.combine_chunks()
        behind, rid = b["behind"].to_numpy(), b["rid"].to_numpy()
        out = [(np.empty(0, np.int64),) * 2]
        for at, x in by_dimension(b["v"].chunk(0)):
            x, one = unit(x), np.ones(len(at), np.int64)
            own, after = np.flatnonzero(behind[at] == 0), np.flatnonzero(behind[at] == 1)
            for right in (own, after):
                _, label = _compare(x, one, own, right, threshold)
                moved = label != np.arange(len(at))
                out.append((rid[at][moved], rid[at[label]][moved]))
        return pa.table(dict(zip(("u", "v"), map(np.concatenate, zip(*out)))))

    return met.groupBy("p", "block").applyInArrow(run, "u long, v long")


def _found(reps: DataFrame, comps: DataFrame, threshold: float) -> tuple[int, int]:
    """Links of a sample of vectors with all others: how many there are, and how many within components."""
    picked = F.xxhash64("rid")
    asked = reps.select("rid", "v", picked.alias("h")).orderBy("h", "rid").limit(SAMPLE)
    of = comps.select(F.col("node").alias("rid"), "comp")
    labelled = lambda df: df.join(small_side(of), "rid", "left").select("rid", "v", F.coalesce("comp", "rid").alias("comp"))
    held = labelled(asked).toPandas()  # SAMPLE rows
    by = {}
    for i, v in enumerate(held["v"]):
        by.setdefault(len(v), []).append(i)
    parts = {d: (held["rid"].to_numpy()[at], held["comp"].to_numpy()[at], unit(np.stack([np.asarray(held["v"][i], np.float64) for i in at]))) for d, at in by.items()}
    shared = reps.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        parts, links, within = shared.value, 0, 0
        for b in batches:
            rid, comp = b.column(0).to_numpy(), b.column(2).to_numpy()
            for at, x in by_dimension(b.column(1)):
                if x.shape[1] not in parts:
                    continue
                q_rid, q_comp, q = parts[x.shape[1]]
                x = unit(x)
                for o in range(0, len(x), CHUNK):
                    i, j = np.nonzero(q @ x[o : o + CHUNK].T >= threshold)
                    other = q_rid[i] != rid[at[o + j]]
                    links += int(other.sum())
                    within += int((other & (q_comp[i] == comp[at[o + j]])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([within])], ["links", "within"])

    r = labelled(reps).mapInArrow(run, "links long, within long").agg(F.sum("links"), F.sum("within")).first()
    return r[0] or 0, r[1] or 0


def _links(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(rid, n, top) for each vector of (rid, m, v, comp) and pair of tiles of its component in which it links with others.

    Components up to a tile are one group, or share one with other small ones; the vectors of
    a larger one are dealt to tiles, and each pair of tiles is a group.
    """
    sizes = save(members.groupBy("comp").agg(F.count(F.lit(1)).alias("size")))
    small = sizes.where(F.col("size") <= tile).agg(F.sum("size")).first()[0] or 0
    dealt = sizes.select("comp", F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
    shared = -1 - F.pmod(F.xxhash64("comp"), F.lit(max(1, small // 4096)))
    spread = (
        members.join(small_side(dealt), "comp")
        .withColumn("g", F.when(F.col("tiles") > 1, F.col("comp")).otherwise(shared))
        .withColumn("t", F.pmod(F.xxhash64("rid"), F.col("tiles").cast("long")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("g", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "comp", "rid", "m", "v")
    )

    def run(table: pa.Table) -> pa.Table:
        b = table.combine_chunks()
        i, j, t, comp, rid, m = (b[c].to_numpy() for c in ("i", "j", "t", "comp", "rid", "m"))
        out = [(np.empty(0, np.int64),) * 3]
        for at, x in by_dimension(b["v"].chunk(0)):
            order = np.argsort(comp[at], kind="stable")
            ends = np.flatnonzero(np.r_[comp[at][order][1:] != comp[at][order][:-1], True]) + 1
            for lo, hi in zip(np.r_[0, ends[:-1]], ends):
                own = order[lo:hi]
                left = np.flatnonzero(t[at[own]] == i[0])
                n, label = _compare(unit(x[own]), m[at[own]], left, left if i[0] == j[0] else np.flatnonzero(t[at[own]] == j[0]), threshold)
                linked = n > 0
                out.append((rid[at[own]][linked], n[linked], rid[at[own][label]][linked]))
        return pa.table(dict(zip(("rid", "n", "top"), map(np.concatenate, zip(*out)))))

    return spread.groupBy("g", "i", "j").applyInArrow(run, "rid long, n long, top long")


def _components(reps: DataFrame, rows: int, threshold: float) -> DataFrame | None:
    """Components (node, comp) by sorted passes; None if they miss too many of the sample's links."""
    edges = reps.sparkSession.createDataFrame([], "u long, v long")
    done, least = 0, LEAST + AT_ONCE * (max(0, rows // 10_000).bit_length() // 4)
    while True:
        edges = save(edges.union(_pass(reps, rows, done, AT_ONCE, threshold)).distinct())
        done += AT_ONCE
        if done < least and rows > BLOCK:
            continue
        comps = connected_components(edges)
        if rows <= BLOCK:  # every pair was in one block
            return comps
        comps = save(comps)
        links, within = _found(reps, comps, threshold)
        if within >= FOUND * links:
            return comps
        if done >= MOST:
            return None


def near_duplicates(
    vectors: DataFrame, *, threshold: float = 0.95, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per input row: (id, n_links, component).

    ``n_links`` counts the other rows with a cosine of at least ``threshold``, equal vectors
    included; ``component`` is the smallest id reachable by links.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, as do rows with a
    null id (component null) and vectors of different lengths.  Repeated rows count each.
    """
    at = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = finite("v") & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    valid = at.where(good)
    reps = save(valid.groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).withColumn("rid", F.monotonically_increasing_id()))
    rows = reps.count()
    if not rows:
        return at.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    comps = _components(reps, rows, threshold)
    if comps is None:  # all pairs: one crowd, of which the links say what hangs together
        seen = save(_links(reps.select("rid", "m", "v", F.lit(0).cast("long").alias("comp")), threshold, tile))
        comps = connected_components(seen.select(F.col("rid").alias("u"), F.col("top").alias("v")))
        members = save(reps.select("rid", "first").join(comps.select(F.col("node").alias("rid"), "comp"), "rid"))
    else:
        members = save(reps.join(small_side(save(comps.select(F.col("node").alias("rid"), "comp"))), "rid").select("rid", "m", "v", "first", "comp"))
        seen = save(_links(members.select("rid", "m", "v", "comp"), threshold, tile))
        members = members.select("rid", "first", "comp")
    linked = seen.groupBy("rid").agg(F.sum("n").alias("n"))
    least = save(members.groupBy("comp").agg(F.min("first").alias("component")))
    more = members.join(small_side(least), "comp").select("rid", "component").join(linked, "rid")
    known = reps.join(small_side(save(more)), "rid", "left").select(
        F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "first").alias("component")
    )
    # equal vectors are one key; adaptive execution splits their rows, as each vector has one row on the other side
    found = valid.join(known, valid["v"] == known["_v"]).select("id", "n_links", "component")
    return found.union(at.where(~good).select("id", F.lit(0).cast("long"), "id"))


NEAR_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.good AND b.good AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS top FROM v UNION SELECT r.node, l.v FROM r JOIN l ON r.top = l.u),
c AS (SELECT node, min(top) AS component_id FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.node LEFT JOIN n ON v.vec_id = n.u
"""
