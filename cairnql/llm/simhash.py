"""SimHash near-duplicate detection with deletion-variant signatures.

Fingerprints of 64 bits link when they differ in at most three.  Cut in two segments, one
segment of a linked pair differs in one bit at most; so each fingerprint is indexed under
every one-wildcard variant of either segment, an equality join brings candidates together
and each is verified.  A variant that more than ``GROUP`` distinct fingerprints share is
never compared as one group: the same cut is applied to the segment not yet used (32, then
16 bits), and after the third cut a variant leaves 11 free bits, so 2,048 fingerprints at
most.  No bucket is dropped or capped.

Null and empty texts have fingerprint 0.  Very long texts are read whole, their words in
lists of bounded length.  Equal texts are one fingerprint, compared once; repeated rows give
one row each; of several smallest ids the smallest is the component.  An empty table gives
no rows.  Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, save, slices, small_side, unused

GROUP = 2048
BITS = 3
#: Variants that one task makes.
MADE = 500_000
CHUNK = 1 << 16
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in lists of bounded length; each later list repeats the last two words."""
    if len(text) < 1 << 22:
        yield text.lower().split()
        return
    words: list[bytes] = []
    for m in WORD.finditer(text):
        words.append(m[0].lower())
        if len(words) == CHUNK:
            yield words
            words = words[-2:]
    if words:
        yield words


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a UTF-8 text over its 3-word shingles (repeats count).

    A-Z is lower-cased; words are runs without ASCII white space; a text of one or two words
    is one shingle; null or no word gives 0.  A bit is 1 if set in over half of the XXH64s.
    """
    if not text:
        return 0
    counts, total, h = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    for words in _word_lists(text):
        if not words:
            continue
        if len(words) < 3:
            if total:
                continue
            hashes = [h(b" ".join(words), 42)]
        else:
            hashes = [h(b" ".join(t), 42) for t in zip(words, words[1:], words[2:])]
        for i in range(0, len(hashes), CHUNK):
            a = np.array(hashes[i : i + CHUNK], np.uint64).view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(a, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the signed long that holds the 64 bits, for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "simhash"):
            fps = np.array([fingerprint(x) for x in b.column(1).cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether longs differ in ``BITS`` bits at most; counted unsigned, as numpy counts the bits of absolute values."""
    return np.bitwise_count((x ^ y).view(np.uint64)) <= BITS


def _stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of up to ``GROUP`` distinct fingerprints: (member, smallest member)."""
    n = len(fps)
    near = np.zeros((n, n), bool)
    for i in range(0, n, 256):
        near[i : i + 256] = _near(fps[i : i + 256, None], fps[None, :])
    label = np.arange(n)
    while True:
        low = np.where(near, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(n)
    return fps[moved], fps[label[moved]]


def _compare(groups: DataFrame) -> DataFrame:
    """Verified spanning links (u, v) within each row's array ``fps``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            sizes = col.value_lengths().to_numpy(zero_copy_only=False)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            two = starts[sizes == 2]
            x, y = flat[two], flat[two + 1]
            ok = _near(x, y)
            us, vs = [x[ok]], [y[ok]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                u, v = _stars(flat[s : s + n])
                us.append(u)
                vs.append(v)
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return groups.mapInArrow(run, "u long, v long")


def _variants(df: DataFrame, width: int) -> DataFrame:
    """One-wildcard variants of the two halves of the ``2 * width`` bits of ``rest``.

    Adds the variant ``key`` and leaves in ``rest`` the half that was not used for it."""
    mask = (1 << width) - 1
    one = F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("w")
    high = f"shiftright(rest, {width}) & {mask}L"
    low = f"rest & {mask}L"
    return df.select("fp", "key", "rest", one).selectExpr(
        "fp",
        f"xxhash64(key, w, (CASE WHEN w < {width} THEN {low} ELSE {high} END) & ~shiftleft(1L, w % {width})) AS key",
        f"CASE WHEN w < {width} THEN {high} ELSE {low} END AS rest",
    )


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (u, v) whose transitive closure is that of all pairs of ``fp`` within three bits.

    ``distinct`` holds distinct longs ``fp``.  Each variant of more than one fingerprint is
    compared as a whole while it has at most ``group`` members, or else is cut again.  Only
    the variants' keys are shuffled, to be counted; their fingerprints are shuffled if the
    keys that occur again are too many to broadcast.  Fingerprints are dealt to as many tasks
    as their variants need.
    """
    found: list[DataFrame] = []
    level = save(distinct.selectExpr("fp", "0L AS key", "fp AS rest"))
    for width in (32, 16, 8):
        tasks = -(-level.count() * 2 * width // MADE)
        every = _variants(level.repartition(max(1, tasks), "fp"), width)
        shared = save(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        met = save(every.join(small_side(shared), "key"))
        small = met if width == 8 else met.where(F.col("n") <= group)
        found.append(_compare(small.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")))
        level = met.where(F.col("n") > group).select("fp", "key", "rest")
        if width == 8 or level.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per input row: (id, fp, component), ``component`` the smallest id of the group.

    Equal fingerprints are one node; so copies never meet as pairs.  Null or empty texts have
    fingerprint 0 and link like any other.  Repeated ids give one row each; null ids never
    become a component unless a group has no other.  An empty table gives no rows.
    """
    fp = save(fingerprints(docs, id_col, text_col))
    nodes = fp.groupBy("fp").agg(F.min("id").alias("first"))
    comp = connected_components(links(nodes.select("fp"), group)).withColumnRenamed("node", "fp")
    placed = save(nodes.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")))
    least = save(placed.groupBy("comp").agg(F.min("first").alias("component")))
    known = placed.join(small_side(least), "comp").select("fp", "component")
    return fp.join(known, "fp", "left").select("id", "fp", "component")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is that of their group; all columns stay.

    Of repeated rows with that id one stays, the one of the least text.  Rows with a null id
    cannot be told apart and all stay.  Texts are shuffled only if the ids to drop are too
    many to broadcast.
    """
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    ids = found.groupBy("id").agg(F.max(F.col("id") == F.col("component")).alias("stays"), F.count(F.lit(1)).alias("n"))
    odd = save(ids.where("n > 1 OR NOT stays"))
    key, place = unused(docs.columns, "_key"), unused(docs.columns, "_place")
    few = odd.count()
    plain = docs.join(small_side(odd.select(F.col("id").alias(key)), few), docs[id_col] == F.col(key), "left_anti")
    again = odd.where("stays").select(F.col("id").alias(key))
    if again.isEmpty():
        return plain
    twice = docs.join(small_side(again, few), docs[id_col] == F.col(key), "left_semi")
    first = Window.partitionBy(docs[id_col]).orderBy(docs[text_col], F.xxhash64(F.to_json(F.struct(*[docs[c] for c in docs.columns]))))
    return plain.union(twice.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place))
