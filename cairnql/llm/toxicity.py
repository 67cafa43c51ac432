"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Texts are lower-cased and folded first: look-alike letters of other scripts, full-width
forms and digits that stand for letters become plain letters; accented letters stay letters
of their own, as languages tell words apart by them.  Lexicon entries are
whole words or beginnings of longer words, with log-odds learned from labelled documents; phrases
in which an entry is harmless are exceptions.  The weights found are normalised by the
length of the text and turned into a probability.

Null and empty texts have no hits and get the score of none.  Very long texts are folded and
matched whole, in time in proportion to their length; words of more than ``LONGEST`` letters
are matched by their beginnings only if a shorter word taught those.  Repeated rows get a
score each and teach as one; of rows with one id the least text teaches.  Ties (entries of
equal evidence, rows of equal hash) are settled by the entry or id itself, so reruns agree
however the rows are dealt out.  An empty table gives an empty result and an empty lexicon.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, slices

#: Bound of the learning sample: documents of each label.  It bounds the lexicon too, as entries must recur in them.
DOCUMENTS = 4000
STEMS = (4, 5, 6, 7, 8)
#: Least log-odds of an entry.
ODDS = 1.0
LONGEST = 24

LOOKALIKE = dict(zip("авеѕіјкмнорстухһԁԛԝɡαβεικνορτυχωıℓ", "abesijkmhopctyxhdqwgabeiknoptuxwil"))
#: Letters that a digit may stand for; a word with one of several meanings is read in every way.
DIGITS = (str.maketrans("0134578", "oieastb"), str.maketrans("0134578", "oleastb"))


def _fold_table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for c in [*range(0xA0, 0xC0), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKC", chr(c)).lower()
        out[c] = base if base.isalnum() else " "
    out |= {ord(a): b for a, b in LOOKALIKE.items()}
    out |= {c: " " for c in range(128) if not chr(c).isalnum()}
    return out | {c: None for c in [*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]}


TABLE = _fold_table()
SYMBOL = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")
DIGIT = re.compile("[0134578]")


def fold(text: str | None) -> str:
    """Folded text with single spaces between words and one at either end; null is empty.

    Further readings of words with digits follow at the end."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "$" in text or "@" in text or "!" in text:
        text = SYMBOL.sub(lambda m: {"@": "a", "$": "s", "!": "i"}[m[0]], text)
    text = " ".join(text.translate(TABLE).split())
    parts: list[str] = []
    more: list[str] = []
    done, digit = 0, DIGIT.search(text)
    while digit:
        start = text.rfind(" ", done, digit.start()) + 1 or done
        end = text.find(" ", digit.start()) + 1 or len(text) + 1
        word = text[start : end - 1]
        read, other = (word,) * 2 if word.isdigit() else (word.translate(t) for t in DIGITS)
        parts += [text[done:start], read]
        more += [other] * (other != read)
        done = end - 1
        digit = DIGIT.search(text, done)
    parts.append(text[done:])
    return " ".join(["", "".join(parts), *more, ""])


def features(text: str) -> set[str]:
    """Candidate entries of a folded text: words as " word " and beginnings of longer words as " stem"."""
    out: set[str] = set()
    for w in set(text.split()):
        if 3 <= len(w) <= LONGEST:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in STEMS if len(w) > n)
    return out


@dataclass
class Lexicon:
    """Entries and exception phrases (all folded) with the calibration of the score."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    calibration: tuple[float, float, float] = (-3.0, 1.0, 0.5)

    def automaton(self):
        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                a.add_word(phrase, (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a


def hits(text: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries in a folded text that no exception phrase covers.

    Of entries that begin at the same word the heaviest counts."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    spared: dict[int, int] = {}  # end of the longest phrase from each start
    for end, (size, w) in automaton.iter(text):
        start = end - size + 1
        if w is None:
            spared[start] = max(end, spared.get(start, -1))
        elif text[end] != " " and text[end + 1] == " ":
            continue  # a word that is the stem and no more
        elif start not in best or w > best[start][1]:
            best[start] = (end, w)
    starts, reach, far = sorted(spared), [], -1
    for a in starts:  # how far the phrases reach that begin there or before
        far = max(far, spared[a])
        reach.append(far)
    return [(s, e, w) for s, (e, w) in best.items() if not (i := bisect.bisect_right(starts, s)) or reach[i - 1] < e]


def measures(text: str | None, automaton) -> tuple[float, float]:
    """(log of 1 + the weights found, log of 1 + the weights per hundred words)."""
    folded = fold(text)
    found = sum(w for _, _, w in hits(folded, automaton))
    return math.log1p(found), math.log1p(100 * found / max(1, folded.count(" ") - 1))


def probability(x: tuple[float, float], calibration: tuple[float, float, float]) -> float:
    z = calibration[0] + calibration[1] * x[0] + calibration[2] * x[1]
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _evidence(a: Column, b: Column, na: float, nb: float) -> Column:
    """Twice the log-likelihood ratio of presence in a of na against b of nb documents."""
    p = (a + b) / F.lit(na + nb)

    def part(k: Column, n: float) -> Column:
        own = k / F.lit(n)
        yes = F.when(k > 0, k * F.log(own / p)).otherwise(0.0)
        no = F.when(k < n, (F.lit(n) - k) * F.log((1 - own) / (1 - p))).otherwise(0.0)
        return yes + no

    return F.when(p < 1, 2 * (part(a, na) + part(b, nb))).otherwise(0.0)


def _counted(sample: DataFrame, of) -> DataFrame:
    """(f, a, b): toxic and clean documents that hold each feature; tasks add up before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = [*counts[0].keys() | counts[1].keys()]
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["f", "a", "b"])
            for c in counts:
                c.clear()
            return b

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[y].update(of(fold(text)))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield out()
        yield out()

    return sample.mapInArrow(run, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """The sample without near copies, whose shared words are not independent evidence.

    Rows that share the smallest of their shingles' hashes under any of three seeds count as copies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh64_intdigest
        for b in batches:
            keys: list[list[int]] = [[], [], []]
            for text in b.column(0).to_pylist():
                w = text.encode("utf-8", "replace").split()
                shingles = {b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
                for seed, out in enumerate(keys):
                    out.append(min(h(x, seed) for x in shingles) - (1 << 63))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(k, pa.int64()) for k in keys)], ["text", "_y", "k0", "k1", "k2"])

    keyed = sample.mapInArrow(run, "text string, _y int, k0 long, k1 long, k2 long")
    for k in ("k0", "k1", "k2"):
        least = F.min(F.struct("k0", "k1", "k2", "_y", "text")).alias("r")  # whichever row comes first
        keyed = keyed.groupBy(F.col(k).alias("_k")).agg(least).select("r.*")
    return keyed.select("text", "_y")


def _compact(entries: list[tuple[str, float, int]]) -> dict[str, float]:
    """Drop an entry that a shorter stem already covers with about the same weight."""
    kept: dict[str, float] = {}
    for f, w, _ in sorted(entries, key=lambda e: (len(e[0]), e[0])):
        stems = [kept[s] for n in STEMS if len(s := f[: n + 1]) < len(f.rstrip()) and s in kept]
        if not stems or w > max(stems) + 1.0:
            kept[f] = w
    return kept


def learn(docs: DataFrame, labels: DataFrame, is_train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learn a lexicon, its exceptions and calibration from labelled rows of ``is_train``.

    Of each label the ``DOCUMENTS`` documents with the least hashes of their ids are used.  An
    entry must be more frequent in toxic documents than chance could make any of all
    candidates.  Null texts, ids and labels are not used; ids labelled twice take the larger
    label.  Without labels the lexicon is empty.
    """
    y = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    rows = docs.where(is_train & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # labels of documents that are there, one row an id; only ids are shuffled
    labelled = save(y.where("_y IN (0, 1)").join(rows.select("_id").distinct(), "_id").withColumn("h", F.xxhash64("_id")))
    n = {r[0]: r[1] for r in labelled.groupBy("_y").count().collect()}
    if len(n) < 2:
        return Lexicon({})
    few = [labelled.where(F.col("_y") == label).orderBy("h", "_id").limit(DOCUMENTS) for label in (0, 1)]
    chosen = few[0].union(few[1]).select("_id", "_y")  # 2 * DOCUMENTS rows of two numbers at most, whatever the tables
    texts = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("text").alias("text"))
    sample = save(_one_of_copies(texts.select("text", "_y")))
    all_n, n = n, {r[0]: r[1] for r in sample.groupBy("_y").count().collect()}
    if len(n) < 2:
        return Lexicon({})
    na, nb = float(n[1]), float(n[0])

    counted = _counted(sample, features)
    stats = counted.where("a >= 3").withColumn("g", _evidence(F.col("a"), F.col("b"), na, nb))
    odds = F.log((F.col("a") + 0.5) / (na + 1)) - F.log((F.col("b") + 0.5) / (nb + 1))
    many = counted.where("a + b >= 3").count()
    bar = 2 * math.log(max(2, many))
    top = stats.where((odds > ODDS) & (F.col("g") > bar)).select("f", odds.alias("w"), "a")
    lexicon = Lexicon(_compact([tuple(r) for r in top.collect()]))

    def around(text: str) -> set[str]:
        out = set()
        for s, _, _ in hits(text, matcher.get()):
            end = text.index(" ", s + 1)
            before, after = text.rfind(" ", 0, s) if s else -1, text.find(" ", end + 1)
            if s and before >= 0:
                out.add(text[before : end + 1])
            if after > 0:
                out.add(text[s : after + 1])
        return out

    matcher = _Matcher(lexicon)
    ph = _counted(sample, around).where("b >= 3").withColumn("g", _evidence(F.col("a"), F.col("b"), na, nb))
    ph = ph.where((F.col("b") / nb > 2 * F.col("a") / na) & (F.col("g") > bar))
    lexicon.exceptions = sorted(r["f"] for r in ph.select("f").collect())
    matcher = _Matcher(lexicon)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [measures(t, matcher.get()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in m], pa.float64()), pa.array([x for _, x in m], pa.float64()), b.column(1)], ["x", "d", "y"])

    points = sorted(tuple(r) for r in sample.mapInArrow(measured, "x double, d double, y int").collect())
    lexicon.calibration = _logistic(np.array(points), np.array([all_n[0] / n[0], all_n[1] / n[1]]))
    return lexicon


class _Matcher:
    """A lexicon whose automaton each worker builds once."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self._built = lexicon, None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "_built": None}

    def get(self):
        if self._built is None:
            self._built = self.lexicon.automaton()
        return self._built


def _logistic(t: np.ndarray, per_label: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small ridge; each row weighs as many documents as it stands for."""
    x, y = np.column_stack([np.ones(len(t)), t[:, :2]]), t[:, 2]
    weight = per_label[y.astype(int)]
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``toxicity`` (0 to 1) added; null and empty texts have no hits.

    A column of that name is replaced; all others pass through.
    """
    docs = docs.drop("toxicity")
    names = docs.columns
    at = names.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(_Matcher(lexicon))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = held.value
        a, c = matcher.get(), matcher.lexicon.calibration
        for b in slices(batches, "toxicity"):
            p = [probability(measures(t, a), c) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*names, "toxicity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema + ", toxicity double")
