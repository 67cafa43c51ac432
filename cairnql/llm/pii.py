"""Personal data: base patterns, and information-theoretic sanitisation of revealing terms.

Emails, IP addresses, card and phone numbers are the protected entities.  From the whole
corpus it is counted how often a term stands near an entity and how often anywhere.  With
IC(c) = -log p(c) the information of an entity and PMI(c; t) = log p(c, t) / (p(c) p(t))
what a term tells about it, a term discloses the share PMI / IC of the entity.  Terms above
a threshold are generalised, and removed above a second one, wherever they occur.

Null texts have no spans and stay null; empty ones have none.  Very long texts are searched
whole, in time in proportion to their length.  Repeated rows are marked each and count each as
documents, but their surroundings as one piece of evidence.  Of overlapping spans one mark
stays.  An empty table gives an empty result.  All columns pass through but those named
``pii_spans`` and ``pii_text``.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, slices, unused

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Only the start of a run of digits can begin a match: later digits of it would meet the same end.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{3,}")
WORD = re.compile(r"\S+")
WINDOW = 8
#: A pair of entity and term counts if chance would bring it about no more often than this.
LEVEL = 0.05
BROADCAST_TERMS = 500_000
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Spans (kind, start, end) in code points, by kind and start; null is empty.

    Matches are leftmost and do not overlap within a kind; those that fail the test of their
    kind (parts over 255, Luhn, number of digits) go without a retry.
    """
    if not text:
        return []
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p) < 4 or not p[:-3].strip("0") for p in m[0].split(".")) and all(int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(text: str, span: Span) -> int:
    """Identity of what a base span names, as a signed long."""
    kind, a, b = span
    name = text[a:b].lower() if kind in ("email", "ip") else NOT_DIGIT.sub("", text[a:b])
    return xxhash.xxh64_intdigest(f"{kind}:{name}".encode("utf-8", "replace")) - (1 << 63)


def terms(text: str) -> Iterator[tuple[str, int, int]]:
    """Terms in lower case with their places: runs of three or more letters or digits."""
    for m in TERM.finditer(text):
        yield m[0].lower(), m.start(), m.end()


class Cover:
    """The stretches of a text that spans cover, joined where they meet; whether one meets a place is found by bisection."""

    def __init__(self, spans: Iterable[Span]):
        self.ends: list[tuple[int, int]] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a <= self.ends[-1][1]:
                self.ends[-1] = (self.ends[-1][0], max(self.ends[-1][1], b))
            else:
                self.ends.append((a, b))

    def bare(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.ends, (b,)) - 1
        return i < 0 or self.ends[i][1] <= a


def neighbours(text: str, spans: list[Span], window: int = WINDOW) -> Iterator[tuple[int, int, set[str]]]:
    """(entity, hash of the window, terms) for each base span: the words on either side that no span covers."""
    bare = Cover(spans).bare
    every = [m.span() for m in WORD.finditer(text)]
    words = [w for w in every if bare(*w)]
    starts = [a for a, _ in words]
    known: dict[tuple[int, int], tuple[str, set[str]]] = {}

    def word(w: tuple[int, int]) -> tuple[str, set[str]]:
        if w not in known:
            part = text[slice(*w)]
            known[w] = xxhash.xxh64_hexdigest(part.encode("utf-8", "replace")), {t for t, _, _ in terms(part)}
        return known[w]

    for span in spans:
        _, a, b = span
        before = words[max(0, bisect.bisect_left(starts, a) - window) : bisect.bisect_left(starts, a)]
        i = bisect.bisect_left(every, (a,)) - 1
        if i >= 0 and every[i][1] > a and bare(every[i][0], a):  # the word runs into the span
            before = [*before, (every[i][0], a)][-window:]
        at = bisect.bisect_left(starts, b)
        after = words[at : at + window]
        i = bisect.bisect_left(every, (b,)) - 1
        if i >= 0 and every[i][1] > b and bare(b, every[i][1]):
            after = [(b, every[i][1]), *after][:window]
        near = [word(w) for w in (*before, *after)]
        yield entity(text, span), xxhash.xxh64_intdigest(" ".join(h for h, _ in near)) - (1 << 63), set().union(*(t for _, t in near))


def chance(k: int, c: int, t: int, n: int) -> float:
    """Probability that of ``n`` surroundings, ``c`` of an entity and ``t`` with a term, ``k`` or more are both by chance."""
    if k * n <= c * t:
        return 1.0

    def choose(x: int, y: int) -> float:
        return math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)

    p = math.exp(choose(c, k) + choose(n - c, t - k) - choose(n, t))
    total = 0.0
    while p > 1e-12 * total:  # past the mean each term is smaller than the one before
        total += p
        p *= (c - k) * (t - k) / ((k + 1) * (n - c - t + k + 1))
        k += 1
    return min(1.0, total)


def disclosure(
    docs: DataFrame, *, threshold: float = 0.9, level: float = LEVEL, text_col: str = "text"
) -> DataFrame:
    """Rows (term, share) for terms that disclose at least ``threshold`` of some entity.

    Counts are of documents: with the entity, with the term near it, with the term anywhere.
    A pair counts, however seldom it was seen, if meeting so often by chance is no likelier
    than ``level`` (``chance``).  That test counts different surroundings of entities, all of
    a document's, so copies of one passage are one piece of evidence, however many there are.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "pii"):
            rows: list[tuple] = []
            for text in b.column(0).to_pylist():
                seen: set[tuple[int, str, int]] = set()
                met_here: set[tuple[int, str]] = set()
                spans = base_spans(text)
                for c, w, ts in neighbours(text, spans) if spans else ():
                    for t in {"", *ts}:
                        if (c, t, w) not in seen:
                            seen.add((c, t, w))
                            rows.append((c, t, w, int((c, t) not in met_here)))
                            met_here.add((c, t))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["c", "t", "w", "d"])

    met = texts.mapInArrow(near, "c long, t string, w long, d long")
    met = save(met.groupBy("c", "t", "w").agg(F.sum("d").alias("n")).groupBy("c", "t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("w")))
    pairs = met.where("t <> ''")
    wanted = save(pairs.select("t").distinct())
    few = wanted.count()
    if not few:
        return met.sparkSession.createDataFrame([], "term string, share double")
    known = frozenset(r[0] for r in wanted.collect()) if few <= BROADCAST_TERMS else None
    held = docs.sparkSession.sparkContext.broadcast(known)

    def anywhere(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = held.value, Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["t", "nt"])
            counts.clear()
            return b

        for b in slices(batches, "pii"):
            for text in b.column(0).to_pylist():
                own = {t for t, _, _ in terms(text)}
                counts.update(own if known is None else own & known)
                if len(counts) > 500_000:
                    yield out()
        yield out()

    df = texts.mapInArrow(anywhere, "t string, nt long").groupBy("t").agg(F.sum("nt").alias("nt"))
    n = docs.count()
    ent = met.where("t = ''").selectExpr("c", "n AS nc", "w AS wc")
    around = pairs.groupBy("t").agg(F.sum("w").alias("wt"))
    total = ent.agg(F.sum("wc")).first()[0]
    joint = pairs.join(ent, "c").join(df, "t").join(around, "t")
    pmi = F.log(F.col("n") * F.lit(float(n)) / (F.col("nc") * F.col("nt")))
    scored = joint.where(F.col("nc") < n).withColumn("share", pmi / F.log(F.lit(float(n)) / F.col("nc"))).where(F.col("share") >= threshold)

    def tested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, wc, wt = (b.column(i).to_pylist() for i in (2, 3, 4))
            yield b.select(["term", "share"]).filter(pa.array([chance(*x, total) <= level for x in zip(w, wc, wt)], pa.bool_()))

    kept = scored.select(F.col("t").alias("term"), "share", "w", "wc", "wt").mapInArrow(tested, "term string, share double")
    return save(kept.groupBy("term").agg(F.max("share").alias("share")))


def _mark(text: str | None, found: dict[str, bool]) -> tuple[list[Span], str | None]:
    """All spans of a text, and the text with them replaced; ``found`` tells of each flagged term whether it goes."""
    if text is None:
        return [], None
    base = base_spans(text)
    spans = list(base)
    if found:
        bare = Cover(base).bare
        spans += [("term", a, b) for t, a, b in terms(text) if t in found and bare(a, b)]
    parts: list[str] = []
    last, end = 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < end:  # overlaps the span before: one mark for both
            end = max(end, b)
            last = end
            continue
        parts += [text[last:a], f"[{kind.upper()}]" if kind != "term" or not found[text[a:b].lower()] else ""]
        last = end = b
    parts.append(text[last:])
    return spans, "".join(parts)


def sanitise(
    docs: DataFrame, *, threshold: float = 0.9, remove: float = 0.97, level: float = LEVEL, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with ``pii_spans`` (kind, start, end) and ``pii_text`` added.

    ``pii_text`` has base spans and terms of a share from ``threshold`` on replaced by their
    kind in brackets; terms from ``remove`` on are taken out.  Null texts have no spans and
    stay null.  Columns of these two names are replaced; all others pass through.
    """
    docs = docs.drop("pii_spans", "pii_text")
    flagged = disclosure(docs, threshold=threshold, level=level, text_col=text_col)
    spark = docs.sparkSession
    names = docs.columns
    at = names.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if flagged.count() <= BROADCAST_TERMS:
        held = spark.sparkContext.broadcast({r["term"]: r["share"] >= remove for r in flagged.collect()})
        rows = docs
    else:  # too many terms to broadcast: each text brings the flagged ones of its own
        def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "pii"):
                keys, ts = [], []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    mine = {t for t, _, _ in terms(text)}
                    keys += [key] * len(mine)
                    ts += mine
                if ts:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ts, pa.string())], ["_key", "term"])

        # equal texts are one key; AQE may split their rows, as each key has one row on the other side
        key = F.md5(F.encode(F.col(text_col), "UTF-8"))
        texts = docs.where(F.length(text_col) > 0).select(key.alias("key"), F.col(text_col).alias("text"))
        pairs = texts.groupBy("key").agg(F.any_value("text").alias("text")).mapInArrow(own, "key string, term string")
        flags = unused(names, "flags")
        mine = pairs.join(flagged, "term").groupBy("key").agg(F.collect_list(F.struct("term", (F.col("share") >= remove).alias("goes"))).alias(flags))
        held = None
        rows = docs.join(mine, key == mine["key"], "left").select(*[docs[f"`{c}`"] for c in names], mine[flags])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = held.value if held else {}
        for b in slices(batches, "pii"):
            spans, texts = [], []
            flags = b.column(b.num_columns - 1).to_pylist() if held is None else None
            for i, text in enumerate(b.column(at).to_pylist()):
                found = everywhere if flags is None else {f["term"]: f["goes"] for f in flags[i] or ()}
                s, clean = _mark(text, found)
                spans.append([{"kind": k, "start": x, "end": y} for k, x, y in s])
                texts.append(clean)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(spans, kind), pa.array(texts, pa.string())], [*names, "pii_spans", "pii_text"])

    return rows.mapInArrow(run, schema + ", pii_spans array<struct<kind:string,start:long,end:long>>, pii_text string")
