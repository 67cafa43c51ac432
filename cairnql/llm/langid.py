"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here in numpy by backpropagation through time on a bounded sample of
segments.  It reads whole texts, labels every byte position and averages the positions'
probabilities over the document.  Texts are read in stretches side by side; each direction
begins ``CONTEXT`` bytes outside of its stretch, so that labels near a border know what is
beyond it, and bytes that a stretch lacks at the text's end are read as zeros.

Null texts and texts without a letter are ``und`` with score 0.  Very long texts are read to
their end, in memory of a fixed number of stretches.  Repeated rows get a prediction each,
and count as one when the network learns.  A tie goes to the language that comes first in
code point order.  An empty table gives an empty result; without labelled rows everything is
``und``.  All columns pass through but those named ``lang_pred`` and ``lang_score``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, slices, small_side

LENGTH = 64  # bytes of a segment to learn from
STRETCH, CONTEXT = 128, 32  # bytes labelled at a time, and read beyond either end of them
HIDDEN = 8
#: Bounds of the training sample: documents of each language on average, segments of a document.  Every language is learned.
DOCUMENTS, SEGMENTS = 400, 4
STEPS, BATCH, RATE = 260, 192, 0.02
AT_ONCE, CELLS = 1024, 4 << 20  # stretches read at a time, and probabilities held for them
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Weights of both directions (0 reads forward, 1 backward) and of the output layer.

    In each direction, with gates z (update) and r (reset):
    n = tanh(W_n x + r * (U_n h)), h' = n + z * (h - n).
    """

    languages: list[str]
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng, out = np.random.default_rng(seed), len(languages)
        draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        w = {}
        for d in "01":
            w["x" + d] = draw(3 * hidden, 256, by=0.3)
            w["u" + d] = draw(3 * hidden, hidden, by=0.8 / np.sqrt(hidden))
            w["x" + d][:hidden] += 1.0  # gates begin mostly closed, so states last
            w["v" + d] = draw(out, hidden, by=0.5 / np.sqrt(hidden))
        w["b"] = np.zeros((out, 1), np.float32)
        return cls(languages, w)

    def run(self, ids: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, hidden, batch) of one direction over ids (time, batch)."""
        x, u = self.w["x" + d], self.w["u" + d]
        n_h, (steps, n) = u.shape[1], ids.shape
        states, cache = np.empty((steps, n_h, n), np.float32), []
        h = np.zeros((n_h, n), np.float32)
        for t in range(steps) if d == "0" else range(steps - 1, -1, -1):
            a, g = x.take(ids[t], axis=1), u @ h
            zr = a[: 2 * n_h]
            zr += g[: 2 * n_h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1.0
            zr *= 0.5
            z, r = zr[:n_h], zr[n_h:]
            un = g[2 * n_h :]
            m = np.tanh(a[2 * n_h :] + r * un)
            before, h = h, states[t]
            np.subtract(before, m, out=h)
            h *= z
            h += m
            if keep:
                cache.append((t, before, z, r, un, m))
        return states, cache

    def probabilities(self, ids: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Label probabilities (language, time, batch) of the positions from ``first`` to ``last`` of ids (time, batch)."""
        last = len(ids) if last is None else last
        out = np.empty((len(self.languages), last - first, ids.shape[1]), np.float32)
        flat = out.reshape(len(self.languages), -1)
        for d in "01":  # neither direction reads what lies behind the last position it labels
            s = self.run(ids[:last], d)[0][first:] if d == "0" else self.run(ids[first:], d)[0][: last - first]
            s = np.ascontiguousarray(s.transpose(1, 0, 2)).reshape(self.w["u" + d].shape[1], -1)
            if d == "0":
                np.matmul(self.w["v0"], s, out=flat)
            else:
                flat += self.w["v1"] @ s
        flat += self.w["b"]
        flat -= flat.max(axis=0)
        np.exp(flat, out=flat)
        flat /= flat.sum(axis=0)
        return out

    def gradients(self, ids: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the masked positions, and its gradients through time."""
        runs = {d: self.run(ids, d, keep=True) for d in "01"}
        logit = sum(np.einsum("oh,thn->otn", self.w["v" + d], runs[d][0]) for d in "01") + self.w["b"][:, :, None]
        logit -= logit.max(axis=0)
        p = np.exp(logit)
        p /= p.sum(axis=0)
        total = mask.sum()
        hit = np.arange(len(p))[:, None] == labels[None, :]
        loss = float(-(np.log((p * hit[:, None, :]).sum(axis=0) + 1e-9) * mask).sum() / total)
        dl = (p - hit[:, None, :]) * (mask / total)
        grad = {"b": dl.sum(axis=(1, 2))[:, None]}
        for d in "01":
            states, cache = runs[d]
            x, u, v = (self.w[k + d] for k in "xuv")
            n_h = u.shape[1]
            grad["v" + d] = np.einsum("otn,thn->oh", dl, states)
            gx, gu = np.zeros_like(x), np.zeros_like(u)
            carry = np.zeros_like(cache[0][1])
            one = np.empty((3 * n_h, ids.shape[1]), np.float32)
            deltas = np.empty((ids.shape[0], 3 * n_h, ids.shape[1]), np.float32)
            for t, before, z, r, un, m in reversed(cache):
                dh = carry + v.T @ dl[:, t]
                dz = dh * (before - m) * z * (1 - z)
                dm = dh * (1 - z) * (1 - m * m)
                dr = dm * un * r * (1 - r)
                one[:n_h], one[n_h : 2 * n_h], one[2 * n_h :] = dz, dr, dm * r
                gu += one @ before.T
                carry = dh * z + u.T @ one
                deltas[t, : 2 * n_h], deltas[t, 2 * n_h :] = one[: 2 * n_h], dm
            flat = deltas.transpose(1, 0, 2).reshape(3 * n_h, -1)
            for k in range(3 * n_h):
                gx[k] = np.bincount(ids.ravel(), flat[k], 256)
            grad["x" + d], grad["u" + d] = gx, gu
        return loss, grad


def train(
    segments: list[bytes], labels: list[str], *, hidden: int | None = None, steps: int | None = None, batch: int = BATCH, rate: float = RATE, seed: int = 1
) -> Network | None:
    """Fit a network to labelled segments with Adam; languages are drawn evenly.  None without segments.

    More than ``HIDDEN`` / 2 languages get two states each, up to eight times ``HIDDEN``, and
    more than eight a step for each of them, up to eight times ``STEPS``.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    hidden = hidden or max(HIDDEN, min(8 * HIDDEN, 2 * len(languages)))
    steps = steps or STEPS * max(1, min(8, len(languages) // 8))
    net = Network.fresh(languages, hidden, seed)
    if len(languages) == 1:
        return net
    rng = np.random.default_rng(seed)
    ids, mask = grid(segments)
    y = np.array([languages.index(x) for x in labels])
    own = [np.flatnonzero(y == k) for k in range(len(languages))]
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = np.array([rng.choice(own[k]) for k in rng.integers(0, len(own), batch)])
        _, grad = net.gradients(np.ascontiguousarray(ids[:, at]), y[at], mask[:, at].astype(np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.02 * (g * g - second[k])
            net.w[k] -= (speed * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return net


def grid(segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids (time, segment) padded with zeros, and which of them are real."""
    sizes = np.array([len(s) for s in segments])
    ids = np.frombuffer(b"".join(s.ljust(length, b"\0") for s in segments), np.uint8).reshape(-1, length).T
    return np.ascontiguousarray(ids), np.arange(length)[:, None] < sizes[None, :]


def read(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities (text, language) over all positions of each text, in double precision."""
    total = np.zeros((len(texts), len(net.languages)))
    at_once = max(16, min(AT_ONCE, CELLS // (STRETCH * len(net.languages))))
    # stretches that begin a text have nothing before them, all others the whole context
    held: dict[int, list[tuple[bytes, int, int]]] = {0: [], CONTEXT: []}

    def flush(before: int) -> None:
        parts, owner, sizes = zip(*held[before])
        ids, _ = grid(list(parts), before + STRETCH + CONTEXT)
        p = net.probabilities(ids, before, before + STRETCH)
        p *= np.arange(STRETCH)[:, None] < np.array(sizes)
        for k, sums in enumerate(p.sum(axis=1, dtype=np.float64)):
            total[:, k] += np.bincount(owner, sums, len(texts))
        held[before].clear()

    for n, text in enumerate(texts):
        for o in range(0, len(text), STRETCH):
            before = CONTEXT if o else 0
            held[before].append((text[o - before : o + STRETCH + CONTEXT], n, min(STRETCH, len(text) - o)))
            if len(held[before]) == at_once:
                flush(before)
    for before, left in held.items():
        if left:
            flush(before)
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def fit(docs: DataFrame, is_train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Network | None:
    """Train on a bounded sample of the rows of ``is_train``: see DOCUMENTS and SEGMENTS.

    A hash of the id and text chooses the documents, repeated rows as one, so reruns agree.
    Rows without a text or a language are never used.  Only segments of ``LENGTH`` bytes
    reach the driver, and a number for each language.
    """
    rows = docs.where(is_train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)).alias("h")
    )
    share = save(rows.groupBy("lang").agg((F.lit(float(DOCUMENTS << 40)) / F.count(F.lit(1))).alias("upto")))  # a row for each language
    chosen = rows.join(small_side(share), "lang").where("h < upto").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, out = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                if text:
                    last = max(0, len(text) - LENGTH)
                    for o in sorted({last * i // max(1, SEGMENTS - 1) for i in range(SEGMENTS)}):
                        langs.append(lang)
                        out.append(text[o : o + LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "segment"])

    sample = sorted((bytes(r["segment"]), r["lang"]) for r in chosen.mapInArrow(cut, "lang string, segment binary").collect())
    return train([s for s, _ in sample], [x for _, x in sample], **options)


def predict(docs: DataFrame, net: Network | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``lang_score`` added (columns of these names are replaced).

    Null texts and texts without a letter are ``und`` with score 0; so is everything if there
    was nothing to learn from.
    """
    docs = docs.drop("lang_pred", "lang_score")
    names = docs.columns
    at = names.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in slices(batches, "language"):
            texts = b.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if t and net and any(map(str.isalpha, t))]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                p = read(net, [texts[i].encode("utf-8", "replace") for i in known])
                for i, k, s in zip(known, p.argmax(axis=1), p.max(axis=1)):
                    lang[i], score[i] = net.languages[k], min(1.0, s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score)], [*names, "lang_pred", "lang_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema + ", lang_pred string, lang_score double")
