"""The network's gradients, whole-text reading and held-out accuracy."""

import math
import random

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from cairnql.llm import langid, queries


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], 5, 3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids = rng.integers(0, 4, (7, 6))
    y, mask = rng.integers(0, 3, 6), (rng.random((7, 6)) > 0.2).astype(np.float64)
    _, grad = net.gradients(ids, y, mask)
    for k, w in net.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) if i == 0 or k == "b" or not k.startswith("x") else rng.integers(0, 4) for i, n in enumerate(w.shape))
            old, e = w[at], 1e-2
            w[at] = old + e
            up = net.gradients(ids, y, mask)[0]
            w[at] = old - e
            down = net.gradients(ids, y, mask)[0]
            w[at] = old
            assert abs((up - down) / (2 * e) - grad[k][at]) < 2e-3, (k, at)


def test_directions_see_both_sides():
    net = langid.Network.fresh(["a", "b"], 4, 1)
    one, two = (np.frombuffer(x, np.uint8).reshape(-1, 1).copy() for x in (b"abcdefg", b"abcdefz"))
    assert not np.allclose(net.probabilities(one)[:, 0], net.probabilities(two)[:, 0])  # the last byte reaches the first position
    assert not np.allclose(net.probabilities(one)[:, -1], net.probabilities(np.array([[122], *one[1:].tolist()]))[:, -1])


def slow_probabilities(net, text):
    """Byte by byte with plain numbers: the two gated units, each begun ``CONTEXT`` bytes outside of the byte's stretch."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    w = {k: v.astype(float).tolist() for k, v in net.w.items()}

    def state(d, ids):
        x, u = w["x" + d], w["u" + d]
        n = len(u[0])
        h = [0.0] * n
        for c in ids:
            g = [sum(a * b for a, b in zip(row, h)) for row in u]
            z = [sigmoid(x[i][c] + g[i]) for i in range(n)]
            r = [sigmoid(x[n + i][c] + g[n + i]) for i in range(n)]
            new = [math.tanh(x[2 * n + i][c] + r[i] * g[2 * n + i]) for i in range(n)]
            h = [m + a * (b - m) for m, a, b in zip(new, z, h)]
        return h

    total = [0.0] * len(net.languages)
    for i in range(len(text)):
        o = i - i % langid.STRETCH
        before, end = min(o, langid.CONTEXT), o + langid.STRETCH + langid.CONTEXT
        seen = text[o - before : end].ljust(before + langid.STRETCH + langid.CONTEXT, b"\0")
        at = before + i - o
        left, right = state("0", seen[: at + 1]), state("1", seen[: at - 1 if at else None : -1])
        logit = [sum(a * b for a, b in zip(v0, left)) + sum(a * b for a, b in zip(v1, right)) + b[0] for v0, v1, b in zip(w["v0"], w["v1"], w["b"])]
        e = [math.exp(x) for x in logit]
        total = [t + x / sum(e) for t, x in zip(total, e)]
    return [t / len(text) for t in total]


def test_whole_texts_against_a_network_of_plain_numbers(monkeypatch):
    net = langid.Network.fresh(["a", "b", "c"], 4, 1)
    rng = np.random.default_rng(2)
    monkeypatch.setattr(langid, "AT_ONCE", 3)
    monkeypatch.setattr(langid, "STRETCH", 20)
    monkeypatch.setattr(langid, "CONTEXT", 6)
    texts = [bytes(rng.integers(97, 122, n).astype(np.uint8)) for n in (1, 5, 19, 20, 21, 26, 27, 333)]
    for text, p in zip(texts, langid.read(net, texts)):
        assert np.allclose(p, slow_probabilities(net, text), atol=1e-6)


def test_long_texts_are_read_to_their_end():
    net = langid.train([b"aaaa bbbb abab aabb"] * 4 + [b"xxxx yyyy xyxy yyxx"] * 4, ["one"] * 4 + ["two"] * 4, steps=40)
    text = b"abba " * 30_000 + b"yxxy " * 90_000
    p = langid.read(net, [text])[0]
    assert p[1] == pytest.approx(0.75, abs=0.05) and p.sum() == pytest.approx(1, abs=1e-5)


def test_every_language_is_learned(spark):
    """A hundred languages, of which ninety have a single document."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(4)] for k in range(100)}
    rows = [(len(own) * n + k, " ".join(rng.choice(words) for _ in range(60)), lang, None) for k, (lang, words) in enumerate(own.items()) for n in range(10 if k < 10 else 1)]
    d = documents(spark, rows)
    net = langid.fit(d, F.lit(True), steps=600)
    assert net.languages == sorted(own)
    got = [r["lang_pred"] == r["lang"] for r in langid.predict(d, net).collect() if r["lang"] >= "l10"]
    assert sum(got) > 60  # of ninety


def test_repeated_rows_are_learned_once(spark):
    rows = [(1, "wir gehen heute an das meer", "de", None)] * 3000 + [(i, f"we go to sea {i}", "en", None) for i in range(2, 9)]
    seen = []
    train = langid.train
    langid.train = lambda segments, labels, **_: seen.extend(labels) or train(segments, labels, steps=1)
    try:
        langid.fit(documents(spark, rows), F.lit(True))
    finally:
        langid.train = train
    assert seen.count("de") <= langid.SEGMENTS


def test_texts_without_letters(spark):
    rows = [(1, "wir gehen heute an das meer und baden", "de", None), (2, "we go to the sea and bathe there today", "en", None), (3, None, "en", None), (4, "12 ² ½ _ !", "en", None), (5, "1 ñ", None, None)]
    d = documents(spark, rows)
    out = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict(d, langid.fit(d, F.lit(True), steps=5)).collect()}
    assert out[3] == out[4] == ("und", 0.0)
    assert all(out[i][0] in ("de", "en") and 0 < out[i][1] <= 1 for i in (1, 2, 5))
    nothing = langid.predict(d, langid.fit(d, F.lit(False))).collect()
    assert {(r["lang_pred"], r["lang_score"]) for r in nothing} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = queries.op6_language(spark, sf).join(lang, "doc_id").collect()
    assert len(out) == lang.count() and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    right = sum(r["lang"] == r["lang_pred"] for r in held) / len(held)
    print(f"held out {len(held)}: accuracy {right:.4f}")
    assert right >= 0.95
