"""Base patterns against the plain expressions, disclosure against a count in Python."""

import hashlib
import math
import re
import time

import pytest
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnql.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


PIECES = ["a@b.c", "@", "a", ".", "-", "+", "1", "25", "256", "4", "(", ")", " ", "  ", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "+44 20 7946", "é", "٣", "x@y", "..", "%", "\n", "_", "0255"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_of_long_runs():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 50_000, "a@b." * 50_000, "1 " * 100_000):
        assert pii.base_spans(text) == brute_spans(text) if len(text) < 20_000 or text[0] not in "a1" else pii.base_spans(text) is not None
    assert pii.base_spans(None) == [] == pii.base_spans("")


def brute_disclosure(texts, threshold, windows):
    """{term: share} by counting documents one by one."""
    near, near_docs, having, entity_docs = {}, {}, {}, {}
    for i, t in enumerate(texts):
        if t is None:
            continue
        for w in {m[0].lower() for m in re.finditer(r"[^\W_]{3,}", t)}:
            having.setdefault(w, set()).add(i)
        spans = pii.base_spans(t)
        first = {}
        for c, w, ts in pii.neighbours(t, spans):
            for x in {"", *ts}:
                first.setdefault((c, x), w)
        for pair, w in first.items():
            near.setdefault(pair, set()).add(w)
            near_docs.setdefault(pair, set()).add(i)
    n, out = len(texts), {}
    for (c, t), ws in near.items():
        nc = len(near_docs[c, ""])
        if t and len(ws) >= windows and nc < n:
            pmi = math.log(len(near_docs[c, t]) * n / (nc * len(having[t])))
            share = pmi / math.log(n / nc)
            if share >= threshold:
                out[t] = max(share, out.get(t, -9))
    return out


def corpus():
    rows = [prose(i, 40) for i in range(60)]
    rows += [f"{prose(i, 12)} Zaphod{'' if i % 2 else 'X'[:0]} of Trillium wrote from zb@example.org about {prose(i + 90, 15)}" for i in range(6)]
    rows += [f"{prose(i + 30, 9)} the sea at +44 20 7946 0958 {prose(i + 70, 9)}" for i in range(5)]
    rows += ["copy of Marvelous by mm@example.org here"] * 50  # one surrounding, however often
    return rows + [None, "", "Zaphod alone"]


def test_disclosure_against_plain_counts(spark):
    texts = corpus()
    d = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["term"]: r["share"] for r in pii.disclosure(d, threshold=0.5).collect()}
    want = brute_disclosure(texts, 0.5, 3)
    assert set(got) == set(want) and all(got[t] == pytest.approx(want[t]) for t in got)
    assert {"zaphod", "trillium"} <= set(got) and not {"sea", "the", "marvelous"} & set(got)


def test_entities_seen_once_or_twice(spark):
    texts = [prose(i, 40) for i in range(60)]
    texts += [f"{prose(i, 5)} case {i} at u{i}@example.org {prose(i + 20, 5)}" for i in range(30)]
    texts += [f"{prose(i + 7, 9)} Zaphod by zb@example.org {prose(i + 90, 9)}" for i in range(2)]
    texts += [" ".join(f"{prose(50 + i, 9)} Trillium by tm@example.org {prose(80 + i, 9)}" for i in range(9))]
    d = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["term"]: r["share"] for r in pii.disclosure(d).collect()}
    assert got["zaphod"] == pytest.approx(1) == got["trillium"] and not {"sea", "the", "case"} & set(got)


def test_chance_against_all_draws():
    for n, c, t in [(9, 4, 3), (12, 1, 1), (12, 6, 6), (10, 8, 7), (7, 7, 3)]:
        for k in range(max(0, c + t - n), min(c, t) + 1):
            want = sum(math.comb(c, x) * math.comb(n - c, t - x) for x in range(k, min(c, t) + 1)) / math.comb(n, t)
            assert pii.chance(k, c, t, n) == pytest.approx(want if k * n > c * t else 1.0)


def test_neighbours_are_words_however_long():
    text = f"Marvin {'x' * 600} a@b.org {'y' * 600} Trillium c@d.org"
    assert all({"marvin", "trillium"} <= ts for _, _, ts in pii.neighbours(text, pii.base_spans(text)))


def slow_neighbours(text, spans, window):
    """Word by word from each span outwards."""
    covered = [any(a <= i < b for _, a, b in spans) for i in range(len(text))]
    for kind, a, b in spans:
        near = set()
        for start, step in ((a - 1, -1), (b, 1)):
            i, words = start, 0
            while 0 <= i < len(text) and words < window:
                if text[i].isspace():
                    i += step
                    continue
                j = i
                while 0 <= j < len(text) and not text[j].isspace():
                    j += step
                x, y = (j + 1, i + 1) if step < 0 else (i, j)
                if not any(covered[x:y]):
                    words += 1
                    near |= {t for t, _, _ in pii.terms(text[x:y])}
                i = j
        yield pii.entity(text, (kind, a, b)), near


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", " ", "\n", "the sea", "Marvin", "x@y.org", "a@b.cd", "10.0.0.1", "+44 20 7946 0018", "(", ")", ",", "ab1", "zz" * 40]), max_size=40).map("".join))
def test_neighbours_against_a_walk(text):
    spans = pii.base_spans(text)
    got = [(c, ts) for c, _, ts in pii.neighbours(text, spans, 3)]
    assert got == list(slow_neighbours(text, spans, 3))


def test_long_texts_take_time_in_proportion():
    def took(n):
        words = [f"word{i % 997}" for i in range(12 * n)]
        words[::12] = [f"user{i}@mail{i % 77}.example" for i in range(n)]
        text = " ".join(words)
        start = time.process_time()
        spans = pii.base_spans(text)
        assert len(spans) == n == sum(1 for _ in pii.neighbours(text, spans))
        marked, clean = pii._mark(text, {f"word{i}": False for i in range(0, 997, 2)})
        assert len(marked) > 5 * n and "@" not in clean
        return time.process_time() - start

    assert took(20_000) < 20 * max(0.2, took(2_000))


@pytest.mark.parametrize("held", [True, False])
def test_sanitised_texts(spark, monkeypatch, held):
    if not held:
        monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    texts = corpus()
    d = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)], clash=True)
    out = pii.sanitise(d, threshold=0.5, remove=0.97).collect()
    shares = brute_disclosure(texts, 0.5, 3)
    assert len(out) == len(texts) and {r["key"] for r in out} == {"own key"}
    for r in out:
        t = texts[r["doc_id"]]
        spans = [(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]]
        base = brute_spans(t)
        assert spans[: len(base)] == base
        terms = [] if t is None else [m.span() for m in re.finditer(r"[^\W_]{3,}", t) if m[0].lower() in shares and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert spans[len(base) :] == [("term", *x) for x in terms]
        if t is None:
            assert r["pii_text"] is None
            continue
        assert "@" not in r["pii_text"] and "zaphod" not in r["pii_text"].lower()
        if not spans:
            assert r["pii_text"] == t
    marked = next(r["pii_text"] for r in out if r["doc_id"] == 60)
    assert "[EMAIL]" in marked


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op9_pii(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    for r in out:
        base = brute_spans(docs[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(k == x[0] for x in base) for k in PATTERNS]
        assert r["spans"] == joined or r["spans"].startswith(joined) and ":".join(r["spans"][len(joined) :].lstrip(",").split(":")[:1]) == "term"
