"""Lexicon matching, and accuracy on labels that were not learned from."""

import math
import os
import time
import unicodedata
from pathlib import Path

import pytest
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnql.llm import queries, toxicity
from cairnql.llm.toxicity import Lexicon, fold, hits, measures, probability

LARGER = Path("/root/testdata/sf0.1")


def test_folding():
    assert fold(None) == "  " and fold("") == "  "
    assert fold("idiot") == fold("іdіоt") == fold("ｉｄｉｏｔ") == fold("id\u200biot") == fold("i\u0336diot") == " idiot "
    assert fold("1d10t") == " idiot ldlot " and fold("101 4") == " 101 4 "
    assert fold("$hame sh@me") == " hame shame "
    assert fold("a\tb\n c") == " a b c "
    assert fold("b@d w0rd5") == " bad words "
    assert fold("re\u0301el") == fold("réel") != fold("reel")


def lexicon(**weights):
    return Lexicon({fold(k) if not k.endswith("_") else f" {fold(k[:-1]).strip()}": w for k, w in weights.items()})


def test_hits_are_whole_words_or_beginnings():
    lx = lexicon(vile=2.0, grub_=1.5)
    a = lx.automaton()
    found = lambda t: sorted(w for _, _, w in hits(fold(t), a))
    assert found("a v1le thing") == [2.0]
    assert found("evile servile vilest") == []
    assert found("grubby GRUBS, ungrub") == [1.5, 1.5] and found("grub") == []
    assert found("") == []
    assert hits(fold("vile"), Lexicon({}).automaton()) == []


def test_exceptions_spare_their_own_words_only():
    lx = lexicon(vile=2.0)
    lx.exceptions = [fold("vile weather")]
    a = lx.automaton()
    assert hits(fold("such vile weather"), a) == []
    assert len(hits(fold("such vile weather and a vile man"), a)) == 1


def test_longer_texts_dilute():
    lx = lexicon(vile=2.0)
    a = lx.automaton()
    short, long = (measures(t, a) for t in ("a vile man", "a vile man " + prose(1, 500)))
    assert short[0] == long[0] and short[1] > long[1]
    assert probability(short, (-3.0, 1.0, 0.5)) > probability(long, (-3.0, 1.0, 0.5)) > probability(measures("", a), (-3.0, 1.0, 0.5))


def test_learning_ignores_copies_and_finds_disguises(spark):
    bad = ["grimlok", "snarvish", "vorple"]
    rows = [(i, f"{prose(i, 30)} {bad[i % 3]} {prose(i + 500, 20)}", None, None) for i in range(120)]
    rows += [(1000 + i, prose(i + 900, 50), None, None) for i in range(240)]
    rows += [(2000 + i, f"{prose(7, 30)} harmless copies", None, None) for i in range(200)]  # one text, all toxic by label
    rows += [(3000 + i, f"{prose(i + 50, 30)} gr1ml0k {prose(i, 9)}", None, None) for i in range(5)] + [(4000, None, None, None), (4001, "", None, None)]
    d = documents(spark, rows)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000 or 2000 <= r[0] < 3000)) for r in rows if r[0] < 3000] + [(None, 1), (5, None)], "doc_id long, toxic int")
    lx = toxicity.learn(d, labels, F.col("doc_id") < 3000)
    assert lx.weights and not any("harmless" in w or "copies" in w for w in lx.weights)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(d, lx).collect()}
    assert all(got[i] > 0.5 for i in range(120)) and all(got[1000 + i] < 0.5 for i in range(240))
    assert all(got[3000 + i] > 0.5 for i in range(5)) and got[4000] == got[4001] < 0.5


def slow_fold(text):
    """Character by character, then word by word."""
    out = ""
    text = unicodedata.normalize("NFC", (text or "").lower())
    inside = lambda c: c.isalnum()
    for i, c in enumerate(text):
        if c in "@$!" and 0 < i < len(text) - 1 and inside(text[i - 1]) and inside(text[i + 1]):
            c = {"@": "a", "$": "s", "!": "i"}[c]
        got = toxicity.TABLE.get(ord(c), c)
        out += got or ""
    words, more = [], []
    for w in out.split():
        if w.isdigit() or not set(w) & set("0134578"):
            words.append(w)
            continue
        one, two = ("".join(dict(zip("0134578", to)).get(c, c) for c in w) for to in ("oieastb", "oleastb"))
        words.append(one)
        more += [two] * (two != one)
    return " " + " ".join([*words, *more]) + " " if words else "  "


def slow_score(text, lx):
    """Every entry looked for at every place."""
    folded = slow_fold(text)
    at = lambda x: [i for i in range(len(folded)) if folded.startswith(x, i)]
    best = {}
    for entry, w in lx.weights.items():
        for i in at(entry):
            whole = entry.endswith(" ")
            if whole or folded[i + len(entry)] != " ":
                if i not in best or w > best[i][1]:
                    best[i] = (i + len(entry), w)
    spared = [(i, i + len(p)) for p in lx.exceptions if p not in lx.weights for i in at(p)]
    found = sum(w for i, (end, w) in best.items() if not any(a <= i and end <= b for a, b in spared))
    x = math.log1p(found), math.log1p(100 * found / max(1, len(folded.split())))
    z = lx.calibration[0] + lx.calibration[1] * x[0] + lx.calibration[2] * x[1]
    return 1 / (1 + math.exp(-z))


TOKENS = ["vile", "v1le", "vıle", "VILE", "viler", "grub", "grubby", "grubs5", "weather", "man", "a", "101", "в1le", "ｖｉｌｅ", "b@d", "bad!", "re\u0301el", ",", "lo0l", "x4y5"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TOKENS), max_size=25), st.sampled_from([" ", "  ", "\n", ", "]))
def test_score_against_a_plain_search(words, gap):
    lx = lexicon(vile=2.0, vile_=1.2, grub_=1.5, bad=0.7)
    lx.weights[" réel "] = 0.5
    lx.exceptions = [" vile weather ", " a vile man ", " man vile man ", " bad "]
    text = gap.join(words)
    assert fold(text) == slow_fold(text)
    a = lx.automaton()
    assert probability(measures(text, a), lx.calibration) == pytest.approx(slow_score(text, lx))


def test_query_against_a_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    lx = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~held)
    got = {r["doc_id"]: r["score"] for r in queries.op5_toxicity(spark, sf).collect()}
    for r in docs.collect():
        if len(r["text"] or "") < 3000:
            assert got[r["doc_id"]] == pytest.approx(slow_score(r["text"], lx))


def test_learning_does_not_depend_on_how_rows_lie(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one, two = (toxicity.learn(docs.repartition(k), labels.repartition(9 - k), F.lit(True)) for k in (1, 7))
    assert one.weights and one == two


def test_many_exceptions_take_time_in_proportion():
    lx = lexicon(vile=2.0)
    lx.exceptions = [fold("vile weather")]
    a = lx.automaton()
    start = time.process_time()
    assert hits(fold("vile weather " * 100_000), a) == []
    assert time.process_time() - start < 10


def test_nothing_to_learn_from(spark):
    d = documents(spark, [(1, "text", None, None)])
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.learn(d, one, F.lit(True)).weights == {} == toxicity.learn(d, one.limit(0), F.lit(True)).weights


def area(scores, labels):
    """Probability that a toxic document scores above a clean one."""
    ranked = sorted(zip(scores, labels))
    out = below = ties = 0
    i = 0
    pos = sum(labels)
    neg = len(labels) - pos
    while i < len(ranked):
        j = i
        while j < len(ranked) and ranked[j][0] == ranked[i][0]:
            j += 1
        p = sum(y for _, y in ranked[i:j])
        out += p * (below + (j - i - p) / 2)
        below += j - i - p
        i = j
    return out / (pos * neg)


@pytest.mark.skipif(not LARGER.exists(), reason="needs the larger tables")
def test_held_out_labels(spark):
    sf = os.environ.get("TEST_LARGE_DIR", str(LARGER))
    out = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    y = [r["toxic"] for r in out]
    right = sum(r["predicted"] == r["toxic"] for r in out) / len(out)
    caught = sum(r["predicted"] for r in out if r["toxic"]) / sum(y)
    auc = area([r["score"] for r in out], y)
    print(f"held out {len(out)}, toxic {sum(y)}: accuracy {right:.4f}, recall {caught:.4f}, area {auc:.4f}")
    assert right >= 0.95 and caught >= 0.8 and auc >= 0.95


def test_query_scores_every_document(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = queries.op5_toxicity(spark, sf)
    assert out.count() == n and out.where("score IS NULL OR held_out IS NULL").isEmpty()
    assert out.where("held_out <> (crc32(encode(CAST(doc_id AS string), 'UTF-8')) % 5 = 0)").isEmpty()
