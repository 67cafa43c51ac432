"""Attribution of tokens to sections against a count token by token."""

import public_tokenizers
import pytest
from helpers import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnql.llm import queries, tokencount

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _halves():
    def halves(text):
        """Sections that cut words, with a gap."""
        n = len(text)
        return [("head", 0, n // 3), ("tail", min(n, n // 3 + 2), n)] if n > 3 else [("all", 0, n)]

    return halves


halves = _halves()  # sent to the workers by value


def brute(text, sections, rule):
    e = tokencount.encoder(RANKS).encoding
    ids = e.encode_ordinary(text)
    spans = [(len(text[:a].encode()), len(text[:b].encode())) for _, a, b in sections]
    counts, at = [0] * len(spans), 0
    for i in ids:
        end = at + len(e.decode_single_token_bytes(i))
        share = [max(0, min(b, end) - max(a, at)) for a, b in spans]
        touched = [k for k, s in enumerate(share) if s]
        if touched:
            k = touched[0] if rule == "first" else touched[-1] if rule == "last" else max(touched, key=lambda k: (share[k], -k))
            counts[k] += 1
        at = end
    return counts, len(ids)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abc de\n\n éß\U0001f600日本.,'1"), max_size=80), st.sampled_from(tokencount.RULES), st.sampled_from([tokencount.lines, halves]))
def test_against_token_by_token(text, rule, sections):
    import numpy as np

    found = sections(text)
    if not text or not found:
        return
    enc = tokencount.encoder(RANKS)
    where = tokencount.byte_starts(text, text.encode())
    spans = np.array([(a, b) for _, a, b in found])
    got = tokencount.attribute(enc.sizes[enc.ids(text)].cumsum(), spans if where is None else where[spans], rule)
    assert got.tolist() == brute(text, found, rule)[0]


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_documents(spark, rule):
    rows = [r for r in awkward() if r[0] is not None and r[0] < 30] + [(500, "<|endoftext|> a\n<|endoftext|>", None, None)]
    out = tokencount.token_counts(documents(spark, rows), RANKS, sections=halves, rule=rule).collect()
    texts = {r[0]: r[1] for r in rows}
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == set(texts)
    for i, parts in by.items():
        parts.sort(key=lambda r: r["section"])
        if not texts[i]:
            assert [(p["name"], p["tokens"], p["total"]) for p in parts] == [("empty", 0, 0)]
            continue
        counts, total = brute(texts[i], halves(texts[i]), rule)
        assert [p["tokens"] for p in parts] == counts and {p["total"] for p in parts} == {total}


def test_long_texts_encode_as_whole(monkeypatch):
    text = "word another thing, 12 days on\n" * 300 + "naïve 日本 text " * 50
    enc = tokencount.encoder(RANKS)
    whole = enc.encoding.encode_ordinary(text)
    monkeypatch.setattr(tokencount, "PIECE", 40)
    assert enc.ids(text).tolist() == whole


def test_lines_share_out_all_tokens(spark, sf):
    out = queries.op8_token_counts(spark, sf)
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.groupBy("doc_id").agg({"tokens": "sum", "total": "max"}).where("`sum(tokens)` <> `max(total)`").isEmpty()


def test_unknown_rules_are_refused(spark):
    with pytest.raises(ValueError):
        tokencount.token_counts(documents(spark, []), RANKS, rule="both")
