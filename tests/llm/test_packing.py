"""Ids against the tokenizer, packings against exhaustive search."""

import random
import subprocess
import sys
import zlib
from functools import cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnql.llm import packing, queries

BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcXYZ'’ .,!é0123\n\t-ſßİΣςǆ<|>")), max_size=60))
def test_words_encode_as_whole_texts(text):
    t = packing.word_ids(BPE)
    assert t.text(text.encode()) == ids_of(_tok(), text)[:-1].tobytes()


@cache
def _tok():
    return Tokenizer.from_file(BPE)


def test_special_strings_and_pieces(spark, tokenizer):
    rows = awkward() + [(300, "<|startoftext|> a <|endoftext|> b", None, None)]
    out = packing.pieces(documents(spark, rows), BPE, with_ids=True).where("id IS NOT NULL").dropDuplicates(["id", "piece"]).collect()
    by = {}
    for r in out:
        by.setdefault(r["id"], {})[r["piece"]] = r
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    assert set(by) == set(texts)
    for i, pieces in by.items():
        whole = ids_of(tokenizer, texts[i])
        ordered = [pieces[k] for k in range(len(pieces))]
        assert np.array_equal(np.concatenate([np.array(p["ids"]) for p in ordered]), whole)
        for k, p in enumerate(ordered):
            part = whole[p["start"] : p["start"] + p["length"]]
            assert p["start"] == 2048 * k and p["crc"] == zlib.crc32(part.tobytes())
            assert p["length"] == 2048 or k == len(ordered) - 1


@pytest.mark.parametrize("letters", ["aab", "thequickbrownfox", "漢字かなカナ한국어éÀßς", "ab'stdrevlm!.,", "a1b2'c", "''!s", "áe\u0301\u0300x", "각\u1100\u1161\u11a8", "🙂👍🏽a", "İIıſ\u00a0\u3000x"])
def test_long_words_encode_as_in_one_piece(tokenizer, letters, monkeypatch):
    r = random.Random(letters)
    words = packing.word_ids(BPE)
    for stretch in (40, 300):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        for n in (1, 90, 4000):
            text = "".join(r.choice(letters) for _ in range(n)) + r.choice(["", "<|endoftext|>", "<|endoftext|>x"])
            assert b"".join(words._long(text)) == ids_of(tokenizer, text)[:-1].tobytes()


def test_a_word_of_megabytes_takes_little_memory():
    run = "import resource, sys; from cairnql.llm.packing import WordIds; w = WordIds(sys.argv[1]); n = len(w.text(b'ab' * (4 << 20))); print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)"
    out = subprocess.run([sys.executable, "-c", run, BPE], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    n, mb = map(int, out.stdout.split())
    assert n and mb < 300


@pytest.mark.parametrize("counts", [{1: 999}, {1: 5000}, {2: 5000}, {1: 5000, 2: 100, 3: 50}, {1: 10**6}, {2: 10**6}, {3: 10**6, 5: 1, 2047: 9}])
def test_many_short_pieces(counts):
    assert check_packing(counts, 2048, packing.bin_completion(counts)) <= packing.lower_bound(counts, 2048) + 2


@pytest.mark.parametrize("text", [None, "", "a"])
def test_tables_of_only_short_texts(spark, text):
    rows = packing.pack(packing.pieces(documents(spark, [(i, text, None, None) for i in range(1500)]), BPE)).collect()
    length = 2 if text else 1
    assert len(rows) == 1500 and {r["length"] for r in rows} == {length}
    assert len({r["sequence_id"] for r in rows}) == -(-1500 * length // 2048)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 1500


def check_packing(counts, capacity, fillings):
    used = {}
    for f, n in fillings:
        assert n > 0 and sum(f) <= capacity and f
        for s in f:
            used[s] = used.get(s, 0) + n
    assert used == {s: n for s, n in counts.items() if n}
    return sum(n for _, n in fillings)


def least_bins(sizes, capacity):
    """Fewest bins by exhaustive search."""
    sizes = tuple(sorted(sizes, reverse=True))
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[i]}:
            rest = list(rooms)
            rest.remove(room)
            go(i + 1, tuple(sorted([*rest, room - sizes[i]])))
        go(i + 1, tuple(sorted([*rooms, capacity - sizes[i]])))

    go(0, ())
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_bins_are_as_few_as_can_be(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 17, 30])
    sizes = [r.randint(1, capacity if seed % 2 else capacity // 2 + 1) for _ in range(r.randint(1, 10))]
    counts = {s: sizes.count(s) for s in set(sizes)}
    got = check_packing(counts, capacity, packing.bin_completion(counts, capacity))
    assert got == least_bins(sizes, capacity) >= packing.lower_bound(counts, capacity)


def test_search_beats_best_fit():
    counts = {57: 40, 43: 20, 33: 60, 31: 40, 24: 40, 20: 20, 12: 40}
    best_fit = sum(n for _, n in packing.best_fit_decreasing(counts, 100))
    got = check_packing(counts, 100, packing.bin_completion(counts, 100))
    assert packing.lower_bound(counts, 100) <= got <= best_fit


def test_search_goes_on_past_5000_bins():
    """5,000 kinds of bins and 1,500 steps for each end at 124 bins here."""
    r = random.Random(361)
    capacity, counts = r.choice([200, 500, 1000, 2048]), {}
    for _ in range(r.choice([60, 150, 400])):
        s = r.randint(capacity // 12, int(capacity * r.choice([0.45, 0.6])))
        counts[s] = counts.get(s, 0) + 1
    assert check_packing(counts, capacity, packing.bin_completion(counts, capacity)) == packing.lower_bound(counts, capacity) == 123


@pytest.mark.parametrize("seed", range(5))
def test_large_histograms(seed):
    r = random.Random(seed)
    counts = {}
    for _ in range(20_000):
        s = min(2048, int(r.lognormvariate(5.5, 1.2)) + 1)
        counts[s] = counts.get(s, 0) + 1
    got = check_packing(counts, 2048, packing.bin_completion(counts))
    assert got <= packing.lower_bound(counts, 2048) + 1
    check_packing(counts, 2048, packing.best_fit_decreasing(counts, 2048))


def test_query(spark, sf, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op4_best_fit_packing(spark, sf).collect()
    want = set()
    for i, text in docs.items():
        whole = ids_of(tokenizer, text)
        for k, o in enumerate(range(0, len(whole), 2048)):
            part = whole[o : o + 2048]
            want.add((i, k, o, len(part), zlib.crc32(part.tobytes())))
    assert sorted(want) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    counts = {}
    for x in want:
        counts[x[3]] = counts.get(x[3], 0) + 1
    assert len(seqs) <= packing.lower_bound(counts, 2048) + 1


def test_assembled_sequences_hold_all_ids(spark, tokenizer):
    rows = [r for r in awkward() if r[0] is not None]
    packed = packing.pack(packing.pieces(documents(spark, rows), BPE, with_ids=True))
    seqs = packing.assemble(packed).collect()
    assert all(len(r["ids"]) <= 2048 for r in seqs)
    assert sum(len(r["ids"]) for r in seqs) == sum(len(ids_of(tokenizer, r[1])) for r in rows)
