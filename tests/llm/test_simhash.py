"""SimHash groups against all pairs."""

import random
import re

import pytest
import xxhash
from helpers import awkward, documents, smallest_in_component

from cairnql.llm import common, queries, simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints():
    texts = [r[1] for r in awkward()] + ["One", "one TWO", "ONE two\x0bthree\x1ffour", "Ä ä   b c"]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_long_texts_are_hashed_whole(monkeypatch):
    text = ("a b c d e f g h i j " * 30).encode() + b"z" * (1 << 22)
    whole = brute_fingerprint(text.decode())
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole


def near(a, b):
    return (a ^ b).bit_count() <= 3


@pytest.mark.parametrize("group", [2048, 40, 4])
def test_links_reach_all_that_all_pairs_reach(spark, group):
    """Clusters and chains, some sharing a half or three quarters of their bits, so that groups are cut again."""
    r = random.Random(group)
    fps = {0, 7, 15}
    for shared in (0, 32, 48):
        top = r.getrandbits(64)
        for _ in range(60):
            low = (1 << (64 - shared)) - 1
            at = top & ~low | r.getrandbits(64) & low
            fps.add(at)
            for _ in range(3):
                at ^= sum(1 << b for b in r.sample(range(64), r.randrange(0, 5)))
                fps.add(at)
    dense = r.getrandbits(64)
    fps |= {dense ^ x for x in range(300)}
    ids = sorted(map(signed, fps))
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if near(a % (1 << 64), b % (1 << 64))]
    want = smallest_in_component(ids, links)
    df = spark.createDataFrame([(x,) for x in ids], "fp long")
    found = simhash.links(df, group).collect()
    assert all(want[u] == want[v] for u, v in found)
    assert smallest_in_component(ids, found) == want


def test_components(spark):
    r = random.Random(1)
    nodes = list(range(400))
    edges = [(i, i + 1) for i in range(0, 120)] + [(200, x) for x in range(201, 260)] + [(r.choice(nodes), r.choice(nodes)) for _ in range(80)] + [(5, 5)]
    r.shuffle(edges)
    got = {x["node"]: x["comp"] for x in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = smallest_in_component(nodes, edges)
    assert got == {n: want[n] for n in {x for e in edges if e[0] != e[1] for x in e}}


def test_query_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    ids = sorted(fps)
    want = smallest_in_component(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if near(fps[a], fps[b])])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_one_document_of_each_group_stays(spark):
    rows = awkward()
    groups = {(r["id"], r["component"]) for r in simhash.near_duplicates(documents(spark, [x for x in rows if x[0] is not None])).collect()}
    kept = [r["doc_id"] for r in simhash.dedup(documents(spark, rows)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for _, c in groups})
    assert kept.count(None) == 3
