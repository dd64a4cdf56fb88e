from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash

from barloom.llm import simhash
from barloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def plain_fingerprint(text, k=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode("utf-8", "replace").split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id reachable over fingerprints within 3 bits."""
    ids = sorted(prints)
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    values = np.array([prints[i] for i in ids], np.uint64)
    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(values ^ values[n]) <= 3):
            a, b = sorted((top(i), top(ids[m])))
            label[b] = a
    return {i: top(i) for i in ids}


def check(got, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == plain_components(prints)


def test_every_five_positions_hold_a_set():
    assert len(simhash.POSITIONS) == 14
    for five in combinations(range(8), 5):
        assert any(set(s) <= set(five) for s in simhash.POSITIONS)


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    check(QUERIES["op3_simhash"](spark, SMALL).collect(), dict(zip(docs.doc_id, docs.text, strict=True)))


def test_edges(spark):
    texts = {1: None, 2: "", 3: " \t\n", 4: "One two", 5: "one  TWO", 6: "É é a b c", 7: "x" * 200_000, 8: "word " * 300_000}
    rows = [(i, t, 0) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    check(simhash.near_duplicates(docs).collect(), texts)
    again = simhash.near_duplicates(docs.unionByName(docs)).collect()
    assert len(again) == 16 and len({tuple(r) for r in again}) == 8
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    lone = spark.createDataFrame([(None, "a b c d"), (3, "q r s t")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(lone).collect()} == {(None, None), (3, 3)}


@pytest.mark.parametrize("limit", [2, 4096])
def test_long_lists_lose_no_link(spark, monkeypatch, limit):
    """A dense cloud of fingerprints, with and without splitting its lists."""
    monkeypatch.setattr(simhash, "LONG_LIST", limit)
    rng = np.random.default_rng(3)
    centre = [int(x) for x in rng.integers(0, 2**63, 3)]
    values = {int(c) for c in centre}
    for c in centre:
        for _ in range(60):
            x = c
            for bit in rng.integers(0, 63, rng.integers(1, 7)):
                x ^= 1 << int(bit)
            values.add(x)
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    from barloom.llm.components import components

    got = {r.node: r.component for r in components(simhash.links(frame)).collect()}
    wanted = plain_components({v: v for v in values})
    assert {v: got.get(v, v) for v in values} == wanted


def test_lookups_match_pairs():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 1 << 12, 400).astype(np.uint64) << np.uint64(20))
    a, b = simhash._lookups(values)
    got = plain_components({int(v): int(v) for v in values})
    label = {int(v): int(v) for v in values}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[x] = y
    assert label == got
