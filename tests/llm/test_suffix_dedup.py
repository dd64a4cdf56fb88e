import hashlib

import numpy as np
import pandas as pd
import pytest

from barloom.llm import suffix_dedup
from barloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def plain(rows):
    """n_bytes, n_removed, n_spans, sha256 of what is left, by looking every window up."""
    first = {}
    data = [(i, (t or "").encode("utf-8", "replace")) for i, t in rows]
    order = lambda i: -(1 << 63) if i is None else i
    for i, b in data:
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            first[w] = min(first.get(w, (order(i), s)), (order(i), s))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (order(i), s):
                gone[s : s + 100] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=str)


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op4_suffix_array"](spark, SMALL).collect()
    assert key(tuple(r) for r in got) == key(plain(zip(docs.doc_id.tolist(), docs.text, strict=True)))


def edge_rows():
    rng = np.random.default_rng(2)
    word = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, n))
    core, other = word(400), word(300)
    rows = [(1, None), (2, ""), (3, "short"), (4, core), (5, core), (6, word(50) + core[100:350] + word(60)), (7, "ab" * 300)]
    rows += [(8, "é" * 200), (9, other + core[:99]), (10, core[:100] + "é" + other[5:200]), (11, word(5) + "ab" * 60), (12, other * 3)]
    rows += [(100 + i, word(30) + core[50:250] + word(30 + i)) for i in range(40)]
    return [*rows, (12, other * 3), (4, core), (None, core[:150])]


@pytest.mark.parametrize("hot", [3, 20_000])
def test_edges(spark, hot):
    rows = edge_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, removed string").repartition(3)
    result = suffix_dedup.remove_repeats(docs, hot=hot)
    assert key(tuple(r) for r in suffix_dedup.digest(result).collect()) == key(plain(rows))
    for r in result.collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0


def test_segments_do_not_depend_on_the_chunk(monkeypatch):
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 100, 3000, dtype=np.uint8)) + b"ab" * 500
    whole, _ = suffix_dedup.window_keys(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    keys, starts, counts = suffix_dedup.segments(text)
    assert counts.sum() == len(text) - 99
    assert np.array_equal(np.repeat(keys, counts), suffix_dedup._mixed(whole * suffix_dedup._BASE))


def test_segments_of_many_texts_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 97 + a, n, dtype=np.uint8)) for a in (1, 2, 26) for n in (0, 99, 100, 101, 160, 151, 400, 900, 5000)]
    texts = [texts[i] for i in rng.permutation(len(texts))] + [b"ab" * 200, b"x" * 700] * 3
    for chunk in (1000, 1 << 18):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        for inner in (False, True):
            for one, own in zip(texts, suffix_dedup.segments_of(texts, inner), strict=True):
                assert all(np.array_equal(a, b) for a, b in zip(own, suffix_dedup.segments(one, inner), strict=True))
        for text in texts:  # a key that occurs twice inside its segment
            if len(text) >= 100:
                least, pieces = suffix_dedup.window_keys(np.frombuffer(text, np.uint8))
                keys, starts, counts, twice = suffix_dedup.segments(text, inner=True)
                again = [(pieces[s : s + n + 50] == least[s]).sum() > 1 for s, n in zip(starts, counts, strict=True)]
                assert twice.tolist() == again


def test_keys_fill_all_shards_evenly():
    rng = np.random.default_rng(6)
    keys = suffix_dedup.segments(bytes(rng.integers(97, 123, 400_000, dtype=np.uint8)))[0]
    shares = np.bincount((keys >> np.uint64(57)).astype(np.int64), minlength=128) / len(keys)
    assert 0.004 < shares.min() and shares.max() < 0.014


def test_a_window_in_many_surroundings_gathers_nowhere(spark, monkeypatch):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, n))
    core = word(101)
    rows = [(i, word(40) + core + word(40)) for i in range(300)]
    gathered, real = [], suffix_dedup.by_shard

    def spy(frame, *rest):
        if "bytes" in frame.columns:
            gathered.append(frame.groupBy("hash").count().agg({"count": "max"}).first()[0] or 0)
        return real(frame, *rest)

    monkeypatch.setattr(suffix_dedup, "by_shard", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    result = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, hot=20))
    assert key(tuple(r) for r in result.collect()) == key(plain(rows))
    assert len(gathered) == 1 and gathered[0] < 20
