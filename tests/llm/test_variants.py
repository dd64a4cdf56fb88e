import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from barloom.llm import variants
from barloom.llm.common import LOWER_BYTES
from barloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def brute(rows):
    """The contract in plain Python: every deletion and replacement pattern of every word."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().translate(LOWER_BYTES).decode()
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: set() for w in n}
    holes = {}
    for w in n:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
            holes.setdefault((i, shorter), []).append(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, found in near.items():
        best = min(((-n[x], x) for x in found), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def rows_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    expected = brute(zip(docs.doc_id, docs.text, strict=True))
    got = QUERIES["op12_spelling_variants"](spark, SMALL)
    assert rows_of(got) == expected and sum(v[3] for v in expected.values()) > 100 and got.count() == len(expected)


def crowd():
    """Words over two letters and of many lengths, some very long, with chains of forms."""
    rng, rows = np.random.default_rng(2), []
    for i in range(900):
        word = "".join(rng.choice(list("abé"), rng.integers(7, 12)))
        rows.append((i, " ".join([word.upper() if i % 3 else word] * int(rng.integers(1, 4)))))
    for k in range(4):  # each form ten times as frequent as the one before
        rows += [(1000 + 10 * k + j, " ".join(["constitution"[: 12 - k]] * 10 ** (3 - k) * 2)) for j in range(3)]
    long = "x" * 30_000
    return [*rows, (None, "Ärgerlich ärgerlich Ärgerlich"), (5000, f"{long} {long}y {long} {long}y"), (5001, None), (5002, "")]


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_blocks_chains_and_edges(spark, block):
    rows = crowd() + crowd()[:50]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, m int").repartition(7)
    expected = brute(rows)
    assert rows_of(variants.group_variants(docs, block=block)) == expected
    assert any(v[1] not in (v[0], w) for w, v in expected.items())
    assert variants.group_variants(docs.where("false")).count() == 0
    assert variants.group_variants(docs.where("doc_id >= 5001")).count() == 0


def test_index_by_pairs():
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("ab"), n)) for n in (7, 8) for _ in range(200)})

    def distance_one(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    index = variants.PositionIndex(words, 7)
    for i, w in enumerate(words):
        found = {words[k] for k in variants._members(index.near(w, 1 << i, False))}
        assert found == {x for x in words if distance_one(w, x) and not len(w) == len(x) == 8}
        rest = {words[k] for k in variants._members(index.near(w, 1 << i, True))}
        assert rest == {x for x in found if x[:3] != w[:3]}
