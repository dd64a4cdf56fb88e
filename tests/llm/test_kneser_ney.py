import math
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest

from barloom.llm import kneser_ney
from barloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*lowered.encode("utf-8", "replace").split(), None]


class Plain:
    """The model with strings and dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for text in texts:
            got = tokens(text)
            self.words.update(got)
            self.pairs.update(zip(["<"] + got[:-1], got, strict=True))
        self.kinds, self.after, self.total = Counter(), defaultdict(Counter), Counter()
        for (h, w), c in self.pairs.items():
            self.kinds[w] += 1
            self.after[h][min(c, 3)] += 1
            self.total[h] += c
        self.d2, self.d1 = (self.discounts(Counter(x.values())) for x in (self.pairs, self.kinds))
        self.n, self.v, self.t = sum(self.words.values()), len(self.words), sum(self.kinds.values())
        self.mass = sum(self.d1[min(k, 3) - 1] for k in self.kinds.values()) / self.t if self.t else 1

    @staticmethod
    def discounts(n):
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else k / 2 for k in (1, 2, 3)]
        return [min(max(x, 0), k) for k, x in zip((1, 2, 3), d, strict=True)]

    def off(self, c, d):
        return max(c - d[min(c, 3) - 1], 0) if c else 0

    def probability(self, h, w):
        low = self.mass / (self.v + 1) + (self.off(self.kinds[w], self.d1) / self.t if self.t else 0)
        if not self.total[h]:
            return low
        left = sum(self.d2[k - 1] * n for k, n in self.after[h].items())
        return (self.off(self.pairs[h, w], self.d2) + left * low) / self.total[h]

    def score(self, text):
        got = tokens(text)
        base = sum(math.log10((self.words[w] + 1) / (self.n + self.v + 1)) for w in got)
        logs = sum(math.log10(self.probability(h, w)) for h, w in zip(["<"] + got[:-1], got, strict=True))
        return len(got), sum(self.words[w] > 0 for w in got), base, logs


def same(row, wanted):
    assert (row.n_tokens, row.n_known) == wanted[:2]
    assert row.base_score == pytest.approx(wanted[2], rel=1e-9) and row.score == pytest.approx(wanted[3], rel=1e-9)


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.doc_id}
    plain = Plain([t for i, t in zip(docs.doc_id, docs.text, strict=True) if not out[i]])
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    got = QUERIES["op9_kneser_ney"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == out[r.doc_id] and r.train_tokens == plain.n
        same(r, plain.score(texts[r.doc_id]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    plain = Plain(["a b a c", "b a", "c c c a b"])
    for h in ("<", b"a", b"b", b"zz"):
        known = sum(plain.probability(h, w) for w in plain.words)
        assert known + plain.probability(h, b"never") == pytest.approx(1)


def test_edges(spark):
    texts = {1: None, 2: "", 3: "One one ONE", 4: "É é x", 5: "word " * 300_000, 6: "a\x00b"}
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in texts.items()], "doc_id long, text string, score double")
    for training in (docs, docs.where("false")):
        model = kneser_ney.train(training)
        plain = Plain(list(texts.values()) if training is docs else [])
        got = kneser_ney.score(docs.unionByName(docs), model).collect()
        assert len(got) == 12
        for r in got:
            same(r, plain.score(texts[r.doc_id]))
    assert kneser_ney.score(docs.where("false"), model).count() == 0
