import base64
import hashlib
import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import secret_scan
from barloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def battery(hit, counts):
    """(p_random, p_ordinary) in plain Python with the exact normal distribution."""
    core = hit.rstrip("=")
    number = next(i for i, a in enumerate(secret_scan.ENCODINGS) if set(core) <= set(a))
    alphabet, (s2, s3) = secret_scan.ENCODINGS[number], secret_scan.coincidence(counts)[number]
    n, k = len(core), len(alphabet)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    pairs = sum(core.count(c) * (core.count(c) - 1) / 2 for c in set(core))

    def z(a, b):
        mean, var = n * (n - 1) / 2 * a, n * (n - 1) / 2 * a * (1 - a) + n * (n - 1) * (n - 2) * (b - a * a)
        return (pairs - mean) / math.sqrt(max(var, 1e-9))

    v = [alphabet.index(c) for c in core]
    up = [2 * x >= k for x in v]
    both, runs = 2 * sum(up) * (n - sum(up)), 1 + sum(a != b for a, b in zip(up, up[1:], strict=False))
    p = [tail(z(1 / k, 1 / k**2)), 0, 0]
    if both:
        p[1] = 2 * tail(abs(runs - 1 - both / n) / math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 1e-9)))
    m = sum(v) / n
    d = sum((x - m) ** 2 for x in v)
    if d:
        p[2] = 2 * tail(abs(sum((a - m) * (b - m) for a, b in zip(v, v[1:], strict=False)) / d + 1 / n) * math.sqrt(n))
    h = -sum(math.log(max(x, 1e-300)) for x in p)
    return math.exp(-h) * (1 + h + h * h / 2), tail(-z(s2, s3))


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_secret_scan"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        spans = base(text or "")
        joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in joined.split(",") if s]


def test_tests_equal_plain_python(spark):
    rng = random.Random(4)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hits = ["".join(rng.choice(symbols[:k]) for _ in range(n)) for n in (20, 33, 64, 300) for k in (1, 2, 26, 36, 62, 64)]
    hits += ["a" * 20, "0123456789" * 3, "abcdefghijklmnopqrstuvwxyz", "well-known-and-often-used-words", "ABCDEF0123456789ABCDEF", base64.b64encode(bytes(16)).decode()]
    counts = {c: 5 + 1000 * (c in "etaoin") + 50 * c.islower() for c in symbols}
    frame = spark.createDataFrame([(h,) for h in hits], "hit string")
    for r in frame.select("hit", secret_scan.tested(F.col("hit"), secret_scan.coincidence(counts)).alias("p")).collect():
        expected = battery(r.hit, counts)
        assert r.p.p_random == pytest.approx(expected[0], rel=1e-2, abs=1e-6)
        assert r.p.p_ordinary == pytest.approx(expected[1], rel=1e-2, abs=1e-6)


def test_random_strings_are_found_and_ordinary_ones_are_not(spark):
    rng, docs = random.Random(9), pd.read_parquet(f"{SMALL}/documents.parquet")
    rows, planted, harmless = [], set(), set()
    words = [w for t in docs.text.dropna() for w in re.findall("[a-z]{3,}", t)]
    for i, text in enumerate(docs.text.dropna().head(400)):
        secret = [base64.b64encode(rng.randbytes(40)).decode(), base64.urlsafe_b64encode(rng.randbytes(45)).decode(), rng.randbytes(32).hex().upper()][i % 3]
        plain = ["-".join(rng.choices(words, k=7)), "".join(w.capitalize() for w in rng.choices(words, k=7)), "=-" * 30 + "-" * 40][i % 3]
        head = text[:50] + "\U0001f511 "
        rows.append((i, f"{head}{secret} und {plain} \U0001f511"))
        planted.add((i, len(head), len(head) + len(secret)))
        harmless.add((i, len(head) + len(secret) + 5))
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, s.start, s.end) for r in got for s in r.spans if s.kind == 3}
    assert len(found & planted) > 0.97 * len(planted)
    assert len([1 for i, start, _ in found if (i, start) in harmless]) <= 0.01 * len(harmless)


def test_edges(spark):
    long = ("ab12" * 6 + " ") * 3000
    texts = [
        None, "", "token", 'API_KEY="abcdef"', "apikey:abcde", "Password : x1-_.=+/9 secret=TOKEN=abc", "token: secret : abcdefgh",
        "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "é\U0001f511 " + "0" * 24, long, "x" * 300_000, "İPASSWORD=ſecret=abcdefg", "AKIAAKIA" + "B2" * 9,
    ]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "passwd=123456", 1, "x")] + [(3, texts[3], 1, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, base string")
    scanned = secret_scan.scan(docs)
    got = scanned.collect()
    assert len(got) == len(rows)
    for r in got:
        text = "passwd=123456" if r.doc_id is None else texts[r.doc_id] or ""
        assert [tuple(s) for s in r.spans if s.kind < 3] == base(text)
    assert len(next(r for r in got if r.doc_id == 9).spans) == 3000
    assert secret_scan.digest(secret_scan.scan(docs.where("false"))).count() == 0
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
