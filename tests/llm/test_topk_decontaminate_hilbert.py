import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, hilbert, topk
from barloom.llm.oracle import ORACLE
from barloom.llm.queries import QUERIES
from barloom.verify.compare import differences, duck

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duck(SMALL)
    assert differences(spark, con, SMALL, QUERIES[name], ORACLE[name]) == []


def test_top_k_edges(spark):
    rng = np.random.default_rng(0)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(60, 4)).round(1)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100 + i, vectors[0]) for i in range(30)]  # many ties
    rows += [(200, None), (201, [None, 1.0, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (None, vectors[1]), (204, [1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(frame, frame.where("vec_id in (0, 5, 200, 204)"), 5).collect()
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:90]}
    for q in (0, 5):
        wanted = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == wanted
    assert {r.query_id for r in got} == {0, 5}
    few = topk.top_k(frame.where("vec_id < 3"), frame.where("vec_id = 0"), 5).collect()
    assert sorted((r["rank"], r.query_id) for r in few) == [(1, 0), (2, 0)]
    assert topk.top_k(frame.where("false"), frame.where("false"), 5).count() == 0


def test_scan_edges(spark):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, item), (10, item), (2, "Short Item"), (3, None), (4, "..."), (None, item)], "item_id long, text string")
    texts = {
        1: None, 2: "", 3: "x ONE, two three FOUR five-six seven eight nine ten! eleven y", 4: "a short  item. short itemx",
        5: "one two three four five six seven eight nine", 6: "é one two", 7: "word " * 100_000 + "short item",
    }
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n_hit int")
    for block in (decontaminate.BLOCK_BYTES, 60):  # one automaton, and many
        got = {r.doc_id: r for r in decontaminate.scan(docs, benchmark, block_bytes=block).collect()}
        assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in got.items()} == {
            1: (0, 0, []), 2: (0, 0, []), 3: (13, 11, ["1", "10"]), 4: (5, 2, ["2"]), 5: (9, 0, []), 6: (2, 0, []), 7: (100_002, 2, ["2"]),
        }
        (span,) = got[3].spans
        assert texts[3].encode()[span.start : span.end] == b"ONE, two three FOUR five-six seven eight nine ten! eleven"
        assert sorted(r.doc_id for r in decontaminate.clean(docs, benchmark, block_bytes=block).collect()) == [1, 2, 5, 6]
    digest = decontaminate.digest(decontaminate.scan(docs, benchmark)).where("doc_id = 3").first()
    assert digest.items_sha256 == hashlib.sha256(b"1,10").hexdigest() and digest.contaminated
    assert decontaminate.scan(docs.where("false"), benchmark).count() == 0
    assert decontaminate.scan(docs, benchmark.where("false")).where("n_hit > 0").count() == 0
    assert re.findall(decontaminate.WORD_PATTERN, "a-é b") == ["a", "é", "b"]


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (2, 1), (1, 4)])
def test_the_curve_visits_neighbours(spark, dimensions, bits):
    rows = sorted((r[1], r[0]) for r in hilbert.curve(spark, dimensions, bits).collect())
    assert [i for i, _ in rows] == list(range(1 << (dimensions * bits)))
    points = [[c >> (bits * d) & ((1 << bits) - 1) for d in range(dimensions)] for _, c in rows]
    if dimensions > 1:
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(points, points[1:], strict=False))


def test_shards_are_equal_runs(spark):
    got = QUERIES["op10_hilbert_shards"](spark, SMALL).toPandas()
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    counts = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1 and len(counts) == 8
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and not got.duplicated(["shard", "slot"]).any()
    order = got.sort_values(["shard", "slot"])
    assert order.curve_index.is_monotonic_increasing
    import zlib

    sizes = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == sizes


def test_shard_edges(spark, folder):
    rows = [(None, None, None), (1, None, 5), (1, "en", 5), (2, "en", None), (2, "en", None)] + [(i, "en", 7) for i in range(50)]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, lang string, n_chars int, shard int")
    dims = [hilbert.Dimension("lang"), hilbert.Dimension("n_chars", "number")]
    got = hilbert.hilbert_shards(frame, dims, key="doc_id", shards=8)
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert got.select("shard", "slot").distinct().count() == len(rows)
    hilbert.write_shards(got, f"{folder}/shards")
    assert spark.read.parquet(f"{folder}/shards").count() == len(rows)
    few = hilbert.hilbert_shards(frame.limit(3), dims, key="doc_id", shards=8)
    assert few.count() == 3 and few.agg(F.max("slot")).first()[0] == 0
    assert hilbert.hilbert_shards(frame.where("false"), dims, key="doc_id").count() == 0


def test_hilbert_keeps_columns_of_any_name(spark):
    rows = [(i, i % 3, f"c{i}", "s", 1, 2, 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, x int, _code string, _salt string, _RANK int, _place int, _hilbert int")
    got = hilbert.hilbert_shards(docs, [hilbert.Dimension("x")], key="id", shards=4).collect()
    assert sorted((r["_code"], r["_salt"], r["_RANK"], r["_place"], r["_hilbert"]) for r in got) == sorted((r[2], *r[3:]) for r in rows)
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(10)]
