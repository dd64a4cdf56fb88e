import zlib

import numpy as np
import pandas as pd
import pytest

from barloom.llm import near_dedup, packing, spans, toxicity
from barloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_spans_equal_brute_force(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    owner = {}
    for i, t in sorted(zip(docs.doc_id, docs.text, strict=True)):
        for h, _, _ in spans.runs(t)[1]:
            owner.setdefault(h, i)
    got = {r.doc_id: r for r in QUERIES["op1_sentence_spans"](spark, SMALL).collect()}
    assert sorted(got) == sorted(docs.doc_id)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        places, found = spans.runs(t)
        gone, seen = set(), set()
        for h, a, n in found:
            if owner[h] < i or h in seen:
                gone |= set(range(a, a + n))
            seen.add(h)
        assert (got[i].n_sentences, got[i].n_removed) == (len(places), len(gone))
        cut, at = "", 0
        for r in got[i].removed:
            cut, at = cut + t[at : r.start], r.end
        assert got[i].kept == cut + t[at:]


def test_span_edges(spark):
    passage = "The first sentence of it has quite a few words. The second one has some more words in it! Is the third short? " * 2
    rows = [(1, None), (2, ""), (3, passage + "One end."), (4, "Other start. " + passage), (4, "Other start. " + passage), (None, "Lone. " + passage)]
    rows += [(9, "No. Yes. No."), (10, "No. Yes. No.")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = spans.remove_repeats(docs, least_words=10).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_sentences): r for r in got}
    # The null id comes first; what its text repeats within itself goes, and the later documents' copies go whole.
    assert by[None, 7].n_removed == 3 and by[3, 7].kept == "One end." and by[4, 7].kept == "Other start. "
    assert by[9, 3].n_removed == by[10, 3].n_removed == 0
    assert by[1, 0].kept is None and by[2, 0].kept == ""
    assert spans.remove_repeats(docs.where("false")).count() == 0
    short = {r.doc_id: r.kept for r in spans.remove_repeats(docs.where("doc_id > 8")).collect()}
    assert short == {9: "No. Yes. No.", 10: ""}


def test_spans_are_all_repeated_runs(spark):
    """Against plain strings: every run of two or more sentences that an earlier document has goes, whatever its length."""
    rng = np.random.default_rng(12)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 900, rng.integers(1, 30))) + "." for _ in range(300)]
    texts = []
    for i in range(120):
        own = [" ".join(f"u{i}x{x}" for x in rng.integers(0, 9**9, 6)) + "." for _ in range(6)]
        at = int(rng.integers(0, 290))
        own[int(rng.integers(0, 6)) :] = pool[at : at + int(rng.integers(1, 9))]
        texts.append(" ".join(own))
    texts.append(" ".join(["long"] * 300_000) + ". " + texts[0])
    got = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    first = {}
    split = [[x + "." for x in t.split(".") if x.strip()] for t in texts]
    for i, own in enumerate(split):
        own = [" ".join(x.split()) for x in own]
        gone = set()
        for n in range(1, len(own) + 1):
            for a in range(len(own) - n + 1):
                run = "|".join(own[a : a + n])
                if n > 1 or len(run.split()) >= 50:
                    if first.setdefault(run, (i, a)) < (i, a):
                        gone.update(range(a, a + n))
        assert got[i].n_removed == len(gone)


def test_packing(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op6_best_fit_packing"](spark, SMALL).toPandas()
    total = got.length.sum()
    assert got.sequence_id.nunique() <= 1.02 * -(-total // 2048) and got.groupby("sequence_id").length.sum().max() <= 2048
    order = got.sort_values(["sequence_id", "offset"])
    assert (order.offset == order.groupby("sequence_id").length.cumsum() - order.length).all()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_files()[0])
    own = {i: rows.sort_values("piece") for i, rows in got.groupby("doc_id")}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4")
        r = own[i]
        assert r.length.sum() == len(ids) and list(zip(r.start, r.length, strict=True)) == packing.cuts(len(ids), 2048)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(r.start, r.length, strict=True)] == list(r.ids_crc32)


def test_packing_edges(spark):
    texts = [None, "", "a", "x" * 30_000, " " * 5000 + "b", "<|endoftext|> é", "word " * 5000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, "a", 1), (None, "q", 1)], "doc_id long, text string, piece int")
    placed = packing.pack_documents(docs).toPandas()
    assert placed[placed.doc_id == 0].length.tolist() == [1] and len(placed[placed.doc_id == 2]) == 2
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs).collect()}
    assert sum(map(len, whole.values())) == placed.length.sum() and max(map(len, whole.values())) <= 2048
    assert packing.pack_documents(docs.where("false")).count() == 0
    assert packing.cuts(2048, 2048) == [(0, 2048)] and packing.cuts(4097, 2048) == [(0, 1), (1, 2048), (2049, 2048)]


def test_open_bins_close_the_fullest_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 3, 9, 4, 1)] == [(0, 0), (0, 6), (1, 0), (2, 0), (0, 9)]
    bins = packing.OpenBins(10, 1)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0)]


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op7_toxicity"](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels)
    toxic, rank = held.toxic == 1, held.score.rank()
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / toxic.sum() / (~toxic).sum()
    assert auc > 0.9
    assert held.predicted[toxic].mean() > 0.5 and held.predicted[~toxic].mean() < 0.01


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "plain words", 1.0), (None, "bad " * 200_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    for some in (labels, labels.where("false"), labels.where("toxic = 0")):
        got = toxicity.score(docs.unionByName(docs), toxicity.train(docs, some)).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.where("false"), toxicity.train(docs, labels)).count() == 0


@pytest.mark.parametrize("long_list", [3, 8192])
def test_near_duplicates_leave_one_of_each(spark, long_list):
    rng = np.random.default_rng(1)
    text = lambda: [f"w{x}" for x in rng.integers(0, 5000, 200)]
    originals = [text() for _ in range(8)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    for n in range(24):  # copies with two words changed
        w = list(originals[n % 3])
        for p in rng.integers(0, 200, 2):
            w[p] = f"z{n}"
        rows.append((100 + n, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (None, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, keeper int")
    got = {r.id: r.keeper for r in near_dedup.groups(docs, long_list=long_list).collect()}
    assert got == {**{i: i for i in range(8)}, **{100 + n: n % 3 for n in range(24)}, 200: 200, 201: 200, 202: 202, 203: 202, None: 5}
    kept = near_dedup.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(8), 200, 202] and kept.columns == docs.columns
    assert near_dedup.one_of_each(docs.where("false")).count() == 0
    again = docs.unionByName(docs.where("doc_id in (3, 101, 202)")).unionByName(docs.where("doc_id = 3"))
    assert sorted(r.doc_id for r in near_dedup.one_of_each(again).collect()) == [*range(8), 200, 202]


def test_near_duplicates_are_those_of_jaccard_08(spark):
    """Against brute force: 4 of 5 and 9 of 10 shingles are near, 5 of 7 aren't, also in texts of a few words."""
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    texts = []
    for n, more in [(8, 1)] * 40 + [(9, 2)] * 40 + [(5, 1), (13, 1), (40, 9), (40, 8), (68, 16), (68, 17), (200, 49), (200, 50), (200, 60)] * 8:
        own = [word() for _ in range(n)]
        texts += [own, own + [word() for _ in range(more)]]
    line = [word() for _ in range(12)]
    texts += [[word() for _ in range(20)] + line for _ in range(60)] + [[word() for _ in range(6)] * 40 for _ in range(3)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    keeper = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(keeper[a], keeper[b]), min(keeper[a], keeper[b])
                keeper = [new if k == old else k for k in keeper]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for long_list in (5, near_dedup.LONG_LIST):
        assert {r.id: r.keeper for r in near_dedup.groups(docs, long_list=long_list).collect()} == dict(enumerate(keeper))
