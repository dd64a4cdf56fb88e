"""Exact top-k search by inner product through global score histograms.

Queries and candidates are cut into hashed blocks, and every pair of blocks is
scored in a task of its own. No scores are kept or shuffled: a pass reduces
them to counts by (query, score bin), and the sums of these counts locate the
bin that holds a query's k-th score. The next pass looks into that bin only,
with narrower bins, until a bin is one score. The last pass lets through what
lies at or above the k-th score, and ties there go to the smaller id.

Within a block a bin below the block's own k-th score can't hold the global
one, so it isn't reported. That bounds what a block sends without a cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import staged, with_package

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: Bits of a score below the bin of each pass; the last pass has bins of one score.
SHIFTS = (12, 6, 0)
#: Beyond every score, and below the square root of the largest long.
OPEN = 1 << 62


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id and z, the floors of scale * x. Null vectors and vectors with null or non-finite components go."""
    x = F.col(embedding)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf"))
    return (
        vectors.where(F.col(vec_id).isNotNull() & x.isNotNull())
        .where(F.forall(x, finite))
        .select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("z"),
        )
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = pc.list_flatten(column.combine_chunks()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; through floats where all partial sums are exact."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _scores(queries: pa.Table, candidates: pa.Table):
    """(row of queries, its columns, ids, scores) for each query of a pair of blocks."""
    if not queries.num_rows or not candidates.num_rows:
        return
    width = len(queries["z"][0])
    ids = candidates["vec_id"].to_numpy()
    left = {n: queries[n].to_numpy() for n in ("vec_id", "lo", "hi", "need")}
    products = _products(_matrix(queries["z"], width), _matrix(candidates["z"], width))
    for i, scores in enumerate(products):
        other = ids != left["vec_id"][i]
        yield {n: int(v[i]) for n, v in left.items()}, ids[other], scores[other]


def _counter(shift: int):
    def count(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = ([], [], [])
        for q, _, scores in _scores(queries, candidates):
            inside = scores[(scores >= q["lo"]) & (scores < q["hi"])]
            if len(inside) > q["need"]:
                kth = np.partition(inside, len(inside) - q["need"])[len(inside) - q["need"]]
                inside = inside[inside >= (kth >> shift) << shift]
            bins, counts = np.unique(inside >> shift, return_counts=True)
            out[0].append(np.full(len(bins), q["vec_id"]))
            out[1].append(bins)
            out[2].append(counts)
        joined = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(("vec_id", "bin", "n"), joined, strict=True)))

    return count


def _selector(k: int):
    def select(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = ([], [], [])
        for q, ids, scores in _scores(queries, candidates):
            keep = scores >= q["lo"]
            ids, scores = ids[keep], scores[keep]
            if len(ids) > k:  # only the block's own first k can be among the global first k
                first = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[first], scores[first]
            out[0].append(np.full(len(ids), q["vec_id"]))
            out[1].append(ids)
            out[2].append(scores)
        joined = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), joined, strict=True)))

    return select


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates by integer inner product.

    Ties go to the smaller vec_id. A candidate with the query's own id takes no
    part. Defined results: null ids, null vectors and vectors with null or
    non-finite components take no part; vectors of different length don't meet;
    an empty vector scores 0 with other empty ones; of query rows with one id the
    least vector is asked; repeated candidate rows are candidates of their own; a
    query with fewer than k candidates returns all; empty tables give no row.
    Other columns aren't read. Scores must stay within 2**62.
    """
    everyone = staged(quantised(candidates, vec_id, embedding, scale).withColumn("width", F.size("z")), "vectors")
    asked = quantised(queries, vec_id, embedding, scale).groupBy("vec_id").agg(F.min("z").alias("z"))
    asked = staged(asked.withColumn("width", F.size("z")), "queries")
    with_package(candidates.sparkSession)
    blocks = lambda frame, rows: max(1, -(-frame.count() // rows))
    q_blocks, c_blocks = blocks(asked, QUERY_BLOCK), blocks(everyone, CANDIDATE_BLOCK)
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = (
        everyone.withColumn("c", spread(c_blocks)).withColumn("q", each(q_blocks)).select("width", "q", "c", "vec_id", "z")
    )

    def meet(bounds: DataFrame, task, schema: str) -> DataFrame:
        left = (
            asked.join(bounds, ["vec_id", "width"])
            .withColumn("q", spread(q_blocks))
            .withColumn("c", each(c_blocks))
            .select("width", "q", "c", "vec_id", "z", "lo", "hi", "need")
        )
        key = ["width", "q", "c"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(task, schema)

    bounds = asked.select(
        "vec_id", "width", F.lit(-OPEN).alias("lo"), F.lit(OPEN).alias("hi"), F.lit(k).cast("long").alias("need")
    )
    down = Window.partitionBy("vec_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    for shift in SHIFTS:
        counts = meet(bounds, _counter(shift), "vec_id long, bin long, n long").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        summed = counts.withColumn("above", F.sum("n").over(down))
        located = (
            summed.join(bounds.select("vec_id", "need"), "vec_id")
            .where("above >= need and above - n < need")
            .select(
                "vec_id",
                F.shiftleft(F.col("bin"), shift).alias("lo2"),
                (F.shiftleft(F.col("bin") + 1, shift)).alias("hi2"),
                (F.col("need") - (F.col("above") - F.col("n"))).alias("need2"),
            )
        )
        # A query with fewer than k candidates has no such bin: it stays open and returns all.
        bounds = staged(
            bounds.join(located, "vec_id", "left").select(
                "vec_id",
                "width",
                F.coalesce("lo2", "lo").alias("lo"),
                F.coalesce("hi2", "hi").alias("hi"),
                F.coalesce("need2", "need").alias("need"),
            ),
            "bounds",
        )
    found = meet(bounds, _selector(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
