"""Bounded-space best-fit packing of token pieces into sequences.

Texts are tokenised where they lie; only (document, piece, start, length,
checksum) of a piece are shuffled. Each task packs a hashed share of the pieces
online: a fixed number of open bins, found through one bitset over free space,
where the lowest set bit at or above a piece's length is the best fit. If no
open bin fits and all places are taken, the fullest bin closes. A task looks
ahead by one Arrow batch and takes its pieces by falling length. A share is
large enough that its last, partly filled bins don't count.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import map_batches, staged

CAPACITY, OPEN_BINS, SHARE = 2048, 4096, 250_000
END = 0
#: A stretch without a token boundary of this many characters goes to the library whose merging is not quadratic in it.
LONG_STRETCH = 2000

PIECES = "piece int, start long, length long, ids_crc32 long"

_loaded: dict[tuple[str, str], object] = {}


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokens:
    """Token ids of one vocabulary, as the tokenizer in `model` gives them.

    `ranks` holds the same vocabulary as merge ranks for a faster library with
    equal ids; texts with very long stretches use `model` itself.
    """

    def __init__(self, model: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.model = Tokenizer.from_file(model)
        self.model.encode_special_tokens = True

    def ids(self, text: str) -> list[int]:
        text = text.encode("utf-8", "replace").decode()
        words = text.split()
        longest = max(map(len, words), default=0)
        if longest > LONG_STRETCH or len(text) - sum(map(len, words)) - len(words) > LONG_STRETCH:
            return self.model.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokens(model: str, ranks: str) -> Tokens:
    if (model, ranks) not in _loaded:
        _loaded[model, ranks] = Tokens(model, ranks)
    return _loaded[model, ranks]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or a shorter first one and then full ones."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]


def pieces(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, files: tuple[str, str] | None = None, keep_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece.

    Every document ends with the id 0; a null or empty text is that id alone.
    """
    model, ranks = files or default_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(model, ranks).ids
        for batch in batches:
            rows, out, kept = [], ([], [], [], []), []
            for i, value in enumerate(batch.column(1)):
                ids = np.array([*encode(value.as_py() or ""), END], "<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append(i)
                    for column, x in zip(out, (piece, start, length, zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
                    if keep_ids:
                        kept.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *[pa.array(x, pa.int64()) for x in out[1:]]]
            names = [doc_id, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text), run, f"`{doc_id}` {kind}, {PIECES}" + ", ids array<long>" * keep_ids)


class OpenBins:
    """At most `limit` open bins; bit f of `free` is set if some open bin has f tokens free."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free, self.count, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        taken = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.count -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            used = self._take(space)
        else:
            space, used = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            if self.count == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            self.bins[left].append(used)
            self.free |= 1 << left
            self.count += 1
        return used, self.capacity - space


def pack(cut: DataFrame, *, doc_id: str = "doc_id", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, share: int = SHARE) -> DataFrame:
    """The pieces with sequence_id and offset, gapless from 0 in each sequence.

    Defined results: pieces of equal length may swap places between equal rows
    only; repeated documents are packed each time; no piece, no row.
    """
    tasks = max(1, -(-cut.count() // share))
    kind = cut.schema[doc_id].dataType.simpleString()
    names = [doc_id, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            places = np.empty((2, len(lengths)), np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                places[:, i] = bins.place(int(lengths[i]))
            first = batch.column("task")[0].as_py() << 40 if len(lengths) else 0
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(places[0] + first), pa.array(places[1])],
                names=[*names, "sequence_id", "offset"],
            )

    order = F.xxhash64(doc_id, "piece")
    dealt = (
        cut.select(*names, order.alias("at"))
        .repartition(tasks, "at")
        .withColumn("task", F.spark_partition_id().cast("long"))
        .sortWithinPartitions("at", doc_id, "piece", "start", "ids_crc32")
    )
    return map_batches(dealt, run, f"`{doc_id}` {kind}, {PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """Tokenise once, then pack. Other columns of `docs` aren't read."""
    return pack(staged(pieces(docs, doc_id=doc_id, text=text, capacity=capacity, files=files), "pieces"), doc_id=doc_id, capacity=capacity)


def sequences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """The packed token ids: sequence_id and ids (at most `capacity`), for training."""
    cut = staged(pieces(docs, doc_id=doc_id, text=text, capacity=capacity, files=files, keep_ids=True), "pieces")
    key = [doc_id, "piece", "start", "length", "ids_crc32"]
    # Equal pieces of repeated documents hold equal ids, so numbering them makes the key unique.
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    placed = pack(cut, doc_id=doc_id, capacity=capacity).withColumn("nth", nth)
    same = F.lit(True)
    right = cut.withColumn("nth", nth).select(*[F.col(k).alias(f"r_{k}") for k in key], F.col("nth").alias("r_nth"), "ids")
    for k in [*key, "nth"]:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return (
        placed.join(right, same)
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    )
