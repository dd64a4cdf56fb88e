"""Substring deduplication by sliding sentence spans.

Every run of several consecutive sentences is hashed, equal runs meet in a
global join, and a sentence goes if it lies in a run that occurs earlier: in a
document of smaller id, or further up in the same document.

Runs are two consecutive sentences, and single sentences of `LONE_WORDS` words or more. A longer run
needs no hash of its own: where it occurs earlier, so do the pairs that cover it. Runs depend on
their own text only, so both copies of a passage have the same ones.

A document sends each different run once. Repeats within a document need no
join. A run that a third of all documents share is reduced to its first document
before the shuffle, and joins back as a skewed key that Spark splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_batches

#: Words from which on a single sentence counts as a run.
LONE_WORDS = 50
#: A sentence ends behind its closing marks and white space, behind ideographic marks, or at a line end.
BOUNDARY = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])|\s*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Character ranges of the sentences, without white space around them."""
    out, start = [], 0
    for m in BOUNDARY.finditer(text):
        out.append((start, m.start() if m.group().isspace() or not m.group() else m.start() + len(m.group().rstrip())))
        start = m.end()
    out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def runs(text: str, least_words: int = 0) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The sentences, and (hash, first sentence, sentences) of every run; case and white space don't count. Pairs of fewer words than `least_words` are no run."""
    places = sentences(text)
    words = [text[a:b].lower().split() for a, b in places]
    counts = [len(w) for w in words]
    hashes = [xxhash.xxh3_64_digest(" ".join(w).encode("utf-8", "replace")) for w in words]
    out = []
    for i, n in enumerate(counts):
        if n >= LONE_WORDS:
            out.append((xxhash.xxh3_64_intdigest(hashes[i], 1), i, 1))
        if i + 1 < len(counts) and n + counts[i + 1] >= least_words:
            out.append((xxhash.xxh3_64_intdigest(b"".join(hashes[i : i + 2]), 2), i, 2))
    return places, out


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _hashes(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1)):
                different = {h for h, _, _ in runs(text.as_py() or "", least_words)[1]}
                rows += [i] * len(different)
                out += different
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(out)), batch.column(0).take(pa.array(rows, pa.int64()))], names=["run", "doc"]
            )

    return run


RESULT = "n_sentences int, n_removed int, removed array<struct<start: int, end: int>>, kept string"


def _cut(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for text, later in zip(batch.column(1), batch.column(2), strict=True):
                text, later = text.as_py(), set(later.values.to_numpy().view(np.uint64).tolist() if later.is_valid else ())
                places, found = runs(text or "", least_words)
                gone, seen = set(), set()
                for h, first, n in found:
                    if h in later or h in seen:
                        gone.update(range(first, first + n))
                    seen.add(h)
                ends = [a for a, _ in places[1:]] + [len(text or "")]
                ranges: list[tuple[int, int]] = []
                for i in sorted(gone):
                    a, b = places[i][0], ends[i]
                    ranges[-1:] = [(ranges[-1][0], b)] if ranges and ranges[-1][1] == a else [*ranges[-1:], (a, b)]
                kept, at = [], 0
                for a, b in ranges:
                    kept.append(text[at:a])
                    at = b
                out[0].append(len(places))
                out[1].append(len(gone))
                out[2].append([{"start": a, "end": b} for a, b in ranges])
                out[3].append("".join([*kept, text[at:]]) if text is not None else None)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [pa.array(x, kind) for x, kind in zip(out, (pa.int32(), pa.int32(), span, pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["id", "n_sentences", "n_removed", "removed", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_words: int = 0) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (character ranges of the input text) and kept (the text without them).

    Defined results: a null text stays null and has no sentences; an empty one
    stays empty; rows with equal ids are the same place in the order, so none of
    them is earlier than another; null ids come first and are equal to each
    other; an empty table gives no row. Runs are judged on the input, not on
    what is left. Other columns aren't read. `least_words` spares pairs of fewer words, such as list items; it is off.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    found = map_batches(source, _hashes(least_words), f"run long, doc {kind}")
    # A null id counts as smaller than any other.
    place = F.coalesce("doc", F.lit("") if kind == "string" else F.lit(-(1 << 63)).cast(kind))
    placed = found.withColumn("place", place)
    first = placed.groupBy("run").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("last > first")
    later = placed.join(first.select("run", "first"), "run").where("place > first").groupBy("doc").agg(F.collect_set("run").alias("later"))
    joined = source.join(later, F.col("id").eqNullSafe(F.col("doc")), "left").select("id", "text", "later")
    return map_batches(joined, _cut(least_words), f"id {kind}, {RESULT}").withColumnRenamed("id", doc_id)
