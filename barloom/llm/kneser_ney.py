"""Interpolated modified Kneser-Ney bigram model.

Spark counts the bigrams of the training texts; each shard of the hash range
becomes one sorted array of bigram hashes with its counts in the shared folder. A
second pass over the training texts looks counts up in the mapped arrays and
sums, for each word, what the model needs of it. A bigram that occurs c times
adds 1/c at each occurrence, so the sums are numbers of different bigrams, and
the rows that are shuffled are words, not bigrams. Workers map the arrays and
score: only pages that are read take memory, and they are shared.

The shared folder (spark.checkpoint.dir) must be mounted on the workers, as
arrays are mapped from it. The model has order 2: with invented or otherwise open
vocabularies nearly all longer n-grams occur once, and their arrays would take
more disk than the texts.

Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import Files, by_shard, mapped, new_files, write
from barloom.llm.common import map_batches, text_bytes, word_chunks

#: Tokens after which a task hands on its counts, its sums, and its scores.
COUNTED, SUMMED, SCORED = 2_000_000, 1_000_000, 300_000
#: No word holds a space, so these hash like no word.
BEFORE, END = (xxhash.xxh3_64_intdigest(x) for x in (b" before", b" end"))

WORD = np.dtype([("count", "<u8"), ("kinds", "<u8"), ("n1", "<u8"), ("n2", "<u8"), ("n3", "<u8")])


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words and the end."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)) for w in word_chunks(text)]
    return np.concatenate([*parts, np.array([END], np.uint64)])


def bigram_hashes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and the hash of both."""
    before = np.concatenate([np.array([BEFORE], np.uint64), tokens[:-1]])
    x = before * np.uint64(0x9E3779B97F4A7C15) + tokens
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return before, x ^ (x >> np.uint64(31))


def _groups(texts: Iterator[pa.Scalar], most: int) -> Iterator[list[np.ndarray]]:
    """Token hashes of the texts, about `most` of them at a time."""
    held, size = [], 0
    for text in texts:
        held.append(token_hashes(text_bytes(text.as_py())))
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _writer(files: Files, name: str, columns: int, kind: np.dtype):
    """Writes shards as they come, summing equal hashes, and reports how often small sums occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried_hash, carried = np.zeros(0, np.uint64), np.zeros((columns, 0))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current, totals = None, np.zeros(8)

        def close() -> None:
            if held:
                write(files.path(f"{name}-hash", current), [h for h, _ in held])
                write(files.path(f"{name}-data", current), [d for _, d in held])
                held.clear()

        def add(hashes: np.ndarray, sums: np.ndarray) -> None:
            nonlocal current
            sums = np.rint(sums).astype(np.int64)
            data = sums[0].astype(kind) if kind.names is None else np.rec.fromarrays(sums, kind)
            measure = sums[0] if kind.names is None else sums[1]
            for i, k in enumerate((1, 2, 3, 4)):
                totals[i] += (measure == k).sum()
            totals[4] += measure.sum()
            tokens = hashes != np.uint64(BEFORE)
            totals[5] += (sums[0] * tokens).sum()
            totals[6] += tokens.sum()
            for shard, a, b in files.runs(hashes):
                if shard != current:
                    close()
                    current = shard
                held.append((hashes[a:b], data[a:b]))

        for batch in batches:
            hashes = np.concatenate([carried_hash, batch.column(0).to_numpy().view(np.uint64)])
            sums = np.concatenate([carried, np.array([batch.column(i + 1).to_numpy() for i in range(columns)], np.float64)], axis=1)
            if not len(hashes):
                continue
            start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            hashes, sums = hashes[start], np.add.reduceat(sums, start, axis=1)
            carried_hash, carried = hashes[-1:], sums[:, -1:]
            if len(hashes) > 1:
                add(hashes[:-1], sums[:, :-1])
        if len(carried_hash):
            add(carried_hash, carried)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in totals], names=[f"t{i}" for i in range(8)])

    return run


_STATS = ", ".join(f"t{i} double" for i in range(8))


def _bigram_counts(files: Files, hashes: np.ndarray) -> np.ndarray:
    return mapped(files, "bigram", np.dtype("<u4")).find_any(hashes)[1]


def _count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(chain.from_iterable(b.column(0) for b in batches), COUNTED):
        hashes, n = np.unique(np.concatenate([bigram_hashes(t)[1] for t in group]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int32))], names=["hash", "n"])


def _sum_words(files: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(chain.from_iterable(b.column(0) for b in batches), SUMMED):
            both = [bigram_hashes(t) for t in group]
            words, before = np.concatenate(group), np.concatenate([b for b, _ in both])
            c = _bigram_counts(files, np.concatenate([h for _, h in both])).astype(np.float64)
            unique, at = np.unique(np.concatenate([words, before]), return_inverse=True)
            of_word, of_before, size = at[: len(words)], at[len(words) :], len(unique)
            count = np.bincount(of_word, minlength=size)
            count[unique == np.uint64(BEFORE)] = len(group)
            kinds = np.bincount(of_word, 1 / c, size)
            after = [np.bincount(of_before[s], 1 / c[s], size) for s in (c == 1, c == 2, c >= 3)]
            columns = [pa.array(unique.view(np.int64)), pa.array(count), *[pa.array(x.astype(np.float64)) for x in (kinds, *after)]]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "count", "kinds", "n1", "n2", "n3"])

    return run


def discounts(n: list[float]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many n-grams occur 1, 2, 3 and 4 times.

    Where one of these numbers is zero the discount is half the count's least value it could take off.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    got = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5 * (k + 1) for k in range(3)]
    return tuple(min(max(d, 0.0), float(k + 1)) for k, d in enumerate(got))


@dataclass(frozen=True)
class Model:
    files: Files
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    kinds: float
    word_mass: float
    tokens: int
    vocabulary: int


def train(docs: DataFrame, *, text: str = "text") -> Model:
    """Count, and write the arrays. The number of shards grows with the input's partitions. No text, no counts."""
    files = new_files(docs, "kneser-ney")
    bits = files.bits
    texts = docs.select(text)
    counted = by_shard(map_batches(texts, _count_bigrams, "hash long, n int"), bits)
    sums = [F.sum(f"t{i}") for i in range(8)]
    pairs = [x or 0.0 for x in map_batches(counted, _writer(files, "bigram", 1, np.dtype("<u4")), _STATS).agg(*sums).first()]
    kinds = "hash long, count long, kinds double, n1 double, n2 double, n3 double"
    by_word = map_batches(texts, _sum_words(files), kinds).groupBy("hash").agg(*[F.sum(c).alias(c) for c in WORD.names])
    words = [x or 0.0 for x in map_batches(by_shard(by_word, bits), _writer(files, "word", 5, WORD), _STATS).agg(*sums).first()]
    d = discounts(words[:4])
    more = words[6] - words[0] - words[1]
    mass = (d[0] * words[0] + d[1] * words[1] + d[2] * more) / words[4] if words[4] else 1.0
    return Model(files, discounts(pairs[:4]), d, words[4], mass, int(words[5]), int(words[6]))


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    off = np.select([count == 0, count == 1, count == 2], [0.0, d[0], d[1]], d[2])
    return np.maximum(count - off, 0.0)


def _log_probabilities(model: Model, group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each token: its count in training, and log10 of its probability."""
    both = [bigram_hashes(t) for t in group]
    words, before = np.concatenate(group), np.concatenate([b for b, _ in both])
    unique, at = np.unique(np.concatenate([words, before]), return_inverse=True)
    found = mapped(model.files, "word", WORD).find(unique)[1]
    word, context = found[at[: len(words)]], found[at[len(words) :]]
    pair = _bigram_counts(model.files, np.concatenate([h for _, h in both])).astype(np.float64)
    low = model.word_mass / (model.vocabulary + 1)
    if model.kinds:
        low = low + _discounted(word["kinds"].astype(np.float64), model.word_discounts) / model.kinds
    total = context["count"].astype(np.float64)
    seen = total > 0
    d = model.bigram_discounts
    left = d[0] * context["n1"] + d[1] * context["n2"] + d[2] * context["n3"]
    p = np.where(seen, (_discounted(pair, d) + left * low) / np.maximum(total, 1), low)
    return word["count"].astype(np.float64), np.log10(p)


SCORES = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-one unigrams) and score (log10 probability of the text) of every row.

    Defined results: a null or empty text is its end alone; a word unknown to the
    model gets the mass left for the open vocabulary; a model trained on no text
    is uniform; null ids and repeated rows are kept as they come. Other columns
    aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for group in _groups(iter(batch.column(1)), SCORED):
                count, logs = _log_probabilities(model, group)
                start = np.cumsum([0, *map(len, group[:-1])])
                base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
                out[0].append(np.array([len(t) for t in group]))
                for column, values in zip(out[1:], ((count > 0).astype(np.int64), base, logs), strict=True):
                    column.append(np.add.reduceat(values, start))
            columns = [pa.array(np.concatenate(x) if x else [], kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[doc_id, "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text), run, f"`{doc_id}` {kind}, {SCORES}")
