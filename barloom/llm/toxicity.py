"""Toxicity by compression distance.

Windows of a few words are compressed with two zstandard dictionaries, one of
ordinary text and one that also holds toxic text. How many bytes the second
saves over the first is the evidence of a window. How much each saving tells is
learnt as a log likelihood ratio; sums of these over a document's windows go through a logistic
calibration to a score, whose scale is set by the false alarms among ordinary training rows.

The ordinary dictionary is trained by zstandard. The toxic one is the same
dictionary, entropy tables included, followed by the fragments that toxic text
repeats in many different contexts and ordinary text doesn't; its size is the only bound of these. With all the
rest equal, lengths differ only where a window holds such a fragment. Counting
contexts, not documents, keeps a much copied document from counting twice.
zstandard's own trainer was tried for the toxic part in several forms; it cuts words, and the
gain of a cut word drowns (figures in the README).

Two thirds of the training rows make the dictionaries, the others the calibration, which so learns from
savings on text that the dictionaries haven't seen.

Training reads a sample of labelled rows, at most `rows` and `sample_bytes` for
each label; everything else covers all rows and whole texts.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER_BYTES, map_batches, text_bytes

ROWS, SAMPLE_BYTES = 3000, {1: 5_000_000, 0: 8_000_000}
LEVEL, MIN_MATCH = 3, 4
#: Dictionary bytes, words in a window, first word of the first full window.
MEASURES = ((16384, 8, 0), (16384, 12, 4), (32768, 8, 4))
#: A fragment counts if toxic text has it so many times as often as ordinary text, and if contexts times the log of that
#: ratio is so many times the log of the number of fragments compared: chance alone, or a few near copies, doesn't reach that.
RATIO, EVIDENCE = 12.0, 3.0
#: Bytes of the toxic part of a dictionary, best fragments first.
TOXIC_BYTES = 8192
#: Savings of a window that are told apart, and what is added to their counts.
LEAST_GAIN, MOST_GAIN, PRIOR = -3, 12, 0.5
#: Share of the calibration's ordinary rows that reach THRESHOLD and, below it, the threshold of a filter.
ALARMS_AT_THRESHOLD, ALARMS_OF_FILTER = 0.003, 0.015
#: One row in so many is left to the calibration.
CALIBRATION = 3
#: Windows of the sample that a dictionary is trained on.
DICTIONARY_WINDOWS = 80_000
THRESHOLD = 0.7


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER_BYTES).split()


def windows(w: list[bytes], size: int, first: int) -> list[bytes]:
    starts = range(first, len(w), size) if first else range(0, len(w), size)
    cut = [w[:first]] if first and w else []
    return [b" " + b" ".join(x) + b" " for x in [*cut, *(w[i : i + size] for i in starts)]]


def _contexts(texts: list[list[bytes]]) -> tuple[Counter, int]:
    """Fragments at the start of words and whole words, by the number of different contexts."""
    seen = {hash(x): x[1] for w in texts for x in zip([b"", *w], w, [*w[1:], b""], strict=False)}
    by_word, out = Counter(seen.values()), Counter()
    for word, n in by_word.items():
        out[b" " + word + b" "] += n
        for k in range(4, min(12, len(word)) + 1):
            out[b" " + word[:k]] += n
    return out, max(1, len(seen))


def toxic_fragments(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    ours, n_ours = _contexts(toxic)
    theirs, n_theirs = _contexts(ordinary)
    surprise = EVIDENCE * math.log(len(ours) + 1)
    # By what a fragment tells and the bytes that a match of it saves.
    ranked = sorted(
        (-n * math.log(ratio) * (len(f) - 3), f)
        for f, n in ours.items()
        if (ratio := n / n_ours / ((theirs[f] + 0.5) / n_theirs)) >= RATIO and n * math.log(ratio) >= surprise
    )
    out: list[bytes] = []
    size = 0
    for _, f in ranked:
        if size + len(f) <= TOXIC_BYTES and not any(f in x or x in f for x in out):
            out.append(f)
            size += len(f)
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[-size:].rjust(8, b" ")


def _compressor(dictionary: bytes):
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[tuple[bytes, bytes], ...]
    #: For each measure, the log likelihood ratio of each saving.
    evidence: tuple[tuple[float, ...], ...] = ()
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    #: Score from which a filter takes a document for toxic.
    threshold: float = THRESHOLD

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pairs = [(_compressor(a), _compressor(b)) for a, b in model.dictionaries]
        self.evidence = [np.array(e) for e in model.evidence]

    def gains(self, text: bytes) -> list[np.ndarray]:
        """For each measure, the saving of every window as a number from 0."""
        w, out = words(text), []
        for (plain, toxic), (_, size, first) in zip(self.pairs, MEASURES, strict=True):
            saved = np.array([len(plain(x)) - len(toxic(x)) for x in windows(w, size, first)] or [0])
            out.append(np.clip(saved, LEAST_GAIN, MOST_GAIN) - LEAST_GAIN)
        return out

    def score(self, text: bytes) -> float:
        m = self.model
        if not m.weights:
            return 0.0
        x = (np.array(features(self.gains(text), self.evidence)) - m.mean) / m.scale
        z = float(m.weights[0] + x @ np.array(m.weights[1:]))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def features(gains: list[np.ndarray], evidence: list[np.ndarray]) -> list[float]:
    out: list[float] = []
    for own, table in zip(gains, evidence, strict=True):
        told = table[own]
        out += [told.sum(), told.max(), math.log1p(np.maximum(told, 0).sum()), np.sort(told)[-3:].sum()]
    return [*map(float, out), math.log(len(gains[0]))]


def dictionaries(rows: list[tuple[bytes, int]]) -> tuple[tuple[bytes, bytes], ...]:
    """For each measure, the ordinary dictionary and the toxic one."""
    cut = {label: [words(t) for t, x in rows if x == label] for label in (0, 1)}
    # The best fragment comes last, where a match costs least.
    toxic = b"".join(toxic_fragments(cut[1], cut[0])[::-1])
    samples = [x for w in cut[0] for x in windows(w, MEASURES[0][1], 0)]
    random.Random(1).shuffle(samples)
    del samples[DICTIONARY_WINDOWS:]
    plain = {size: _dictionary(samples, size) for size, _, _ in MEASURES}
    return tuple((plain[size], plain[size] + toxic) for size, _, _ in MEASURES)


def _evidence(measured: list[tuple[list[np.ndarray], int]]) -> list[np.ndarray]:
    """Log likelihood ratios of savings, from the windows of toxic and ordinary documents."""
    counts = np.full((len(MEASURES), 2, MOST_GAIN - LEAST_GAIN + 1), PRIOR)
    for gains, label in measured:
        for k, own in enumerate(gains):
            np.add.at(counts[k, label], own, 1)
    share = counts / counts.sum(2, keepdims=True)
    return list(np.log(share[:, 1] / share[:, 0]))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a ridge logistic regression, by Newton's steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        slope = a.T @ (weight * (y - p)) - b
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(len(b))
        b = b + np.linalg.solve(curve, slope)
    return mean, scale, b


def fit(rows: list[tuple[bytes, int]], share_toxic: float) -> Model:
    """Dictionaries and calibration from labelled texts; share_toxic weighs the labels as they occur."""
    by_label = {x: [r for r in rows if r[1] == x] for x in (0, 1)}
    if not by_label[0] or not by_label[1]:
        return Model(())
    kept = [r for own in by_label.values() for i, r in enumerate(own) if i % CALIBRATION == 0]
    built = [r for own in by_label.values() for i, r in enumerate(own) if i % CALIBRATION or len(own) == 1]
    model = Model(dictionaries(built))
    scorer = model.scorer()
    measured = [(scorer.gains(t), label) for t, label in kept]
    evidence = _evidence(measured)
    x = np.array([features(gains, evidence) for gains, _ in measured])
    y = np.array([float(label) for _, label in measured])
    weight = np.where(y == 1, share_toxic / y.sum(), (1 - share_toxic) / (1 - y).sum()) * len(y)
    mean, scale, b = _logistic(x, y, weight)
    ordinary = np.sort(b[0] + (x[y == 0] - mean) / scale @ b[1:])[::-1]
    reached = [float(np.nextafter(ordinary[int(share * len(ordinary))], np.inf)) for share in (ALARMS_AT_THRESHOLD, ALARMS_OF_FILTER)]
    # The scale of scores is moved so that THRESHOLD has its share of false alarms.
    b[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - reached[0]
    threshold = 1 / (1 + math.exp(reached[0] - reached[1] - math.log(THRESHOLD / (1 - THRESHOLD))))
    return Model(model.dictionaries, tuple(map(tuple, evidence)), tuple(mean), tuple(scale), tuple(b), threshold)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in no fold."""
    return F.crc32(doc_id.cast("string")) % parts


def train(docs: DataFrame, labels: DataFrame, *, rows: int = ROWS, sample_bytes: dict[int, int] | None = None) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold (crc32 mod 3 = 1).

    Labels other than 0 and 1 and null ids are left out. Without rows of both
    labels the model scores everything 0.
    """
    known = labels.where("toxic in (0, 1)").where(fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if set(counts) != {0, 1}:
        return Model(())
    drawn = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == x).orderBy(drawn, "doc_id").limit(rows) for x in (0, 1)]
    sample = picked[0].unionByName(picked[1]).join(docs.select("doc_id", "text"), "doc_id").orderBy(drawn, "doc_id", "text")
    limits, got = dict(sample_bytes or SAMPLE_BYTES), []
    for row in sample.toLocalIterator():
        text = text_bytes(row["text"])
        if limits[row["toxic"]] >= len(text):
            limits[row["toxic"]] -= len(text)
            got.append((text, row["toxic"]))
    return fit(got, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row: 0 to 1, higher means more likely toxic. Only the text counts.

    Null and empty texts score what a text without evidence scores; null ids and
    repeated rows are kept as they come. Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            got = [scorer.score(text_bytes(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=[doc_id, "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text), run, f"`{doc_id}` {kind}, score double")


def harmless(docs: DataFrame, model: Model, *, text: str = "text", threshold: float | None = None) -> DataFrame:
    """The documents that score below the threshold, with all their columns, in one pass.

    Without a threshold it is the model's, which ALARMS_OF_FILTER of ordinary training rows reach.
    """
    limit = model.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            keep = [scorer.score(text_bytes(t.as_py())) < limit for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)
