"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint has 8 bytes. Two fingerprints that differ in at most 3 bits share
at least 5 bytes at equal positions. The index lists fingerprints under 4
positional bytes at once: the 14 sets of 4 positions in `POSITIONS` are such
that whichever 5 positions two fingerprints share, one of the sets lies within
them. Within a list the shared positional bytes of a pair are tallied, pairs
with fewer than 5 are dropped, and the rest is verified bit by bit.

Fingerprints are distinct before they are indexed, so copies cost nothing. A list
that is still long is split by one more byte at each of its 4 other positions:
a pair needs one more byte in common anyway. What then shares 5 bytes has 24 free
bits, so a list is bounded, and instead of comparing all pairs each member looks
up the 2324 values within 3 bits. A task reports links of a list as a forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_batches, staged, text_bytes, word_chunks
from barloom.llm.components import components

BITS, BYTES, DISTANCE = 64, 8, 3
SHARED = BYTES - DISTANCE
#: Members from which on a list is split by a further byte, or looked up instead of compared.
LONG_LIST = 4096


def _position_sets() -> list[tuple[int, ...]]:
    """14 sets of 4 of 8 positions, one of which lies in any 5 positions."""
    halves = (0, 1, 2, 3), (4, 5, 6, 7)
    matchings = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    mixed = [tuple(sorted((a[0], a[1], b[0] + 4, b[1] + 4))) for m in matchings for a in m for b in m]
    return [*halves, *mixed]


POSITIONS = _position_sets()


def fingerprint(text: bytes, words_in_shingle: int) -> int:
    """SimHash over word shingles, repeats included, unsigned; 0 without words."""
    ones, total, carried = np.zeros(BITS, np.int64), 0, []
    for chunk in word_chunks(text):
        words = carried + chunk
        joined = b" ".join(words)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        hashes = [
            xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, starts[words_in_shingle:], strict=False)
        ]
        if hashes:
            ones += _bit_counts(hashes)
            total += len(hashes)
        carried = words[-(words_in_shingle - 1) :] if words_in_shingle > 1 else []
    if not total and carried:
        ones, total = _bit_counts([xxhash.xxh64_intdigest(b" ".join(carried), 42)]), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def _bit_counts(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, BYTES), axis=1).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (a signed long with the fingerprint's bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(text_bytes(t.as_py()), words_in_shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=[doc_id, "fingerprint"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text), run, f"`{doc_id}` {kind}, fingerprint long")


def _byte(position: int) -> Column:
    return F.shiftright("fingerprint", 8 * (BYTES - 1 - position)).bitwiseAND(F.lit(255))


def _postings(distinct: DataFrame) -> DataFrame:
    """One row for each fingerprint and set of positions; key holds the set and its 4 bytes."""
    keys = []
    for number, positions in enumerate(POSITIONS):
        key = F.lit(number).cast("long")
        for p in positions:
            key = key * 256 + _byte(p)
        keys.append(F.struct(F.lit(number).alias("set"), key.alias("key")))
    return distinct.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("fingerprint", "k.set", "k.key")


def _split(long_lists: DataFrame) -> DataFrame:
    """Postings under a further byte at each position that their set leaves out."""
    parts = []
    for number, positions in enumerate(POSITIONS):
        others = [p for p in range(BYTES) if p not in positions]
        options = [(F.lit(number).cast("long") * 8 + p) for p in others]
        parts.append(F.when(F.col("set") == number, F.array(*[o * 256 + _byte(p) for o, p in zip(options, others, strict=True)])))
    return long_lists.select("fingerprint", F.col("key"), F.explode(F.coalesce(*parts)).alias("further"))


#: All values of 64 bits set in at most 3 places within 24 given places are tried on lists that share 5 bytes.
def _flips(places: list[int]) -> np.ndarray:
    return np.array([sum(1 << p for p in c) for k in range(1, DISTANCE + 1) for c in combinations(places, k)], np.uint64)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars around the least member of each group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes and differ in few enough bits."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
    return (shared >= SHARED) & (np.bitwise_count(x) <= DISTANCE)


def _links(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the lists of sorted keys, as forests."""
    n = len(keys)
    if n < 2:
        return values[:0], values[:0]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[start, n])
    lefts, rights = [], []
    left_in_list = np.repeat(start + length, length) - np.arange(n) - 1
    small = np.repeat(length <= LONG_LIST, length)
    step = 1
    open_ = np.flatnonzero((left_in_list >= step) & small)
    while len(open_):  # the pairs at each distance within all short lists at once
        a, b = values[open_], values[open_ + step]
        ok = _verified(a, b)
        if ok.any():
            lefts.append(a[ok])
            rights.append(b[ok])
        if sum(map(len, lefts)) > 1_000_000:
            a, b = _forest(np.concatenate(lefts), np.concatenate(rights))
            lefts, rights = [a], [b]
        step += 1
        open_ = open_[left_in_list[open_] >= step]
    for s, m in zip(start[length > LONG_LIST].tolist(), length[length > LONG_LIST].tolist(), strict=True):
        a, b = _lookups(np.sort(values[s : s + m]))
        lefts.append(a)
        rights.append(b)
    if not lefts:
        return values[:0], values[:0]
    return _forest(np.concatenate(lefts), np.concatenate(rights))


def _lookups(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a long list whose members differ in few bytes: each looks for all values within 3 bits."""
    varying = int(np.bitwise_or.reduce(members ^ members[0]))
    places = [p for p in range(BITS) if varying >> p & 1]
    lefts, rights = members[:0], members[:0]
    for flip in _flips(places):
        wanted = members ^ flip
        at = np.minimum(np.searchsorted(members, wanted), len(members) - 1)
        hit = (members[at] == wanted) & (members < wanted)
        lefts, rights = np.concatenate([lefts, members[hit]]), np.concatenate([rights, wanted[hit]])
        if len(lefts) > 1_000_000:
            lefts, rights = _forest(lefts, rights)
    return _forest(lefts, rights) if len(lefts) else (lefts, rights)


def _link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: lists are whole except at the end of a batch, where the last one is carried on."""
    keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        a, b = _links(k, v)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        values = np.concatenate([values, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys) and keys[0] != keys[-1]:
            cut = int(np.searchsorted(keys == keys[-1], True))
            yield out(keys[:cut], values[:cut])
            keys, values = keys[cut:], values[cut:]
    yield out(keys, values)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within 3 bits of each other, directly or through others."""
    postings = _postings(distinct)
    counted = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A list of one has no pair. The other lists are few; the long ones fewer still.
    shared = counted.where("n > 1").select("key", (F.col("n") > LONG_LIST).alias("long"))
    found = staged(postings.join(shared, "key"), "postings")
    short = found.where("not long").select("key", "fingerprint")
    # Split lists may still be long, but share 5 bytes: at most 2**24 distinct fingerprints.
    split = _split(found.where("long")).select(F.xxhash64("key", "further").alias("key"), "fingerprint")
    edges = [
        map_batches(part.repartition("key").sortWithinPartitions("key", "fingerprint"), _link_lists, "a long, b long")
        for part in (short, split)
    ]
    return edges[0].unionByName(edges[1])


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words_in_shingle: int = 3
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links of 3 bits.

    Defined results: a null or empty text has fingerprint zero and is linked like
    any other; a text with fewer words than a shingle is one shingle; repeated
    rows are kept and share a component; a null id never names a component
    unless all its members have null ids; an empty table gives no row. Other
    columns aren't read.
    """
    marked = staged(fingerprints(docs, doc_id=doc_id, text=text, words_in_shingle=words_in_shingle), "fingerprints")
    firsts = marked.groupBy("fingerprint").agg(F.min(doc_id).alias("first"))
    groups = components(links(marked.select("fingerprint").distinct()))
    named = firsts.join(groups, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("group")
    )
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    members = named.join(least, "group").select("fingerprint", "component_id")
    return marked.join(members, "fingerprint").select(
        doc_id, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
