"""Removal of repeated byte strings with suffix arrays built column by column.

Every window of `WINDOW` bytes that starts earlier elsewhere is found, in five steps
that each read the texts once or less:

1. A window's key is the least hash of its pieces of `PIECE` bytes. Equal windows
   have equal keys, and windows side by side mostly share one, so a text becomes
   a chain of segments: runs of windows of one key. Keys that occur once are done with.
2. Equal segments are one string with many places; the first place keeps its bytes.
   This is counted in the map tasks first, so copies don't gather anywhere.
3. Different segments of one key are the strings that may share windows. They meet
   in a task, and `bwt.build` makes the transform and common prefixes of a batch
   of them. Suffixes that share a whole window form a class; its first place stays.
4. The removed stretches of each document are gathered.
5. A last pass over the texts reads what applies to each segment and document.

Between the steps lie sorted arrays in the shared folder, which workers map. No
text is shuffled but that of the segments of step 3.

A key with very many different segments (`HOT` or more) isn't put into one batch:
its windows are compared one by one, as strings of their own: equal ones by 128 bits of
hash. Their first places are reduced in the map tasks and looked up by every place, so
a window that very many texts hold gathers nowhere.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import bwt
from barloom.llm.arrays import Files, by_shard, mapped, new_files, write
from barloom.llm.common import map_batches, staged, text_bytes

WINDOW, PIECE = 100, 50
#: Windows of a segment at most: as many as can share one piece. Longer runs, as in periodic text, are cut.
LONGEST = WINDOW - PIECE + 1
#: Bytes of a text that are looked at together, windows across the end included.
CHUNK = 1 << 18
#: Bytes of strings of one construction.
BATCH = 2_000_000
#: Different segments of a key from which on its windows are dealt out one by one.
HOT = 20_000
#: Places that a map task holds before it hands on the first ones.
HELD = 500_000
#: Segments that are looked up together.
LOOKED_UP = 100_000

FIRST = np.dtype([("doc", "<i8"), ("start", "<i8"), ("kind", "<i8")])
#: First place of a window with the second half of its hash.
PLACE = np.dtype([("check", "<i8"), ("doc", "<i8"), ("start", "<i8")])
SPAN = np.dtype([("start", "<i8"), ("end", "<i8")])
#: What is to be done with a segment beyond its copies: nothing, a batch, or window by window.
ALONE, SHARED, CROWDED = 0, 1, 2

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for base in (_BASE, inverse):
            table = np.full(CHUNK + WINDOW, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return tuple(_powers)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_keys(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window, which is the least of its pieces' hashes, and these, which depend on their bytes only."""
    up, down = _power_tables()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
    pieces = _mixed((sums[PIECE:] - sums[:-PIECE]) * down[: len(part) - PIECE + 1])
    return _sliding(np.minimum, pieces), pieces


def _sliding(best, x: np.ndarray) -> np.ndarray:
    """best() of every LONGEST neighbours: the pieces of a window, or the windows around a piece."""
    width = 1
    while 2 * width <= LONGEST:
        x = best(x[:-width], x[width:])
        width *= 2
    rest = LONGEST - width
    return best(x[:-rest], x[rest:]) if rest else x


def _inner(least: np.ndarray, pieces: np.ndarray, edge: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a segment's key occurs twice inside it: only then can it repeat a window of its own.

    A piece is the least of some window exactly if it equals the greatest key of the windows around
    it. There is about one such piece for a segment, so few are compared with the key.
    """
    none = np.zeros(LONGEST - 1, np.uint64)
    chosen = _sliding(np.maximum, np.concatenate([none, least, none])) == pieces
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(chosen)])
    a, n = before[edge], before[edge + length + LONGEST - 1] - before[edge]
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(a - first, n)
    values = pieces[chosen]
    return np.add.reduceat((values[at] == np.repeat(least[edge], n)).astype(np.int64), first) > 1 if len(edge) else np.zeros(0, bool)


def _cut(least: np.ndarray, pieces: np.ndarray, edge: np.ndarray, length: np.ndarray, inner: bool) -> tuple[np.ndarray, ...]:
    """(key, first window, windows) of runs of one least hash, those longer than LONGEST cut; if asked, also _inner."""
    parts = -(-length // LONGEST)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(length, parts) - nth * LONGEST
        edge, length = np.repeat(edge, parts) + nth * LONGEST, np.minimum(left, LONGEST)
    # The least of many hashes is nearly always small: mixed once more (no two keys merge), its top bits deal evenly.
    found = (_mixed(least[edge] * _BASE), edge, length)
    return (*found, _inner(least, pieces, edge, length)) if inner else found


def _none(inner: bool) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    return (none.astype(np.uint64), none, none, none.astype(bool))[: 3 + inner]


def segments(text: bytes, inner: bool = False) -> tuple[np.ndarray, ...]:
    """(key, first window, windows) of the segments of a text; every window lies in one of them. If asked, also _inner."""
    out = []
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - WINDOW + 1), CHUNK):
        part = data[at : at + CHUNK + WINDOW - 1]
        if len(part) < WINDOW:
            break
        least, pieces = window_keys(part)
        edge = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        keys, starts, *rest = _cut(least, pieces, edge, np.diff(np.r_[edge, len(least)]), inner)
        out.append((keys, starts + at, *rest))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _none(inner)


def segments_of(texts: list[bytes], inner: bool = False) -> list[tuple[np.ndarray, ...]]:
    """segments() of each text. Short texts are hashed as one string, which costs far fewer steps; their windows don't mix."""
    out: list[tuple[np.ndarray, ...] | None] = [None if len(t) >= WINDOW else _none(inner) for t in texts]
    held: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if out[i] is not None:
            continue
        if len(text) > CHUNK // 4:
            out[i] = segments(text, inner)
            continue
        if size + len(text) > CHUNK:
            _together(texts, held, inner, out)
            held, size = [], 0
        held.append(i)
        size += len(text)
    _together(texts, held, inner, out)
    return out


def _together(texts: list[bytes], numbers: list[int], inner: bool, out: list) -> None:
    if not numbers:
        return
    lengths = np.array([len(texts[i]) for i in numbers])
    begin = np.cumsum(lengths) - lengths
    least, pieces = window_keys(np.frombuffer(b"".join(texts[i] for i in numbers), np.uint8))
    # An edge also lies at each text's first window, and behind its last one, where no segment begins.
    change = np.r_[True, least[1:] != least[:-1], True]
    behind = begin + lengths - WINDOW + 1
    change[begin] = change[behind] = True
    edge = np.flatnonzero(change)
    length = np.diff(edge)
    text = np.searchsorted(begin, edge[:-1], "right") - 1
    real = edge[:-1] < behind[text]
    keys, starts, *rest = _cut(least, pieces, edge[:-1][real], length[real], inner)
    text = np.searchsorted(begin, starts, "right") - 1
    cuts = np.searchsorted(text, np.arange(1, len(numbers)))
    columns = [np.split(x, cuts) for x in (keys, starts - begin[text], *rest)]
    for i, *own in zip(numbers, *columns, strict=True):
        out[i] = tuple(own)


def segment_ids(text: bytes, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit ids of the segments' bytes; the top 20 bits are the key's, so they share its shard."""
    ids = np.fromiter(
        (xxhash.xxh3_64_intdigest(text[s : s + n + WINDOW - 1]) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)),
        np.uint64,
        len(starts),
    )
    return (keys & np.uint64(0xFFFFF << 44)) | (ids >> np.uint64(20))


def _ids_of(batch: pa.RecordBatch) -> np.ndarray:
    """Document ids as longs; null is the least."""
    return batch.column(0).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _groups(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch, about LOOKED_UP segments at a time."""
    held, size = [], 0
    for value in column:
        text = text_bytes(value.as_py())
        held.append(text)
        size += len(text)
        if size >= LOOKED_UP * LONGEST // 2:
            yield held
            held, size = [], 0
    if held:
        yield held


# Step 1: keys that occur more than once.


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for texts in _groups(batch.column(1)):
            for keys, _, _, twice in segments_of(texts, inner=True):
                held += [keys, keys[twice]]
                size += len(keys)
            if size >= HELD:
                yield _key_counts(held)
                held, size = [], 0
    if held:
        yield _key_counts(held)


def _key_counts(held: list[np.ndarray]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    return _batch(hash=keys, n=np.minimum(n, 2).astype(np.int8))


def _write_repeated(files: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        last, last_n, total = None, 0, 0

        def add(keys: np.ndarray) -> None:
            nonlocal total
            total += len(keys)
            for shard, a, b in files.runs(keys):
                held.setdefault(shard, []).append(keys[a:b])

        for batch in batches:
            keys, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.int64)
            if not len(keys):
                continue
            if last is not None:
                keys, n = np.concatenate([[last], keys]), np.concatenate([[last_n], n])
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, n = keys[start], np.add.reduceat(n, start)
            last, last_n = keys[-1], n[-1]
            add(keys[:-1][n[:-1] > 1])
        if last is not None and last_n > 1:
            add(np.array([last], np.uint64))
        for shard, parts in held.items():
            write(files.path("repeated-hash", shard), parts)
            write(files.path("repeated-data", shard), [np.zeros(sum(map(len, parts)), np.uint8)])
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    return run


@dataclass(frozen=True)
class Segments:
    """Segments of one text whose keys occur again somewhere, and, if asked for, what is known of each."""

    doc: int
    text: bytes
    keys: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    twice: np.ndarray
    ids: np.ndarray
    first: np.ndarray


def _repeated(files: Files, batch: pa.RecordBatch, inner: bool = False, first: bool = False) -> Iterator[Segments]:
    """The repeated segments of every text of a batch. Lookups are made for many texts together."""
    docs = iter(_ids_of(batch).tolist())
    for texts in _groups(batch.column(1)):
        held = [(next(docs), t, own if inner else (*own, None)) for t, own in zip(texts, segments_of(texts, inner), strict=True)]
        keys = np.concatenate([x[2][0] for x in held])
        there, _ = mapped(files, "repeated", np.dtype("u1")).find_any(keys)
        chosen = []
        for (doc, text, (k, s, n, twice)), mask in zip(held, np.split(there, np.cumsum([len(x[2][0]) for x in held])[:-1]), strict=True):
            k, s, n = k[mask], s[mask], n[mask]
            chosen.append((doc, text, k, s, n, twice[mask] if inner else None, segment_ids(text, k, s, n)))
        ids = np.concatenate([x[6] for x in chosen])
        known = mapped(files, "first", FIRST).find_any(ids)[1] if first else ids
        ends = np.cumsum([len(x[6]) for x in chosen])[:-1]
        for one, own in zip(chosen, np.split(known, ends), strict=True):
            yield Segments(*one, own)


# Step 2: the first place of each segment, and which segments have company.


def _first_places(files: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in _repeated(files, batch):
                held.append((x.keys, x.ids, np.full(len(x.keys), x.doc), x.starts))
                size += len(x.keys)
                if size >= HELD:
                    yield _firsts(held)
                    held, size = [], 0
        if held:
            yield _firsts(held)

    return run


def _firsts(held: list[tuple]) -> pa.RecordBatch:
    """The first place of each segment among those held."""
    keys, ids, docs, starts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((starts, docs, ids))
    keys, ids, docs, starts = keys[order], ids[order], docs[order], starts[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
    return _batch(hash=keys[first], id=ids[first], doc=docs[first], start=starts[first].astype(np.int64))


def _write_firsts(files: Files, hot: int):
    """Rows come by key, id and place. Writes each segment's first place and kind, sorted by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            keys, ids, docs, starts = (batch.column(i).to_numpy() for i in range(4))
            keys, ids = keys.view(np.uint64), ids.view(np.uint64)
            first = np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])] if len(keys) else np.zeros(0, bool)
            keys, ids, docs, starts = keys[first], ids[first], docs[first], starts[first]
            for shard, a, b in files.runs(keys):
                held.setdefault(shard, []).append((keys[a:b], ids[a:b], docs[a:b], starts[a:b]))
        for shard, parts in held.items():
            keys, ids, docs, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
            first = np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]  # a segment may span two batches
            keys, ids, docs, starts = keys[first], ids[first], docs[first], starts[first]
            edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            alike = np.diff(np.r_[edge, len(keys)])
            kind = np.repeat(np.select([alike == 1, alike < hot], [ALONE, SHARED], CROWDED), alike)
            order = np.argsort(ids, kind="stable")
            write(files.path("first-hash", shard), [ids[order]])
            write(files.path("first-data", shard), [np.rec.fromarrays([docs[order], starts[order], kind[order]], FIRST)])
        yield pa.RecordBatch.from_arrays([pa.array([len(held)])], names=["n"])

    return run


# Step 3: windows that different segments share.


def _strings(files: Files):
    """The segments that have company, at their first places; those of crowded keys as hashes of single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [])
            for seg in _repeated(files, batch, inner=True, first=True):
                doc, text, first = seg.doc, seg.text, seg.first
                own = (seg.twice | (first["kind"] != ALONE)) & (first["doc"] == doc) & (first["start"] == seg.starts)
                for i in np.flatnonzero(own).tolist():
                    s, n = int(seg.starts[i]), int(seg.counts[i])
                    if first["kind"][i] != CROWDED:
                        rows = [(int(seg.keys[i]), s, text[s : s + n + WINDOW - 1], 0)]
                    else:
                        windows = ((at, xxhash.xxh3_128_intdigest(text[at : at + WINDOW], 1)) for at in range(s, s + n))
                        rows = [(x >> 64, at, None, x & (1 << 64) - 1) for at, x in windows]
                    for h, at, x, check in rows:
                        out[0].append(h)
                        out[1].append(doc)
                        out[2].append(at)
                        out[3].append(x)
                        out[4].append(check)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(out[0], np.uint64).view(np.int64)),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.binary()),
                    pa.array(np.array(out[4], np.uint64).view(np.int64)),
                ],
                names=["hash", "doc", "start", "bytes", "check"],
            )

    return run


def repeated_windows(strings: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of windows that have an earlier place among the strings, found by their suffix array."""
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        _, lcp, string, at = bwt.build(strings, Path(folder), WINDOW)
    class_ = np.cumsum(lcp < WINDOW)
    alone = np.r_[lcp < WINDOW, True]
    shared = ~(alone[:-1] & alone[1:])
    class_, doc, start = class_[shared], docs[string[shared]], starts[string[shared]] + at[shared]
    order = np.lexsort((start, doc, class_))
    class_, doc, start = class_[order], doc[order], start[order]
    head = np.r_[True, class_[1:] != class_[:-1]] if len(class_) else np.zeros(0, bool)
    leader = np.flatnonzero(head)[np.cumsum(head) - 1] if len(class_) else np.zeros(0, int)
    later = (doc != doc[leader]) | (start != start[leader])
    return doc[later], start[later]


def _spans(docs: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Windows as stretches of bytes, joined where they touch."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    head = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + WINDOW)]) if len(docs) else np.zeros(0, int)
    tail = np.r_[head[1:], len(docs)] - 1 if len(docs) else head
    return _batch(doc=docs[head].astype(np.int64), start=starts[head].astype(np.int64), end=(starts[tail] + WINDOW).astype(np.int64))


def _construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key. Batches of whole keys go through the construction."""
    held: list[tuple[int, int, int, bytes]] = []
    size, last = 0, None

    def done() -> pa.RecordBatch:
        _, docs, starts, strings = zip(*held, strict=True)
        return _spans(*repeated_windows(list(strings), np.array(docs), np.array(starts)))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BATCH and row[0] != last:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
            last = row[0]
    if held:
        yield done()


def _write_windows(files: Files):
    """Rows come by hash: the first places of windows that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            data = np.rec.fromarrays([batch.column(i).to_numpy() for i in (1, 2, 3)], PLACE)
            for shard, a, b in files.runs(hashes):
                held.setdefault(shard, []).append((hashes[a:b], data[a:b]))
        for shard, parts in held.items():
            write(files.path("window-hash", shard), [h for h, _ in parts])
            write(files.path("window-data", shard), [d for _, d in parts])
        yield pa.RecordBatch.from_arrays([pa.array([len(held)])], names=["n"])

    return run


def _later_windows(files: Files):
    """Stretches of the windows that have an earlier place. Rows are looked up where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, check, docs, starts = (batch.column(i).to_numpy() for i in range(4))
            there, first = mapped(files, "window", PLACE).find_any(hashes.view(np.uint64))
            later = there & (first["check"] == check) & ((first["doc"] != docs) | (first["start"] != starts))
            yield _spans(docs[later], starts[later])

    return run


# Steps 4 and 5: what goes of each document.


def doc_hash(ids: np.ndarray) -> np.ndarray:
    return _mixed(ids.view(np.uint64) * _BASE + np.uint64(1))


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column(0).to_numpy()
        yield _batch(hash=doc_hash(docs), doc=docs, start=batch.column(1).to_numpy(), end=batch.column(2).to_numpy())


def _write_spans(files: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            data = np.rec.fromarrays([batch.column(2).to_numpy(), batch.column(3).to_numpy()], SPAN)
            for shard, a, b in files.runs(hashes):
                held.setdefault(shard, []).append((hashes[a:b], data[a:b]))
        for shard, parts in held.items():
            write(files.path("span-hash", shard), [h for h, _ in parts])
            write(files.path("span-data", shard), [d for _, d in parts])
        yield pa.RecordBatch.from_arrays([pa.array([len(held)])], names=["n"])

    return run


def removed(files: Files, seg: Segments) -> list[tuple[int, int]]:
    """Maximal stretches of a text's bytes that go."""
    if not len(seg.keys):
        return []
    doc, first, starts = seg.doc, seg.first, seg.starts
    later = (first["doc"] < doc) | (first["doc"] == doc) & (first["start"] < starts)
    ends = starts[later] + seg.counts[later] + WINDOW - 1
    stretches = list(zip(starts[later].tolist(), ends.tolist(), strict=True))
    own = doc_hash(np.array([doc], np.int64))
    hashes, data = mapped(files, "span", SPAN).of(int(files.shards(own)[0]))
    a, b = np.searchsorted(hashes, own[0], "left"), np.searchsorted(hashes, own[0], "right")
    stretches += [(int(x["start"]), int(x["end"])) for x in data[a:b]]
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _results(files: Files, keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for seg in _repeated(files, batch, first=True):
                text, spans, kept, at = seg.text, removed(files, seg), [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out[0].append(len(text))
                out[1].append([{"start": a, "end": b} for a, b in spans])
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(kept)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array(x, kind) for x, kind in zip(out[:3], (pa.int64(), span, pa.string()), strict=True)]
            names = ["id", "n_bytes", "removed", "kept_sha256"]
            if keep_bytes:
                columns.append(pa.array(out[3], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, removed (byte ranges), kept_sha256 and, if asked for, kept (the bytes that stay).

    A byte goes if it lies in `WINDOW` equal bytes that also start earlier: in a
    document of smaller id, or further up in the same one. Defined results: a null
    text counts as empty; texts shorter than a window keep all; ids are integers,
    null ids come first; rows with equal ids are the same place in the order, so a
    row repeated whole doesn't remove itself; an empty table gives no row. Other
    columns aren't read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    files = new_files(docs, "suffix-dedup")
    bits = files.bits

    def finish(frame: DataFrame, run) -> None:
        map_batches(frame, run, "n long").agg(F.sum("n")).first()

    finish(by_shard(map_batches(source, _count_keys, "hash long, n tinyint"), bits), _write_repeated(files))
    places = map_batches(source, _first_places(files), "hash long, id long, doc long, start long")
    first = F.min(F.struct("doc", "start")).alias("first")
    places = places.groupBy("hash", "id").agg(first).select("hash", "id", "first.doc", "first.start")
    finish(by_shard(places, bits, "id", "doc", "start"), _write_firsts(files, hot))
    strings = staged(map_batches(source, _strings(files), "hash long, doc long, start long, bytes binary, check long"), "strings")
    segment_strings = strings.where("bytes is not null").drop("check")
    windows = strings.where("bytes is null").select("hash", "check", "doc", "start")
    repeated = windows.groupBy("hash", "check").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    finish(by_shard(repeated.select("hash", "check", "first.doc", "first.start"), bits), _write_windows(files))
    span = "doc long, start long, end long"
    spans = map_batches(by_shard(segment_strings, bits, "doc", "start"), _construct, span).unionByName(
        map_batches(windows, _later_windows(files), span)
    )
    finish(by_shard(map_batches(spans, _with_hash, "hash long, doc long, start long, end long"), bits), _write_spans(files))
    result = f"id {kind}, n_bytes long, removed array<struct<start: long, end: long>>, kept_sha256 string" + ", kept binary" * keep_bytes
    return map_batches(source, _results(files, keep_bytes), result).withColumnRenamed("id", doc_id)


def digest(result: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    lengths = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return result.select(doc_id, "n_bytes", lengths.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
