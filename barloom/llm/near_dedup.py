"""Near-duplicate removal: one document of each group stays.

Two texts are near if the sets of their five-word shingles have a Jaccard
similarity of at least 0.8. That is counted on the sets themselves; two indexes
only say which pairs to count.

Texts of more than `SURE` shingles are listed by SimHash fingerprints of 1024 bits,
under 128 pairs of neighbouring bytes. At similarity 0.8 about 15 % of the bits differ,
152 with a deviation of 11.5, so `DISTANCE` leaves room, and a pair misses all
lists 4 times in 10,000. Fingerprints of few shingles scatter too much, so texts
of up to `FEW` are listed by the shingles themselves: ordered from rare to frequent,
two near sets meet in the first ones, so no pair is missed.

A first pass over the lists marks texts that have a candidate at all. Only their
shingle sets are written, as mapped arrays, and a second pass over their lists
compares the sets. Pairs that are linked already are skipped, so a group of copies
costs a comparison a member. A list beyond `LONG_LIST` members is cut into
blocks, and every pair of blocks is a task of its own, so a hot list is spread and no
pair is lost. Each task reports its links as a forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import Files, by_shard, mapped, new_files, write
from barloom.llm.common import map_batches, staged, text_bytes, word_chunks
from barloom.llm.components import components

BITS, BYTES, DISTANCE = 1024, 128, 216
#: Shingles up to which texts are listed by shingle, and above which they are listed by fingerprint. A pair of
#: similarity 0.8 lies on one side: if the smaller set has at most SURE shingles, the larger has at most FEW.
FEW, SURE = 80, 64
LONG_LIST = 8192
#: Pairs that are compared at once.
STEP = 200_000
PRINT = np.dtype([("bits", "<u8", (BYTES // 8,)), ("size", "<i8")])
#: Where a set lies among the shingles of its shard.
PLACE = np.dtype([("at", "<i8"), ("size", "<i8")])

_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, BITS // 64, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, words_in_shingle: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles. A text shorter than a shingle is one."""
    found, carried = [], []
    for chunk in word_chunks(text):
        words = carried + chunk
        joined = b" ".join(words)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        hashes = [xxhash.xxh3_64_intdigest(joined[a : b - 1]) for a, b in zip(starts, starts[words_in_shingle:], strict=False)]
        found.append(np.unique(np.array(hashes, np.uint64)))
        carried = words[-(words_in_shingle - 1) :] if words_in_shingle > 1 else []
    if carried and not any(map(len, found)):
        found = [np.array([xxhash.xxh3_64_intdigest(b" ".join(carried))], np.uint64)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(own), 4096):
        x = own[at : at + 4096, None] * _SEEDS
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, BYTES), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(own))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of 0.8 or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))


def _fingerprints(words_in_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, sizes, few = [], [], [], []
            for t in batch.column(2):
                own = shingles(text_bytes(t.as_py()), words_in_shingle)
                ids.append(set_id(own))
                prints.append(wide_fingerprint(own).tobytes() if len(own) > SURE else bytes(BYTES))
                sizes.append(len(own))
                few.append(own.view(np.int64).tolist() if len(own) <= FEW else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.array(ids, np.uint64).view(np.int64)),
                    pa.array(prints, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(few, pa.list_(pa.int64())),
                ],
                names=["id", "text_hash", "hash", "print", "size", "few"],
            )

    return run


def _write_prints(files: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            hashes, data = batch.column(0).to_numpy().view(np.uint64), np.zeros(batch.num_rows, PRINT)
            data["bits"] = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, BYTES // 8)
            data["size"] = batch.column(2).to_numpy()
            for shard, a, b in files.runs(hashes):
                held.setdefault(shard, []).append((hashes[a:b], data[a:b]))
        for shard, parts in held.items():
            write(files.path("print-hash", shard), [h for h, _ in parts])
            write(files.path("print-data", shard), [p for _, p in parts])
        yield pa.RecordBatch.from_arrays([pa.array([len(held)])], names=["n"])

    return run


def _write_wanted(files: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            for shard, a, b in files.runs(hashes):
                held.setdefault(shard, []).append(hashes[a:b])
        for shard, parts in held.items():
            write(files.path("wanted-hash", shard), parts)
            write(files.path("wanted-data", shard), [np.zeros(sum(map(len, parts)), np.uint8)])
        yield pa.RecordBatch.from_arrays([pa.array([len(held)])], names=["n"])

    return run


def _wanted_sets(files: Files, words_in_shingle: int):
    """The shingle sets of the texts that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, _ = mapped(files, "wanted", np.dtype("u1")).find_any(batch.column(0).to_numpy().view(np.uint64))
            for i in np.flatnonzero(there).tolist():
                own = shingles(text_bytes(batch.column(1)[i].as_py()), words_in_shingle)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([set_id(own)], np.uint64).view(np.int64)), pa.array([own.tobytes()], pa.binary())], names=["hash", "set"]
                )

    return run


def _write_sets(files: Files):
    """Rows come by shard, so one shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, n = [], None, 0

        def done() -> None:
            sizes = np.array([len(s) // 8 for _, s in held])
            places = np.rec.fromarrays([np.cumsum(sizes) - sizes, sizes], PLACE)
            write(files.path("set-shingles", last), [np.frombuffer(s, np.uint64) for _, s in held])
            write(files.path("set-hash", last), [np.array([h for h, _ in held], np.uint64)])
            write(files.path("set-data", last), [places])

        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            for shard, a, b in files.runs(hashes):
                if shard != last and held:
                    done()
                    held, n = [], n + 1
                last = shard
                held += zip(hashes[a:b].tolist(), batch.column(1)[a:b].to_pylist(), strict=True)
        if held:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return run


class _Sets:
    """The mapped shingle sets of a task."""

    def __init__(self, files: Files):
        self.files, self.open = files, {}

    def of(self, ids: np.ndarray) -> list[np.ndarray]:
        _, places = mapped(self.files, "set", PLACE).find_any(ids)
        out = []
        for shard, at, size in zip(self.files.shards(ids).tolist(), places["at"].tolist(), places["size"].tolist(), strict=True):
            if shard not in self.open:
                self.open[shard] = np.memmap(self.files.path("set-shingles", shard), np.uint64, "r")
            out.append(self.open[shard][at : at + size])
        return out


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of fingerprints; their keys are positive."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BYTES).astype(np.int64)
        keys = (np.arange(BYTES) << 16) + (prints << 8) + np.roll(prints, -1, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, BYTES))], names=["key", "id"])


_SIGN = -(1 << 63)


def _few_postings(distinct: DataFrame) -> DataFrame:
    """Lists of shingles; their keys are negative. Near sets share one of their rarest shingles."""
    each = distinct.where("few is not null").select(F.col("hash").alias("id"), F.explode("few").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rare_first = each.join(often, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    size = F.size("all")
    met = rare_first.select("id", F.explode(F.slice("all", F.lit(1), (size - F.ceil(size * 4 / 5) + 1).cast("int"))).alias("x"))
    return met.where("x.n > 1").select(F.col("x.shingle").bitwiseOR(F.lit(_SIGN)).alias("key"), "id").distinct()


def _candidates(lists: np.ndarray, prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs may be near by their sizes and, in lists of fingerprints, by their bits."""
    m, n = prints["size"][a], prints["size"][b]
    ok = np.flatnonzero(5 * np.minimum(m, n) >= 4 * np.maximum(m, n))
    bits, by_print = prints["bits"], lists[a[ok]] >= 0
    close = ~by_print
    x, y = a[ok[by_print]], b[ok[by_print]]
    close[by_print] = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int32) <= DISTANCE
    return ok[close]


def _pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of the given sizes, about STEP at a time."""
    end = np.repeat(np.cumsum(sizes), sizes)
    later = end - np.arange(len(end)) - 1
    at, total = 0, np.concatenate([[0], np.cumsum(later)])
    while at < len(end):
        to = max(at + 1, int(np.searchsorted(total, total[at] + STEP, "right")) - 1)
        n = later[at:to]
        left = np.repeat(np.arange(at, to), n)
        yield left, left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _by_list(files: Files, work: Callable[..., pa.RecordBatch]):
    """Rows come by list. Columns: list, id and, within a cut list, the member's block if blocks differ.

    Calls work(lists, ids, prints, pairs) with whole lists of more than one member.
    """

    def done(lists: np.ndarray, ids: np.ndarray, sides: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        sizes = np.diff(np.r_[start, len(lists)])
        keep = np.repeat(sizes > 1, sizes)
        lists, ids, sides, sizes = lists[keep], ids[keep], sides[keep], sizes[sizes > 1]
        if not len(ids):
            return
        _, prints = mapped(files, "print", PRINT).find_any(ids)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in _pairs(sizes):
                across = (sides[a] != sides[b]) | (sides[a] < 0)
                yield a[across], b[across]

        yield work(lists, ids, prints, pairs())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            new = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            cut = int(np.searchsorted(held[0] == held[0][-1], True)) if len(held[0]) else 0
            if cut:
                yield from done(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if len(held[0]):
            yield from done(*held)

    return run


def _mark(files: Files):
    """The ids that have a candidate."""

    def work(lists: np.ndarray, ids: np.ndarray, prints: np.ndarray, pairs: Iterator) -> pa.RecordBatch:
        _, node = np.unique(ids, return_inverse=True)
        marked = np.zeros(len(ids), bool)  # by node
        for a, b in pairs:
            new = ~(marked[node[a]] & marked[node[b]])
            a, b = a[new], b[new]
            ok = _candidates(lists, prints, a, b)
            marked[node[a[ok]]] = marked[node[b[ok]]] = True
        return pa.RecordBatch.from_arrays([pa.array(np.unique(ids[marked[node]]).view(np.int64))], names=["id"])

    return _by_list(files, work)


def _link(files: Files):
    """Links (a, b) between near texts, as forests: each is verified on the shingle sets."""
    sets = _Sets(files)

    def work(lists: np.ndarray, ids: np.ndarray, prints: np.ndarray, pairs: Iterator) -> pa.RecordBatch:
        nodes, node = np.unique(ids, return_inverse=True)
        label = np.arange(len(nodes))
        found: tuple[list, list] = [], []

        def root(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for a, b in pairs:
            a, b, on = node[a], node[b], (a, b)
            apart = label[a] != label[b]
            on = on[0][apart], on[1][apart]
            ok = _candidates(lists, prints, *on)
            x, y = node[on[0][ok]], node[on[1][ok]]
            for at in range(0, len(x), 2000):
                p, q = x[at : at + 2000], y[at : at + 2000]
                open_ = label[p] != label[q]
                p, q = p[open_], q[open_]
                need, place = np.unique(np.concatenate([p, q]), return_inverse=True)
                own = sets.of(nodes[need])
                for u, v, s, t in zip(p.tolist(), q.tolist(), place[: len(p)].tolist(), place[len(p) :].tolist(), strict=True):
                    g, h = root(u), root(v)
                    if g != h and near(own[s], own[t]):
                        label[max(g, h)] = min(g, h)
                        found[0].append(u)
                        found[1].append(v)
                while not np.array_equal(flat := label[label], label):
                    label[:] = flat
        a, b = (nodes[np.array(x, np.int64)].view(np.int64) for x in found)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return _by_list(files, work)


def _lists(postings: DataFrame, long_list: int) -> DataFrame:
    """list, id, side. A list that is too long becomes one list for each pair of its blocks."""
    counts = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / long_list).cast("int")
    cut = postings.join(counts.select("key", blocks.alias("blocks")), "key")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    block_pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    whole = cut.where("blocks = 1").select(F.col("key").alias("list"), "id", F.lit(-1).cast("long").alias("side"))
    pairs = (
        cut.where("blocks > 1")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.when(F.col("key") < 0, block_pair.bitwiseOR(F.lit(_SIGN))).otherwise(block_pair.bitwiseAND(F.lit(~_SIGN))).alias("list"),
            "id",
            # Within one block all pairs count; across two only those of different blocks.
            F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).cast("long").alias("side"),
        )
    )
    return whole.unionByName(pairs)


def groups(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words_in_shingle: int = 5, long_list: int = LONG_LIST
) -> DataFrame:
    """id, text_hash and keeper, the id that stays of the row's group."""
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    columns = f"id {kind}, text_hash long, hash long, print binary, size long, few array<long>"
    marked = staged(map_batches(source, _fingerprints(words_in_shingle), columns), "prints")
    one = F.first(F.struct("print", "size", "few")).alias("x")
    distinct = staged(marked.groupBy("hash").agg(one).select("hash", "x.*"), "distinct")
    files = new_files(marked, "prints")

    def finish(frame: DataFrame, run) -> None:
        map_batches(frame, run, "n long").agg(F.sum("n")).first()

    def lists(postings: DataFrame) -> DataFrame:
        return _lists(postings, long_list).repartition("list").sortWithinPartitions("list")

    finish(by_shard(distinct.select("hash", "print", "size"), files.bits), _write_prints(files))
    by_print = map_batches(distinct.where(F.col("size") > SURE).select("hash", "print"), _postings, "key long, id long")
    postings = staged(by_print.unionByName(_few_postings(distinct)), "postings")
    candidates = staged(map_batches(lists(postings), _mark(files), "id long").distinct(), "candidates")

    wanted = marked.join(candidates.withColumnRenamed("id", "hash"), "hash").groupBy("hash").agg(F.min("text_hash").alias("text_hash"))
    finish(by_shard(wanted.select(F.col("text_hash").alias("hash")).distinct(), files.bits), _write_wanted(files))
    sets = map_batches(source.select("text_hash", "text"), _wanted_sets(files, words_in_shingle), "hash long, set binary")
    finish(by_shard(sets.groupBy("hash").agg(F.first("set").alias("set")), files.bits), _write_sets(files))

    some = staged(postings.join(candidates, "id", "left_semi").select("key", "id"), "postings")
    linked = components(map_batches(lists(some), _link(files), "a long, b long"))
    named = marked.select("id", "text_hash", "hash").join(linked.withColumnRenamed("node", "hash"), "hash", "left")
    named = named.withColumn("group", F.coalesce("component", "hash"))
    keepers = named.groupBy("group").agg(F.min("id").alias("keeper"))
    return named.join(keepers, "group").select("id", "text_hash", "keeper")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words_in_shingle: int = 5) -> DataFrame:
    """The documents with the least id of their group of near-duplicates, all columns.

    Defined results: texts without words are copies of one another; a text shorter
    than a shingle is one shingle; of rows with the same id and text one stays; a null id stays
    only if its group has no other. An empty table gives no row.
    """
    decided = staged(groups(docs, doc_id=doc_id, text=text, words_in_shingle=words_in_shingle), "decided")
    first = F.col("id").eqNullSafe(F.col("keeper"))
    gone = decided.where(~first).select("id", "text_hash").distinct()
    repeated = staged(decided.where(first).groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")

    def same(other: DataFrame) -> Column:
        return docs[doc_id].eqNullSafe(other["id"]) & (F.xxhash64(docs[text]) == other["text_hash"])

    kept = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return kept
    alone = kept.join(repeated, same(repeated), "left_anti")
    # The copies of a row are reduced in the map tasks first, however many there are.
    row = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    copies = kept.join(repeated, same(repeated), "left_semi")
    once = copies.groupBy(F.col(f"`{doc_id}`").alias("one"), F.xxhash64(text).alias("text_hash")).agg(row)
    return alone.unionByName(once.select("row.*"))
