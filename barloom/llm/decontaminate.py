"""Benchmark decontamination with an Aho-Corasick automaton.

The windows of all benchmark items (10 consecutive normalised words, or the
whole item if it has fewer) become the patterns of one automaton, and every
normalised document is scanned once. Matches are mapped back to words and to
byte ranges of the original text.

The automaton goes to the workers as a broadcast of at most `BLOCK_BYTES` of
patterns. A benchmark beyond that is cut by a hash into more automata, which
are applied to a batch of documents in turn; a worker keeps one in memory at a
time, and results are the same.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER_BYTES, map_batches, text_bytes

WINDOW = 10
#: Pattern bytes of one automaton, which takes about 60 times that in memory.
BLOCK_BYTES = 4_000_000
#: Bytes of texts whose words are held at a time.
HELD_BYTES = 2_000_000
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A-Z lowered; whatever is no letter, digit or part of a longer UTF-8 sequence becomes a space.
NORMAL = bytes(
    b if chr(b).isalnum() and b < 128 or b > 127 else 32 for b in (LOWER_BYTES[i] for i in range(256))
)
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"

#: The automaton that this worker used last, by name.
_last: dict[str, ahocorasick.Automaton] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """pattern (space-joined words, a space at either end) and the sorted ids of its items."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lowered, F.lit(f"({WORD_PATTERN})"), F.lit(1))
    last = F.greatest(F.size("w") - WINDOW + 1, F.lit(1))
    return (
        benchmark.where(F.col(text).isNotNull() & F.col(item_id).isNotNull())
        .select(F.col(item_id).cast("string").alias("item"), found.alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, WINDOW))).alias("w"))
        .groupBy(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("pattern"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _automaton(name: str, patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    if name not in _last:
        _last.clear()
        made = ahocorasick.Automaton()
        for pattern, items in patterns:
            made.add_word(pattern.encode().decode("latin-1"), (pattern.count(" ") - 1, items))
        made.make_automaton()
        _last[name] = made
    return _last[name]


class Scan:
    """What is known of one text: its words, and which words and items the automata have hit."""

    def __init__(self, text: bytes):
        self.text = text
        self.words = words(text)
        self.joined = b" " + b" ".join(self.words) + b" " if self.words else b""
        self.ends: list[int] | None = None
        self.runs: list[tuple[int, int]] = []
        self.items: set[str] = set()

    def apply(self, automaton: ahocorasick.Automaton) -> None:
        for at, (length, items) in automaton.iter(self.joined.decode("latin-1")):
            if self.ends is None:  # ends[i]: place of the space behind word i
                self.ends, place = [], 0
                for w in self.words:
                    place += len(w) + 1
                    self.ends.append(place)
            last = bisect.bisect_left(self.ends, at)
            self.runs.append((last - length + 1, last + 1))
            self.items.update(items)

    def merged(self) -> list[tuple[int, int]]:
        """Maximal runs of hit words."""
        out: list[tuple[int, int]] = []
        for start, end in sorted(self.runs):
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
        return out

    def result(self) -> tuple[int, int, list[str], list[dict]]:
        runs = self.merged()
        spans = []
        if runs:
            places = [m.span() for m in WORD_BYTES.finditer(self.text)]
            spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in runs]
        return len(self.words), sum(b - a for a, b in runs), sorted(self.items), spans


def scan(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document: its id, n_words, n_hit, items and spans.

    items holds the ids of items with a window in the document, sorted as
    strings; spans are byte ranges of the original text, one for each maximal
    run of hit words. Defined results: a null or empty text has no words and no
    hits; null ids and repeated rows are kept as they come; items with a null
    id or text or without words have no window; items that share a window all
    count; an empty benchmark hits nothing. Other columns of `docs` aren't read.
    """
    apply = _scanner(benchmark, item_id, item_text, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*(s.result() for s in apply(batch.column(1))), strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [pa.array(x, kind) for x, kind in zip(got, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[doc_id, "n_words", "n_hit", "items", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text), run, f"`{doc_id}` {kind}, {RESULT}")


def _scanner(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """A function that scans the texts of a batch; its automata are broadcast here."""
    spark = benchmark.sparkSession
    patterns = windows(benchmark, item_id, item_text)
    size = patterns.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("pattern"), F.lit(count))
    shared = [
        (f"{uuid.uuid4()}", spark.sparkContext.broadcast([(r[0], list(r[1])) for r in patterns.where(block == b).toLocalIterator()]))
        for b in range(count)
    ]

    def scanned(scans: list[Scan]) -> list[Scan]:
        for name, part in shared:
            if part.value:
                automaton = _automaton(name, part.value)
                for s in scans:
                    if s.joined:
                        s.apply(automaton)
        return scans

    def apply(texts: pa.Array) -> Iterator[Scan]:
        held, size = [], 0
        for t in texts:
            held.append(Scan(text_bytes(t.as_py())))
            size += len(held[-1].text)
            if size >= HELD_BYTES:
                yield from scanned(held)
                held, size = [], 0
        yield from scanned(held)

    return apply


def clean(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents without any hit, with all their columns, in one pass. Edge cases as in `scan`."""
    apply = _scanner(benchmark, item_id, item_text, block_bytes)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not s.runs for s in apply(batch.column(place))], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return scanned.select(
        doc_id,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
