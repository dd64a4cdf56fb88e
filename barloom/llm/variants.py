"""Grouping of spelling variants with a bit-sliced position index.

Two words are near if one inserted, deleted or replaced code point turns one into the other.

1. Words and their counts come from whole texts by built-in functions; copies are counted in the
   map tasks first.
2. Two near words, of which the shorter has M code points, agree in their first or in their last
   M // 2: one error can't touch both. So each word goes into the buckets (M, first half) and (M, last half)
   for M = its own length and one less, and near words meet in one of them.
3. Within a bucket, a bitset for every (position, letter) says which words have that letter there.
   A word runs over the bitsets letter by letter. Four sets advance in step: the words that agree so
   far, and those with one replacement (same positions), one letter more (positions one later) or one letter less
   (positions one earlier). One machine word steps 64 candidates at once, and the search ends as soon
   as no candidate is left.
4. A bucket of very many words is cut into blocks of bounded size; each block has its own
   bitsets, and the bucket's words run over all of them. No pair is emitted: a word gives one row per
   block, with the number of its near words and the best of them.

A word's form is its most frequent near word if that is `ratio` times as frequent; its root follows
forms to the last. As counts grow by the ratio at each step, a chain has at most
log(largest count) steps, and pointers that double reach its end in the logarithm of that.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii, map_batches, staged

#: Fixed values of the definition.
RUN = r"[A-Za-zÀ-ÿ]+"
SHORTEST, RATIO, DAMAGE = 7, 10, 31
#: Words of a block, and bits of its index: positions times letters times words.
BLOCK, INDEX_BITS, LETTERS = 1 << 16, 1 << 29, 90
#: Rows that leave a task together.
ROWS = 8192


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one code point if DAMAGE divides its hash: a rule-made typing error."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % DAMAGE == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = 2) -> DataFrame:
    """word and n: the distinct words of at least `shortest` code points that occur `least` times."""
    runs = docs.select(F.col(doc_id).alias("doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    # Damage only shortens a run, so shorter ones can go before it.
    words = runs.where(F.length("run") >= shortest).select(damaged(F.col("doc"), lower_ascii(F.col("run"))).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def block_size(m: int, block: int = BLOCK) -> int:
    """Words of a block of the bucket (m, ...), such that its index keeps its size however long the words are."""
    return max(1, min(block, INDEX_BITS // ((m + 1) * LETTERS)))


def dealt(words: DataFrame, shortest: int, block: int) -> DataFrame:
    """Every word in each of its buckets' blocks: a member of one (role 0), a query to the others (role 1)."""
    keys = F.array(
        *[
            F.struct((F.length("word") - less).alias("m"), F.lit(last).alias("last"), half.alias("half"))
            for less in (0, 1)
            for h in [((F.length("word") - less) / 2).cast("int")]
            for last, half in ((False, F.substring("word", F.lit(1), h)), (True, F.right("word", h)))
        ]
    )
    rows = words.select("word", "n", F.inline(keys)).where(F.col("m") >= shortest)
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(INDEX_BITS) / ((F.col("m") + 1) * LETTERS))))
    crowded = (
        rows.groupBy("m", "last", "half").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > size)
        .select("m", "last", "half", F.ceil(F.col("size") / size).cast("int").alias("blocks"))
    )
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    return (
        rows.join(crowded, ["m", "last", "half"], "left")
        .withColumns({"own": own, "block": F.explode(F.sequence(F.lit(0), blocks - 1))})
        .select("m", "last", "half", "block", (F.col("block") != F.col("own")).cast("int").alias("role"), "word", "n")
    )


class PositionIndex:
    """Bitsets of the members of one block, in which words of m or m + 1 code points look for near ones."""

    def __init__(self, words: list[str], m: int):
        self.m, self.size = m, len(words)
        places: dict[tuple[int, str], list[int]] = defaultdict(list)
        lengths: dict[int, list[int]] = {m: [], m + 1: []}
        for i, word in enumerate(words):
            lengths[len(word)].append(i)
            for place in enumerate(word):
                places[place].append(i)
        self.at = {place: self._bits(found) for place, found in places.items()}
        self.of_length = {n: self._bits(found) for n, found in lengths.items()}

    def _bits(self, numbers: list[int]) -> int:
        out = bytearray(self.size // 8 + 1)
        for i in numbers:
            out[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(out, "little")

    def near(self, word: str, apart_from: int, other_half: bool) -> int:
        """The members near the word, without `apart_from`; words of m + 1 find those of m only.

        With `other_half`, members with the same first half are left out: they meet elsewhere.
        """
        at, m = self.at, self.m
        same = ((1 << self.size) - 1) & ~apart_from
        shorter = len(word) > m
        if shorter:
            same &= self.of_length[m]
        replaced = more = less = alike = 0
        half = m // 2
        for i, letter in enumerate(word):
            if shorter:
                less = less & at.get((i - 1, letter), 0) | same
            else:
                here = at.get((i, letter), 0)
                more = (more | same) & at.get((i + 1, letter), 0)
                replaced = replaced & here | same
            same &= at.get((i, letter), 0)
            if i == half - 1:
                alike = same
            if not (same or less or replaced or more):
                return 0
        found = less & self.of_length[m] if shorter else replaced & self.of_length[m] | (more | same) & self.of_length[m + 1]
        return found & ~alike if other_half else found


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within blocks; rows come sorted by block, members first."""
    out: list[tuple[str, int, int, str]] = []
    group, members, counts, index = None, [], [], None

    def ask(word: str, own: int) -> None:
        found = index.near(word, own, group[1])
        if found:
            best = min((-counts[i], members[i]) for i in _members(found))
            out.append((word, found.bit_count(), -best[0], best[1]))

    def ask_members() -> None:
        nonlocal index
        index = PositionIndex(members, group[0])
        for i, word in enumerate(members):
            ask(word, 1 << i)

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        out.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        for m, last, half, block, role, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (m, last, half, block) != group:
                if members and index is None and len(members) > 1:
                    ask_members()
                group, members, counts, index = (m, last, half, block), [], [], None
            if role == 0:
                members.append(word)
                counts.append(n)
            elif members:
                if index is None:
                    ask_members()
                ask(word, 0)
            if len(out) >= ROWS:
                yield flushed()
    if len(members) > 1 and index is None:
        ask_members()
    yield flushed()


def near_words(words: DataFrame, *, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, best_n and best (the most frequent near word, the least of equals) of every word."""
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * words.rdd.getNumPartitions())
    group = ["m", "last", "half", "block"]
    rows = dealt(words, shortest, block).repartition(parts, *group).sortWithinPartitions(*group, "role")
    found = map_batches(rows, _search, "word string, n_near long, best_n long, best string")
    none = F.lit(None)
    both = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("order"), "best").alias("pick")).unionByName(
        words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("struct<order:long,best:string>").alias("pick"))
    )
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("pick").alias("pick")).select(
        "word", "n", "n_near", (-F.col("pick.order")).alias("best_n"), F.col("pick.best").alias("best")
    )


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """word and the end of its chain, for (word, form) rows; `rounds` doublings reach 2**rounds steps."""
    ends = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = staged(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return ends


def group_variants(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = 2, ratio: int = RATIO, block: int = BLOCK
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of whole texts.

    Defined results: null and empty texts have no words; a null id is hashed as the empty string;
    repeated rows count as often as they come; of near words of equal counts the least in code-point
    order is the form; an empty table gives no row. Columns other than `doc_id` and `text` aren't read.
    """
    if shortest < 2 or ratio < 2:
        raise ValueError("words of two code points and a ratio of 2 at least")
    words = staged(vocabulary(docs, doc_id=doc_id, text=text, shortest=shortest, least=least), "vocabulary")
    chosen = F.col("best_n") >= ratio * F.col("n")
    near = staged(
        near_words(words, shortest=shortest, block=block).select(
            "word", F.when(chosen, F.col("best")).alias("form"), "n", "n_near", F.when(chosen, F.col("best_n")).alias("form_n")
        ),
        "near-words",
    )
    largest = near.agg(F.max("n")).first()[0] or 1
    steps = 1 + int(math.log(largest, ratio))
    ends = roots(near.where("form is not null"), steps.bit_length())
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
