"""Burrows-Wheeler transform and common prefixes of many strings, built column by column.

Round t inserts the suffix of length t of every string at once, so a round adds
one symbol for each string. All that a round needs is the transform so far and
the common prefix lengths so far. Both are kept in files that a round reads
once in sequence and writes anew in sequence.

The rank of a new suffix cX follows from the transform: suffix X stands before
symbol c, and the new suffixes are ordered as these symbols are, equal ones by
place. The prefix that cX shares with the one before it is one more than the
least common prefix between the two places.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np

#: Marks the beginning of a string; symbols are bytes plus one. UTF-8 has no byte above 0xF4.
BEGIN = 0


class Columns:
    """The collection so far: a file of symbols, a file of common prefix lengths (up to `cap`)."""

    def __init__(self, folder: Path, cap: int):
        self.folder, self.cap, self.turn = folder, cap, 0

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.fromfile(self.folder / f"{name}-{self.turn}", np.uint8) for name in ("bwt", "lcp"))

    def write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        old, self.turn = self.turn, self.turn ^ 1
        bwt.tofile(self.folder / f"bwt-{self.turn}")
        lcp.tofile(self.folder / f"lcp-{self.turn}")
        for name in ("bwt", "lcp"):
            (self.folder / f"{name}-{old}").unlink(missing_ok=True)


def _least_between(lcp: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The least of lcp[after + 1 .. to], for each pair."""
    if not len(after):
        return np.zeros(0, lcp.dtype)
    down = np.argsort(-to, kind="stable")  # falling ends: the stretches between two pairs are then single values
    pairs = np.empty(2 * len(down), np.int64)
    pairs[0::2], pairs[1::2] = after[down] + 1, to[down] + 1
    out = np.empty(len(down), lcp.dtype)
    out[down] = np.minimum.reduceat(np.append(lcp, lcp.dtype.type(0)), pairs)[0::2]
    return out


def build(strings: list[bytes], folder: Path, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In the order of all suffixes: symbol before, common prefix with the one before (up to cap), string, start.

    Strings hold no byte above 0xFE. Equal suffixes are ordered by string. The folder is empty at the end.
    """
    m = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, m)
    text = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(lengths)

    def symbols(which: np.ndarray, t: int) -> np.ndarray:
        """The symbol before the suffix of length t."""
        inside = lengths[which] > t
        out = np.full(len(which), BEGIN, np.uint8)
        out[inside] = text[ends[which[inside]] - t - 1] + 1
        return out

    columns = Columns(folder, cap)
    columns.write(symbols(np.arange(m), 0), np.zeros(m, np.uint8))
    newest, which = np.arange(m), np.arange(m)  # places of the suffixes of the last round, and their strings
    for t in range(1, int(lengths.max(initial=0)) + 1):
        bwt, lcp = columns.read()
        going = bwt[newest] != BEGIN
        newest, which = newest[going], which[going]
        order = np.argsort(bwt, kind="stable")
        begun = int((bwt == BEGIN).sum())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        k = place[newest]
        by_rank = np.argsort(k, kind="stable")
        k, which = k[by_rank], which[by_rank]
        rank = k - begun + m
        size = m + len(order) - begun
        fresh = np.zeros(size, bool)
        fresh[rank] = True
        new_bwt, new_lcp = np.empty(size, np.uint8), np.empty(size, np.uint8)
        new_bwt[~fresh], new_lcp[~fresh] = bwt, lcp
        new_bwt[rank] = symbols(which, t)
        near = np.unique(np.concatenate([k, k + 1]))  # a new suffix, and the one behind it
        near = near[near < len(order)]
        same = (near > begun) & (bwt[order[near]] == bwt[order[near - 1]])
        new_lcp[near - begun + m] = 0
        near = near[same]
        shared = _least_between(lcp, order[near - 1], order[near]).astype(np.int64) + 1
        new_lcp[near - begun + m] = np.minimum(shared, cap)
        columns.write(new_bwt, new_lcp)
        newest = rank
    bwt, lcp = columns.read()
    for name in ("bwt", "lcp"):
        (folder / f"{name}-{columns.turn}").unlink()
    return bwt, lcp, *_places(bwt, lengths)


def _places(bwt: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and start of each suffix, by stepping back from the ends of all strings at once."""
    m = len(lengths)
    order = np.argsort(bwt, kind="stable")
    begun = int((bwt == BEGIN).sum())
    step = np.empty(len(order), np.int64)
    step[order] = np.arange(len(order)) - begun + m
    string, start = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.int64)
    at, which, left = np.arange(m), np.arange(m), lengths.copy()
    while len(at):
        string[at], start[at] = which, left[which]
        going = left[which] > 0
        at, which = step[at[going]], which[going]
        left[which] -= 1
    return string, start
