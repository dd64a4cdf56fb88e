"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers.

An array is cut into shards by the top bits of its hashes. Each shard is written
whole by one task, and its name appears only once it is complete, so a task that
runs twice or is lost does no harm. A worker maps a shard when it first reads
it: only pages that are read take memory, and they are shared between workers.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import working_folder


@dataclass(frozen=True)
class Files:
    """A folder of arrays; a shard is the top `bits` bits of a hash."""

    folder: str
    bits: int

    def path(self, name: str, shard: int) -> Path:
        return Path(self.folder) / f"{name}-{shard}"

    def shards(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def runs(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(shard, first, end) of each run of one shard."""
        if not len(hashes):
            return []
        shards = self.shards(hashes)
        edges = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True]).tolist()
        return [(int(shards[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def new_files(frame: DataFrame, purpose: str) -> Files:
    """A new folder; the number of shards grows with the partitions of the input."""
    folder = working_folder(frame.sparkSession, purpose)
    scheme = re.match(r"(\w+):/", folder)
    if scheme and scheme[1] != "file":
        raise ValueError("arrays are mapped by the workers: spark.checkpoint.dir must be a mounted folder")
    bits = max(3, (4 * frame.rdd.getNumPartitions() - 1).bit_length())
    return Files(re.sub(r"^file:/+", "/", folder), min(bits, 20))


def write(path: Path, chunks: list[np.ndarray]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    own = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
    with open(own, "wb") as out:
        for chunk in chunks:
            np.ascontiguousarray(chunk).tofile(out)
    os.replace(own, path)


def shard(hash_: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hash_, 64 - bits).cast("int")


def by_shard(frame: DataFrame, bits: int, *order: str) -> DataFrame:
    """Every shard whole in one task, sorted by hash; within a shard signed order is unsigned order."""
    return frame.repartitionById(1 << bits, shard(F.col("hash"), bits)).sortWithinPartitions("hash", *order)


class Mapped:
    """The arrays of a name, mapped when first read."""

    def __init__(self, files: Files, name: str, kind: np.dtype):
        self.files, self.name, self.kind = files, name, kind
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and data of a shard."""
        if number not in self.open:
            path = self.files.path(f"{self.name}-hash", number)
            there = path.exists() and path.stat().st_size
            self.open[number] = (
                (np.memmap(path, np.uint64, "r"), np.memmap(self.files.path(f"{self.name}-data", number), self.kind, "r"))
                if there
                else (np.zeros(0, np.uint64), np.zeros(0, self.kind))
            )
        return self.open[number]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted hashes: whether they are there, and their data, zeros if not."""
        there, out = np.zeros(len(hashes), bool), np.zeros(len(hashes), self.kind)
        for number, a, b in self.files.runs(hashes):
            keys, data = self.of(number)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                hit = keys[at] == hashes[a:b]
                there[a:b] = hit
                out[a:b][hit] = data[at[hit]]
        return there, out

    def find_any(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """find() for hashes in any order, repeats included."""
        unique, at = np.unique(hashes, return_inverse=True)
        there, data = self.find(unique)
        return there[at], data[at]


_open: dict[tuple[Files, str], Mapped] = {}


def mapped(files: Files, name: str, kind: np.dtype) -> Mapped:
    if (files, name) not in _open:
        for old in [k for k in _open if k[0] != files]:  # a worker keeps the arrays of one folder
            del _open[old]
        _open[files, name] = Mapped(files, name, kind)
    return _open[files, name]
