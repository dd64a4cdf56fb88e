"""What several operators share: reading, text forms, cutting lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.session import with_package, working_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Byte map that lowers A-Z only.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends here.

    A lost executor costs only the tasks after this point. The files stay until
    the owner of the shared folder clears it.
    """
    path = working_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_bytes(value: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty, unpaired surrogates become '?'."""
    return (value or "").encode("utf-8", "replace")


def word_chunks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text between ASCII white space, A-Z lowered, about `size` bytes of text at a time."""
    lowered, at = text.translate(LOWER_BYTES), 0
    while at < len(lowered):
        end = at + size
        while end < len(lowered) and not lowered[end : end + 1].isspace():  # chunks end between words
            end += 1
        yield lowered[at:end].split()
        at = end


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def unsigned_hash_mod(value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it one that the frame doesn't have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(
    frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    with_package(frame.sparkSession)
    return frame.mapInArrow(run, schema)
