"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to 2**bits cells, the cells are numbered along a
Hilbert curve, rows are ordered by that number, and the order is cut into runs
of equal row counts. Files of a shard then cover a compact box in all
dimensions at once, so a filter on any of them prunes files.

The global row number is not computed in one task: rows are counted by (cell,
salt), the counts are summed up along the curve, and a row's number is the
offset of its (cell, salt) plus its place there. The sums run over at most
2**(bits * dimensions) cells, whatever the input. A cell with a third of all rows is
spread over `salts` tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import free_name

#: Names of working columns of the curve's own table.
CODE, CELL, SALT, RANK, START = "_code", "_hilbert", "_salt", "_rank", "_offset"


@dataclass(frozen=True)
class Dimension:
    """A column and how it is cut: `number` by equally filled ranges, `category` by hash."""

    column: str
    kind: str = "category"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point given by cell numbers below 2**bits."""
    n = len(cells)
    steps = F.array(
        *[F.struct(F.lit(1 << level).alias("q"), F.lit(i).alias("i")) for level in range(bits - 1, 0, -1) for i in range(n)]
    )

    def turn(point: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - 1
        first, own = F.element_at(point, 1), F.element_at(point, i + 1)
        inverted = own.bitwiseAND(q) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(
            point,
            lambda x, k: F.when(k == 0, F.when(inverted, x.bitwiseXOR(low)).otherwise(x.bitwiseXOR(swap)))
            .when((k == i) & ~inverted, x.bitwiseXOR(swap))
            .otherwise(x),
        )

    def gray(point: Column) -> Column:
        """Every coordinate xored with those before it."""
        empty = F.array().cast("array<int>")
        return F.aggregate(
            point, empty, lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)).bitwiseXOR(x)))
        )

    def flipped(xored: Column) -> Column:
        levels = F.array(*[F.lit(1 << level) for level in range(max(1, bits - 1), 0, -1)])
        last = F.element_at(xored, n)
        flip = F.aggregate(
            levels, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
        )
        return _let(flip, lambda t: F.transform(xored, lambda x: x.bitwiseXOR(t)))

    def woven(point: Column) -> Column:
        places = F.array(*[F.lit(level) for level in range(bits - 1, -1, -1)])
        bit = lambda x, level: F.call_function("getbit", x.cast("long"), level).cast("long")
        return F.aggregate(
            places, F.lit(0).cast("long"), lambda out, level: F.aggregate(point, out, lambda o, x: o * 2 + bit(x, level))
        )

    point = F.array(*[c.cast("int") for c in cells])
    turned = F.aggregate(steps, point, turn) if bits > 1 else point
    return _let(_let(_let(turned, gray), flipped), woven)


def curve(spark: SparkSession, dimensions: int, bits: int) -> DataFrame:
    """The place on the curve of every cell: 2**(dimensions * bits) rows, whatever the data."""
    code = F.col("id")
    mask = F.lit((1 << bits) - 1)
    cells = [F.shiftright(code, bits * d).bitwiseAND(mask) for d in range(dimensions)]
    return spark.range(1 << (bits * dimensions)).select(code.alias(CODE), hilbert_index(cells, bits).alias(CELL))


def _edges(frame: DataFrame, dimension: Dimension, bits: int) -> list:
    """Upper edges of equally filled ranges; one aggregate over one column."""
    parts = [k / (1 << bits) for k in range(1, 1 << bits)]
    got = frame.agg(F.percentile_approx(F.col(dimension.column).cast("double"), parts, 10_000)).first()[0]
    return got or []


def _cell(frame: DataFrame, dimension: Dimension, bits: int) -> Column:
    value = F.col(dimension.column)
    if dimension.kind == "category":
        return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit(1 << bits)).cast("int"))
    cell = F.lit(0)
    for edge in _edges(frame, dimension, bits):
        cell = cell + (F.coalesce(value.cast("double"), F.lit(float("-inf"))) > edge).cast("int")
    return cell


def hilbert_shards(
    frame: DataFrame,
    dimensions: list[Dimension],
    *,
    key: str,
    shards: int = 8,
    bits: int = 4,
    salts: int = 256,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """All rows with `curve_index`, `shard` (0 to shards - 1) and `slot` (gapless from 0).

    Shards differ by one row at most. Within a cell, rows are spread by a hash
    of `key` and ordered by (hash part, key, ties). Defined results: a null in a
    category falls into cell 0, a null number below all others; a null key
    sorts first; repeated rows are rows of their own; equal rows may swap
    places; an empty table gives no row. Columns of `frame` named `curve_index`,
    `shard` or `slot` are replaced. `bits` times the number of dimensions may
    not exceed 20.
    """
    if not dimensions or bits < 1 or bits * len(dimensions) > 20:
        raise ValueError("between 1 and 20 bits in all")
    # Working columns have names that the caller's frame doesn't have.
    code, cell, salt, rank, start, place = (free_name(frame, c) for c in (CODE, CELL, SALT, RANK, START, "_place"))
    number = F.lit(0).cast("long")
    for d, dimension in enumerate(dimensions):
        number = number + F.shiftleft(_cell(frame, dimension, bits).cast("long"), bits * d)
    # The curve is joined, not computed for each row: its size depends on the parameters only.
    along_curve = curve(frame.sparkSession, len(dimensions), bits).select(F.col(CODE).alias(code), F.col(CELL).alias(cell))
    placed = (
        frame.withColumn(code, number)
        .withColumn(salt, F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
        .join(along_curve, code)
        .drop(code)
    )
    counts = placed.groupBy(cell, salt).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(cell).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    per_cell = counts.groupBy(cell).agg(F.sum("n").alias("cell_n"))
    # At most 2**20 rows, one for each cell, whatever the input.
    along = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_cell.select(cell, F.coalesce(F.sum("cell_n").over(along), F.lit(0)).alias("cell_start"))
    total = counts.agg(F.sum("n").alias("total"))
    offsets = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(starts, cell)
        .select(cell, salt, (F.col("cell_start") + F.col("before")).alias(start))
    )
    order = Window.partitionBy(cell, salt).orderBy(F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ties])
    total_rows = int(total.first()[0] or 0)
    shard = F.expr(f"cast((`{rank}` * {shards}) div {max(1, total_rows)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total_rows} + {shards - 1}) div {shards}")
    return (
        placed.drop("curve_index", "shard", "slot")
        .withColumn(place, F.row_number().over(order).cast("long"))
        .join(offsets, [cell, salt])
        .withColumn(rank, F.col(start) + F.col(place) - 1)
        .withColumn("shard", shard)
        .withColumn("slot", F.col(rank) - first)
        .withColumnRenamed(cell, "curve_index")
        .drop(salt, rank, start, place)
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in curve order, so that row groups have narrow ranges."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
