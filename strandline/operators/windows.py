"""Operators that depend on the order of rows. Spark keeps none, so each takes the order as an argument."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from pyspark.sql.window import WindowSpec

from strandline.storage import materialise


def _over(keys: list[str], order: list[Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; a null key is a key. With row_number() <= 1 tasks drop most rows before the shuffle."""
    return df.withColumn("rn_", F.row_number().over(_over(keys, order))).where("rn_ = 1").drop("rn_")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: what assignment to a dict leaves."""
    return keep_first(df, keys, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])


def keep_last_values(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """keep_last() of some columns as an aggregate, which combines before the shuffle; ties by the values."""
    last = F.max_by(F.struct(*values), F.struct(order, *values))
    return df.groupBy(*keys).agg(last.alias("last_"), F.max(order).alias(order)).select(*keys, order, "last_.*")


def shards(df: DataFrame, n: int, order: list[Column], name: str = "shard") -> DataFrame:
    """Contiguous shards of sizes that differ by one at most, the larger first.

    The rows are range-partitioned and numbered from the partitions' counts, so no task holds all of them.
    """
    numbered = number_rows(df, order)
    total = numbered.agg(F.count("*").alias("total_"))
    size, more = F.floor(F.col("total_") / n), F.col("total_") % n
    row = F.col("row_") - 1
    early = row < more * (size + 1)
    at = F.when(early, F.floor(row / (size + 1))).otherwise(more + F.floor((row - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return numbered.join(F.broadcast(total)).withColumn(name, (at + 1).cast("int")).drop("total_", "row_")


def number_rows(df: DataFrame, order: list[Column], name: str = "row_") -> DataFrame:
    """Rows with their number, from 1, in a total order: places within range partitions plus the counts of those before.

    The range-partitioned rows are written once: another run of the partitioning might put its bounds elsewhere.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    held = materialise(placed, "numbered")  # place_ has the partition above bit 33 and the row's place below
    part = F.shiftright("place_", 33)
    counts = held.groupBy(part.alias("part_")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part_", before.alias("start_"))  # a row for each partition
    within = F.col("place_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.withColumn("part_", part).join(F.broadcast(starts), "part_").withColumn(name, F.col("start_") + within).drop("part_", "start_", "place_")


def take_while(df: DataFrame, keys: list[str], order: list[Column], holds: Column, inclusive: bool = False, most: int | None = None) -> DataFrame:
    """Rows of each key before the first for which the condition fails or is null, with that one if inclusive, `most` at most."""
    frame = _over(keys, order).rowsBetween(Window.unboundedPreceding, -1 if inclusive else Window.currentRow)
    broken = F.coalesce(F.max(F.when(F.coalesce(holds, F.lit(False)), 0).otherwise(1)).over(frame), F.lit(0))
    out = df.withColumn("broken_", broken)
    if most is not None:
        out = out.withColumn("rn_", F.row_number().over(_over(keys, order))).where(F.col("rn_") <= most).drop("rn_")
    return out.where("broken_ = 0").drop("broken_")


def first_value(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(name))


def running_stop(df: DataFrame, keys: list[str], order: list[Column], cost: Column, limit: float) -> DataFrame:
    """Rows of each key with the running cost and two flags: counted, up to the row that reaches the limit, and written, before it."""
    total = F.sum(cost).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.withColumn("running", total)
    return out.withColumn("counted", F.col("running") - cost < limit).withColumn("written", F.col("running") < limit)


def _in_order(df: DataFrame, key: str, order: list[str], size: str, payload: list[str], begin: tuple, step: Callable[[tuple, int], tuple[tuple, object]], result: str, kind: str) -> DataFrame:
    """df(key, order, payload, size) with a column that a fold in order gives each row of a key.

    Rows are dealt by key and sorted; each task goes through its rows once, batch by batch, and holds one state, however many rows a key has.
    """
    names = list(dict.fromkeys([key, *order, *payload]))
    rows = df.select(*names, F.col(size).cast("long").alias(size)).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), begin
        for b in batches:
            found = []
            for k, n in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if k != last:
                    last, state = k, begin
                state, value = step(state, n)
                found.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.bool_() if kind == "boolean" else pa.int32())], names=[*b.schema.names, result])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(result, _parse_datatype_string(kind))]))


def budget_fill(df: DataFrame, key: str, order: list[str], size: str, budget: int, payload: list[str]) -> DataFrame:
    """In order, a row of a key is taken if it leaves the sum below the budget, else skipped. Returns the taken rows; a null size never fits."""

    def step(state: tuple, n: int | None) -> tuple[tuple, object]:
        fits = n is not None and state[0] + n < budget
        return ((state[0] + n,) if fits else state), fits

    return _in_order(df, key, order, size, payload, (0,), step, "taken_", "boolean").where("taken_").drop("taken_")


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], important: Column, size: Column, budget: int) -> DataFrame:
    """All important rows of each key, and the others in order until the first that overflows what the important leave."""
    reserved = F.sum(F.when(important, size).otherwise(0)).over(Window.partitionBy(*keys))
    used = F.sum(F.when(important, 0).otherwise(size)).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.withColumn("reserved_", reserved).withColumn("used_", used)
    return out.where(important | (F.col("used_") <= budget - F.col("reserved_"))).drop("reserved_", "used_")


def chunk_greedy(df: DataFrame, key: str, order: list[str], size: str, capacity: int, payload: list[str]) -> DataFrame:
    """In order, a new chunk of a key is opened when a row would overflow a chunk that holds something. Returns the rows with `chunk`, from 0; a null size counts 0."""

    def step(state: tuple, n: int | None) -> tuple[tuple, object]:
        held, chunk = state
        n = n or 0
        opens = held > 0 and held + n > capacity
        state = (n, chunk + 1) if opens else (held + n, chunk)
        return state, state[1]

    return _in_order(df, key, order, size, payload, (0, 0), step, "chunk", "int")


def number_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row for each line: line_no from 1, and line."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def lines_around(text: Column, start: Column, length: Column, before: int) -> Column:
    """Lines [start - before, start + length) counted from 0, clamped at the text's begin."""
    lines = F.split(text, "\n")
    begin = F.greatest(start - before, F.lit(0))
    return F.slice(lines, begin + 1, F.greatest(start + length - begin, F.lit(0)))


def look_back(df: DataFrame, keys: list[str], order: list[Column], value: Column, n: int, name: str) -> DataFrame:
    """The values of the n rows before each row, oldest first."""
    return df.withColumn(name, F.collect_list(value).over(_over(keys, order).rowsBetween(-n, -1)))


def every_nth(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Every nth row of the total order, as checkpoints are taken."""
    return number_rows(df, order).where(F.col("row_") % n == 0)


def running_offset(df: DataFrame, keys: list[str], order: list[Column], delta: Column, name: str) -> DataFrame:
    """The sum of delta over the rows before each row, 0 for the first."""
    frame = _over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(delta).over(frame), F.lit(0)))
