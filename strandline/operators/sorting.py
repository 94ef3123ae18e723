"""Sorting, limits and picks. Ties are settled by the arguments, never by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_and_bottom(df: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    """The n rows with the greatest and the least values, marked by `end`."""
    top = df.orderBy(F.desc(value), tie).limit(n).withColumn("end", F.lit("top"))
    return top.unionByName(df.orderBy(value, tie).limit(n).withColumn("end", F.lit("bottom")))


def shortest(df: DataFrame, text: str, tie: str, n: int) -> DataFrame:
    return df.withColumn("length", F.length(text)).orderBy("length", tie).limit(n)


def limited(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first n rows; none and 0 mean all."""
    return df.orderBy(*order).limit(n) if n else df


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: Column | int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def remaining_slots(df: DataFrame, keys: list[str], order: list[Column], slots: int, taken: str) -> DataFrame:
    """The best rows of each key for the slots that `taken` leaves, none if it leaves none."""
    best = top_per_key(df, keys, order, slots)  # a constant limit, which cuts rows before the shuffle
    return best.where(F.col("rank") <= F.greatest(F.lit(slots) - F.col(taken), F.lit(0)))


def pick(df: DataFrame, keys: list[str], value: str, priority: list[Column]) -> DataFrame:
    """Of each key the value that is first by priority, then by length, then by name."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*priority, F.length(value).alias("n_"), F.col(value).alias("v_"))).alias(value))


def nearest_version(wanted: Column, known: list[tuple[int, int, int]]) -> Column:
    """The known version at the least distance from "a.b.c"; of equal ones the first."""
    parts = [F.coalesce(F.get(F.split(wanted, r"\."), F.lit(i)).try_cast("int"), F.lit(0)) for i in range(3)]
    rows = F.array(*[F.struct(sum((F.abs(parts[k] - v[k]) / 10.0**(2 * k) for k in range(3)), F.lit(0.0)).alias("d"), F.lit(i).alias("i"), F.lit(".".join(map(str, v))).alias("v")) for i, v in enumerate(known)])
    return F.array_min(rows)["v"]
