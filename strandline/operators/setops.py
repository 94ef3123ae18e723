"""Set operations on rows, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def except_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def intersect_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def gained(before: Column, after: Column) -> Column:
    """Names in after that aren't in before, sorted."""
    return F.array_sort(F.array_except(after, before))


def held(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_intersect(after, before))


def ordered_distinct(items: Column) -> Column:
    """Each item once, where it comes first."""
    return F.array_distinct(items)


def merge_right_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have a key, new's."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both maps; where both have a key, new's."""
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(kept, new)
