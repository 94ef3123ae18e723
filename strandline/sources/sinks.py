"""Sinks. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    write_csv(df, path, "append")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def write_routed(df: DataFrame, routes: dict[str, Column]) -> None:
    """Each path gets the rows for which its condition is true; a row may go to several. The input is computed once."""
    held = df.persist()
    try:
        for path, condition in routes.items():
            write_jsonl(held.where(F.coalesce(condition, F.lit(False))), path)
    finally:
        held.unpersist()


def as_json_array(df: DataFrame, order: list[Column]) -> DataFrame:
    """One row, `json`: all rows as an array, in order. For reports; the array is one value."""
    keyed = df.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.struct("*").alias("row")).alias("r"))
    return keyed.agg(F.to_json(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"])).alias("json"))


def write_by_entity(df: DataFrame, path: str, key: str) -> None:
    """JSON in a folder for each entity, its rows together."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def summary_document(totals: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row: the totals' columns and `results`, a map from key to the rest of each row. For a run's instances; the map is one value."""
    rest = [c for c in results.columns if c != key]
    held = results.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.struct(*rest).alias("result"))))).alias("results"))
    return totals.crossJoin(held)


def pass_through(lines: DataFrame, parsed: Column, rewritten: Column, value: str = "value") -> DataFrame:
    """Lines rewritten where they could be parsed, and as they were elsewhere."""
    return lines.withColumn(value, F.when(parsed.isNull(), F.col(value)).otherwise(rewritten))


def report(title: str, rows: list[tuple[str, object]]) -> str:
    """A report's text, of figures that have been computed."""
    wide = max((len(k) for k, _ in rows), default=0)
    lines = [title, "=" * len(title), *[f"{k:<{wide}}  {v:.2f}" if isinstance(v, float) else f"{k:<{wide}}  {v}" for k, v in rows]]
    return "\n".join(lines) + "\n"
