"""Joins. Physical strategies are left to the planner, which broadcasts a side by its bytes as estimated or, at run time, as measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

def inner(left: DataFrame, right: DataFrame, on: str | list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """Rows with equal keys, without those in which a required column is null."""
    return reduce(lambda d, c: d.where(F.col(c).isNotNull()), required, left.join(right, on))


def anti(left: DataFrame, done: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of left whose key isn't in done; null keys are in nothing."""
    return left.join(done, on, "left_anti")


def symmetric_anti(left: DataFrame, right: DataFrame, key: str, side: str = "side") -> DataFrame:
    """Rows whose key, as a string, is on one side only; columns that a side hasn't are null."""
    a, b = (d.withColumn(key, F.col(key).cast("string")) for d in (left, right))
    only_a = anti(a, b.select(key), key).withColumn(side, F.lit("left"))
    only_b = anti(b, a.select(key), key).withColumn(side, F.lit("right"))
    return only_a.unionByName(only_b, allowMissingColumns=True)


def left_with_list(left: DataFrame, lists: DataFrame, on: str, items: str, k: int | None = None) -> DataFrame:
    """left with a list from the other side, its first k items, or an empty list."""
    joined = left.join(lists.select(on, items), on, "left")
    held = F.coalesce(F.col(items), F.array().cast(lists.schema[items].dataType))
    return joined.withColumn(items, held if k is None else F.slice(held, 1, k))


def lookup(df: DataFrame, table: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """A lookup join; keys without an entry have the defaults."""
    return df.join(table, on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def cost(tokens_in: Column, tokens_out: Column, in_price: Column, out_price: Column, unit: float = 1e6) -> Column:
    return tokens_in / unit * in_price + tokens_out / unit * out_price


def rule_match(df: DataFrame, text: Column, rules: list[tuple[str, object]], name: str, default: object = None, regex: bool = False) -> DataFrame:
    """The value of the first rule whose pattern is in the text, or matches it: rules are a chain of conditions, not a join."""
    out = None
    for pattern, value in rules:
        hit = text.rlike(pattern) if regex else F.contains(text, F.lit(pattern))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return df.withColumn(name, F.lit(default) if out is None else out.otherwise(F.lit(default)))


def heaviest_pattern(text: Column, weights: list[tuple[str, float]], least: float = 1.0) -> Column:
    """The greatest weight of the patterns that match, `least` at least."""
    return F.greatest(F.lit(least), F.lit(least), *[F.when(text.rlike(p), F.lit(w)).otherwise(F.lit(least)) for p, w in weights])


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words is part of the text."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(text, F.lit(w)), F.lit(False)) for w in words], F.lit(False))


def shared_word(a: Column, b: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is part of both texts."""
    hits = [F.coalesce(F.contains(a, F.lit(w)) & F.contains(b, F.lit(w)), F.lit(False)) for w in words]
    return reduce(lambda x, y: x | y, hits, F.lit(False))


def enrich_text(parents: DataFrame, refs: str, parts: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """Each parent with the texts that its references name, in their order and one to a line; absent ones are skipped."""
    refd = parents.select(*keep, F.posexplode(refs).alias("pos_", key))
    found = refd.join(parts.select(key, text), key)
    joined = found.groupBy(*keep).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos_", text))), lambda x: x[text]), "\n").alias(text))
    return parents.select(*keep).join(joined, keep, "left").withColumn(text, F.coalesce(text, F.lit("")))


def before_first(comments: DataFrame, commits: DataFrame, key: str, stamp: str, first: str, order: list[Column]) -> DataFrame:
    """Comments of a key, in order, up to the first that isn't older than the key's first commit; a later older one doesn't count."""
    from strandline.operators.windows import take_while

    firsts = commits.groupBy(key).agg(F.min_by(first, "pos").alias("first_"))
    joined = comments.join(firsts, key)
    return take_while(joined, [key], order, F.col(stamp) < F.col("first_")).drop("first_")


def guarded_semi(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left with a key in right; all rows if right is empty."""
    empty = right.agg((F.count("*") == 0).alias("empty_"))
    flagged = left.join(F.broadcast(empty))
    return flagged.join(right.select(F.col(on).alias("of_")).distinct(), F.col(on) == F.col("of_"), "left").where("empty_ or of_ is not null").drop("of_", "empty_")


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path: str, prefix: str, value: str) -> DataFrame:
    """Each path with the value of the longest known folder above it, null without one. Equi-joins on a path's folders."""
    parts = F.split(F.col(path), "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = paths.select(path).distinct().select(path, F.explode(folders).alias(prefix))
    best = above.join(prefixes.select(prefix, value), prefix).groupBy(path).agg(F.max_by(value, F.struct(F.length(prefix), F.col(value))).alias(value))
    return paths.join(best, path, "left")


def exact_or_suffix(wanted: DataFrame, files: DataFrame, path: str, content: str, order: str) -> DataFrame:
    """Each wanted path with its content, or that of the first file of the same name, or null."""
    name = F.element_at(F.split(path, "/"), -1)
    exact = files.groupBy(path).agg(F.min_by(content, order).alias("exact_"))
    by_name = files.groupBy(name.alias("name_")).agg(F.min_by(content, order).alias("named_"))
    joined = wanted.withColumn("name_", name).join(exact, path, "left").join(by_name, "name_", "left")
    return joined.withColumn(content, F.coalesce("exact_", "named_")).drop("name_", "exact_", "named_")


def first_detail(items: DataFrame, details: DataFrame, on: str, value: str, order: str) -> DataFrame:
    """Each item with the value of its first detail."""
    return items.join(details.groupBy(on).agg(F.min_by(value, order).alias(value)), on, "left")


def as_of(left: DataFrame, right: DataFrame, key: str, stamp: str, values: list[str]) -> DataFrame:
    """Each row of left with the values of the last row of right at or before it: one sort by key over the union of both."""
    a = left.withColumn("held_", F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType)).withColumn("side_", F.lit(1))
    b = right.select(key, stamp, F.struct(*values).alias("held_"), F.lit(0).alias("side_"))
    both = a.unionByName(b, allowMissingColumns=True)
    frame = Window.partitionBy(key).orderBy(stamp, "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("held_", F.last("held_", ignorenulls=True).over(frame)).where("side_ = 1")
    return out.select(*left.columns, "held_.*")
