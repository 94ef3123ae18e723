"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def token_estimates(text: Column) -> dict[str, Column]:
    """Estimates of a text's tokens: a quarter of its characters, a fifth more than that, and 1.3 for each word, cut to whole numbers."""
    chars = F.length(text)
    words = F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    quarter = F.floor(chars / 4)
    return {"by_chars": quarter, "with_margin": F.floor(quarter * F.lit(6) / 5), "by_words": F.floor(words * F.lit(13) / 10)}


def json_default(json: Column, path: str, default: object, kind: str = "string") -> Column:
    """A value inside a JSON text, or a default where it is absent or of another kind."""
    return F.coalesce(F.get_json_object(json, path).try_cast(kind), F.lit(default))


def to_bool(text: Column) -> Column:
    """yes, true, t, y and 1, and no, false, f, n and 0, in any case; else null."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False)


def to_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text).try_cast("long"), F.lit(default))


def content_key(files: Column) -> Column:
    """md5 over a map's entries, "key:value" in the order of keys."""
    return F.md5(F.array_join(F.transform(F.array_sort(F.map_entries(files)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ""))


def cutoff_stamp(day: str) -> Column:
    """yyyyMMdd as an ISO-8601 stamp, which orders as text."""
    return F.date_format(F.to_timestamp(F.lit(day), "yyyyMMdd"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))
