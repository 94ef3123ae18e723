"""Predicates and projections. A null never makes a condition null: it is false unless stated otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions import markers

#: White space that is cut off both ends.
BLANK = " \t\n\r\f\x0b"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def typed_filter(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """A condition for each column that exists: a number is equality, a string a regular expression, a pair a closed range.

    A filter drops rows for which its condition is null, so the conditions stay bare and can be pushed into the scan.
    """

    def one(name: str, value: object) -> Column:
        if isinstance(value, str):
            return F.col(name).rlike(value)
        if isinstance(value, tuple):
            return F.col(name).between(*value)
        return F.col(name) == value

    return df.where(every([one(k, v) for k, v in conditions.items() if k in df.columns]))


def without_marker(df: DataFrame, columns: list[str], marker: str) -> DataFrame:
    """Rows with the marker in none of the columns; null columns don't have it."""
    return df.where(every([~yes(F.contains(F.col(c).cast("string"), F.lit(marker))) for c in columns]))


def with_defaults(df: DataFrame, defaults: dict[str, object], drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns that are missing are added with a default; those in `drop` go if they are there."""
    return df.drop(*drop).withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})


def valid_pull(merged_at: Column, issues: Column) -> Column:
    return merged_at.isNotNull() & yes(F.size(issues) > 0)


def has_text(*columns: Column, trimmed: bool = False) -> Column:
    """All columns are neither null nor empty, nor blank if trimmed."""
    return every([F.coalesce(stripped(c) if trimmed else c, F.lit("")) != "" for c in columns])


def suffix_match(df: DataFrame, ids: DataFrame, key: str, listed: str = "listed", allow: bool = True) -> DataFrame:
    """Rows whose key is a listed id or ends in one behind "-" or "_", or if not allow the others.

    Every suffix of a key behind a separator is a candidate, so this is an equi-join and not one of all pairs.
    """
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: F.substring(F.col(key), i, F.lit(1)).isin("-", "_"))
    suffixes = F.transform(starts, lambda i: F.substring(F.col(key), i + 1, F.length(key)))
    exploded = df.select(key).distinct().select(key, F.explode(F.concat(F.array(key), suffixes)).alias("suffix_"))
    hits = exploded.join(ids.select(F.col(listed).alias("suffix_")).distinct(), "suffix_").select(key).distinct()
    return df.join(hits, key, "left_semi" if allow else "left_anti")


def allow_list(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def within_limit(df: DataFrame, size: Column, limits: DataFrame, chosen: DataFrame, default: int = 128_000) -> DataFrame:
    """Rows whose size is at most the least limit of the chosen models; a model without a limit has the default. A null size stays."""
    least = chosen.join(limits, "model", "left").agg(F.min(F.coalesce("context_limit", F.lit(default))).alias("least_"))
    return df.join(F.broadcast(least)).where(F.coalesce(size <= F.col("least_"), F.lit(True))).drop("least_")


def active(pre_total: Column, post_total: Column) -> Column:
    """Not both 0; null counts as 0."""
    return ~((F.coalesce(pre_total, F.lit(0)) == 0) & (F.coalesce(post_total, F.lit(0)) == 0))


def both_applied(test_patch: Column, solution_patch: Column) -> Column:
    return yes(test_patch) & yes(solution_patch)


def run_succeeded(build_successful: Column, total_tests: Column) -> Column:
    return yes(build_successful) | yes(total_tests > 0)


def build_succeeded(log: Column, exit_code: Column | None = None) -> Column:
    """The log says so; with an exit code also a log that doesn't say it failed, at exit code 0."""
    said = yes(F.contains(log, F.lit("BUILD SUCCESSFUL")))
    return said if exit_code is None else said | (~yes(F.contains(log, F.lit("BUILD FAILED"))) & yes(exit_code == 0))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words is part of the text; not of a null one."""
    return reduce(lambda a, b: a | b, [yes(F.contains(text, F.lit(w))) for w in words], F.lit(False))


def tests_ran(log: Column, exit_code: Column, fold: bool = False) -> Column:
    """Whether a run got to its tests: signs of failure first, then of execution, then the exit code.

    Signs are looked for in the log's lower case as they are written, so those with capitals are never found, which is
    what the runs on record were judged by; with fold they are put into lower case too.
    """
    low = F.lower(F.coalesce(log, F.lit("")))
    failed, executed = (tuple(w.lower() if fold else w for w in words) for words in (markers.RUN_FAILED, markers.RUN_EXECUTED))
    return F.when(has_any(low, failed), False).when(has_any(low, executed), True).otherwise(yes(exit_code == 0))


def compile_failed(log: Column) -> Column:
    return has_any(F.lower(log), markers.COMPILE_ERRORS)


def patch_format(patch: Column) -> Column:
    """struct(valid, reason)."""
    text = F.coalesce(patch, F.lit(""))
    marked = text.rlike(r"(?m)^(?:diff --git |--- |\+\+\+ |@@ )")
    few = F.size(F.split(stripped(text), "\n")) < 2
    reason = F.when(stripped(text) == "", "empty").when(~marked, "no patch markers").when(few, "too short")
    return F.struct(reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def repository_url(repo: Column) -> Column:
    return F.when(repo.startswith("https://"), repo).otherwise(F.concat(F.lit("https://github.com/"), repo, F.lit(".git")))


def error_lines(log: Column) -> Column:
    """The lines of a log that speak of errors."""
    return F.filter(F.split(log, "\n"), lambda x: F.lower(x).rlike("error:|failed:|exception|cannot find"))


def project_kind(paths: Column, indicators: tuple[str, ...], special: str, general: str) -> Column:
    """`special` if any path has any indicator."""
    found = F.exists(paths, lambda p: reduce(lambda a, b: a | b, [F.contains(p, F.lit(i)) for i in indicators]))
    return F.when(yes(found), special).otherwise(general)


def runs_tests(patch: Column, test_files: Column) -> Column:
    """Whether a patch is to be followed by its tests: it isn't blank, and touches test files or paths."""
    return has_text(patch, trimmed=True) & (yes(F.size(test_files) > 0) | yes(patch.rlike(r"(?m)^(?:diff --git|\+\+\+|---) \S*/(?:test|androidTest)/")))


def with_status(results: Column, status: str) -> Column:
    """Of an array of test results those with a status."""
    return F.filter(results, lambda t: t["status"] == status)
