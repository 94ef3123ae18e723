"""Aggregates of runs, models, categories and tests. Rates are raw doubles; reports round them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rate(part: Column, whole: Column) -> Column:
    """Percent, 0 of nothing."""
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def truncated(x: Column, digits: int) -> Column:
    """Cut, not rounded, behind a digit."""
    return F.floor(x * 10**digits) / 10**digits


def suite_totals(suites: DataFrame) -> DataFrame:
    """Sums over suites, their number, and the success rate in percent, truncated to 2 digits."""
    sums = suites.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tests", "failures", "errors", "skipped", "time")], F.count("*").alias("suites"))
    good = F.col("tests") - F.col("failures") - F.col("errors") - F.col("skipped")
    return sums.withColumn("success_rate", truncated(rate(good, F.col("tests")), 2))


def run_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """results(success, duration, passed, failed, total): figures of runs. Test sums and mean_success count successful rows only;
    mean_positive counts all rows with a duration above 0 and mean_all all rows."""
    ok, d = F.coalesce(F.col("success"), F.lit(False)), F.col("duration")
    sums = [F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in ("total", "passed", "failed")]
    out = results.groupBy(*by).agg(
        F.count("*").alias("instances"), F.count_if(ok).alias("successful"), *sums, F.avg(F.when(ok, d)).alias("mean_success"),
        F.avg(F.when(d > 0, d)).alias("mean_positive"), F.avg(F.coalesce(d, F.lit(0.0))).alias("mean_all"), (F.sum(d) / 3600).alias("hours"),
    )
    return out.withColumn("success_rate", rate(F.col("successful"), F.col("instances"))).withColumn("pass_rate", rate(F.col("passed"), F.col("total")))


def compare_runs(results: DataFrame, run: str) -> DataFrame:
    """run_summary() of each run, no rows unless there are two runs at least."""
    summary = run_summary(results, [run])
    several = results.select(run).distinct().agg((F.count("*") >= 2).alias("several_"))
    return summary.join(F.broadcast(several)).where("several_").drop("several_")


def histogram(df: DataFrame, category: Column, name: str = "category") -> DataFrame:
    """Rows of each category and their share of all in percent."""
    counts = df.groupBy(category.alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total_"))
    return counts.join(F.broadcast(total)).select(name, "n", rate(F.col("n"), F.col("total_")).alias("share"))


def model_stats(df: DataFrame, by: str) -> DataFrame:
    """df(error, tokens, cost, response_time): a model's rows; tokens and times count those without an error."""
    ok = F.col("error").isNull()
    out = df.groupBy(by).agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("successful"), F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.sum("cost").alias("cost"), F.avg(F.when(ok, F.col("response_time"))).alias("mean_time"),
    )
    return out.withColumn("success_rate", rate(F.col("successful"), F.col("requests")))


def distinct_over(df: DataFrame, by: list[str], columns: list[str], name: str) -> DataFrame:
    """Distinct values over several array columns: exact, in two aggregates."""
    items = df.select(*by, F.explode(F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in columns]))).alias("item_"))
    return items.distinct().groupBy(*by).agg(F.count("*").alias(name))


def extremes(df: DataFrame, by: list[str], entity: str, value: str) -> DataFrame:
    """The entities with the greatest and the least value; null counts as 0 for the one and as infinite for the other; ties by name."""
    v, e = F.col(value), F.col(entity)
    return df.groupBy(*by).agg(
        F.max_by(e, F.struct(F.coalesce(v, F.lit(0.0)), -e)).alias("longest"), F.min_by(e, F.struct(F.coalesce(v, F.lit(float("inf"))), e)).alias("shortest")
    )


def status_counts(df: DataFrame, by: list[str], status: str, values: tuple[str, ...] = ("PASSED", "FAILED", "SKIPPED", "ERROR")) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(status) == s).alias(s.lower()) for s in values], F.count("*").alias("total"))


def collected(df: DataFrame, by: list[str], item: Column, order: list[Column | str], name: str, separator: str | None = None) -> DataFrame:
    """Items of each key in order, as an array or as a string."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(*order, item.alias("item_")))), lambda x: x["item_"])
    return df.groupBy(*by).agg((held if separator is None else F.array_join(held, separator)).alias(name))


def transition_totals(instances: DataFrame, percent: bool) -> DataFrame:
    """Sums of transitions over successful rows; success_rate in percent or as a fraction."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    kinds = ("fail_to_pass", "pass_to_pass", "pass_to_fail", "fail_to_fail")
    out = instances.agg(F.count("*").alias("instances"), F.count_if(ok).alias("successful"), *[F.coalesce(F.sum(F.when(ok, F.col(k))), F.lit(0)).alias(k) for k in kinds])
    share = F.coalesce(F.try_divide(F.col("successful").cast("double"), F.col("instances")), F.lit(0.0))
    return out.withColumn("success_rate", share * 100 if percent else share)


def fixed_summary(instances: DataFrame) -> DataFrame:
    """Instances with any test, their tests before and after, those fixed, and the instances that fix none."""
    seen = instances.where((F.col("pre_total") > 0) | (F.col("post_total") > 0))
    return seen.agg(F.count("*").alias("instances"), F.sum("pre_total").alias("pre"), F.sum("post_total").alias("post"), F.sum("fixed").alias("fixed"), F.count_if(F.col("fixed") == 0).alias("none_fixed"))


def progress_counts(df: DataFrame, done: Column, skipped: Column) -> DataFrame:
    out = df.agg(F.count("*").alias("processed"), F.count_if(done).alias("extracted"), F.count_if(skipped).alias("skipped"))
    return out.withColumn("rate", rate(F.col("extracted"), F.col("processed")))


def task_flavors(tasks: Column) -> Column:
    """Distinct flavors of task names such as testFreeDebugUnitTest, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tasks, lambda t: F.regexp_extract(t, r"test([A-Z]\w*?)(?:Debug|Release)UnitTest", 1)), lambda f: f != "")))
