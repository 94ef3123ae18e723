"""How each test's status moved from before a change to after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("FAIL_TO_PASS", "PASS_TO_PASS", "PASS_TO_FAIL", "FAIL_TO_FAIL")
ABSENT = "NOT_FOUND"


def full_name(class_name: Column, test_name: Column, separator: str = ".") -> Column:
    """class.test, or class::test with that separator."""
    return F.concat_ws(separator, F.nullif(class_name, F.lit("")), test_name)


def kind(pre: Column, post: Column, failures: tuple[str, ...] = ("FAILED", "ERROR")) -> Column:
    """The transition, or null where a side is neither passed nor failed."""
    failed_pre, failed_post = pre.isin(*failures), post.isin(*failures)
    passed_pre, passed_post = pre == "PASSED", post == "PASSED"
    return (
        F.when(failed_pre & passed_post, KINDS[0])
        .when(passed_pre & passed_post, KINDS[1])
        .when(passed_pre & failed_post, KINDS[2])
        .when(failed_pre & failed_post, KINDS[3])
    )


def join_phases(results: DataFrame, keys: list[str], order: str, failures: tuple[str, ...] = ("FAILED", "ERROR")) -> DataFrame:
    """results(keys, phase, order, status): a row for each test with its last status in either phase and its transition.

    Both phases are folded in one aggregate over the keys, which is a full outer join without one.
    """
    def last(phase: str) -> Column:
        at = F.when(F.col("phase") == phase, F.struct(order, "status"))
        return F.coalesce(F.max(at)["status"], F.lit(ABSENT))

    both = results.groupBy(*keys).agg(last("pre").alias("pre_status"), last("post").alias("post_status"))
    return both.withColumn("kind", kind(F.col("pre_status"), F.col("post_status"), failures))


def per_instance(joined: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each transition, and of tests that are on one side only."""
    counts = [F.count_if(F.col("kind") == k).alias(k.lower()) for k in KINDS]
    return joined.groupBy(*by).agg(
        *counts, F.count_if(F.col("pre_status") == ABSENT).alias("added"), F.count_if(F.col("post_status") == ABSENT).alias("removed"), F.count("*").alias("tests")
    )


def project_stats(instances: DataFrame, project: str, instance: str, kinds: tuple[str, ...] = ("fail_to_pass", "pass_to_pass", "fail_to_fail"), total: bool = False) -> DataFrame:
    """For each project, and for all if total: instances, and for each kind the instances that have it, its sum, greatest and mean where it occurs."""
    columns = [F.count("*").alias("instances")]
    for k in kinds:
        c = F.col(k)
        columns += [F.count_if(c > 0).alias(f"{k}_instances"), F.sum(c).alias(f"{k}_sum"), F.max(c).alias(f"{k}_max"), F.try_divide(F.sum(c), F.count_if(c > 0)).alias(f"{k}_mean")]
    grouped = instances.rollup(project) if total else instances.groupBy(project)
    return grouped.agg(*columns)


def ranked_list(instances: DataFrame, project: str, instance: str, count: str) -> DataFrame:
    """For each project the instances that have a kind, with their counts, greatest first; ties by name."""
    held = F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("minus"), F.col(instance).alias("instance"))))
    names = F.transform(held, lambda x: F.concat_ws(":", x["instance"].cast("string"), (-x["minus"]).cast("string")))
    return instances.where(F.col(count) > 0).groupBy(project).agg(F.array_join(names, ",").alias("ranked"))


def by_sets(results: DataFrame, keys: list[str], name: Column) -> DataFrame:
    """The definition by passing names: gained are those that pass after but not before, kept those that pass on both sides."""
    def passing(phase: str) -> Column:
        return F.collect_set(F.when((F.col("phase") == phase) & (F.col("status") == "PASSED"), name))

    both = results.groupBy(*keys).agg(passing("pre").alias("pre"), passing("post").alias("post"))
    from strandline.operators.setops import gained, held

    return both.select(*keys, gained(F.col("pre"), F.col("post")).alias("gained"), held(F.col("pre"), F.col("post")).alias("kept"))
