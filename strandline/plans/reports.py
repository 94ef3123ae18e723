"""Reports: operators put together from scan to result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandline.operators import aggregates, transitions
from strandline.sources.sinks import report


def transition_report(results: DataFrame, project: str = "project", instance: str = "instance_id") -> DataFrame:
    """results(project, instance, class_name, test_name, phase, pos, status): a row for each project and one for all."""
    keys = [project, instance, "class_name", "test_name"]
    joined = transitions.join_phases(results, keys, "pos")
    return transitions.project_stats(transitions.per_instance(joined, [project, instance]), project, instance, total=True)


def evaluation_rows(results: DataFrame) -> DataFrame:
    """Nested evaluation results as the flat rows that run summaries take."""
    t = F.col("test_execution")
    return results.select(
        "instance_id", "model_name", "success", F.col("total_duration").alias("duration"), F.col("error_message"),
        *[F.coalesce(t[a], F.lit(0)).alias(b) for a, b in (("total_tests", "total"), ("passed", "passed"), ("failed", "failed"))],
    )


def evaluation_text(results: DataFrame, title: str) -> str:
    """The report of one run, of one row of figures."""
    row = aggregates.run_summary(evaluation_rows(results), []).first()
    return report(title, list(row.asDict().items()) if row else [])


def cases_of(analysis: DataFrame, kind: str) -> DataFrame:
    """Tests of one transition in analysis documents, a row each."""
    return analysis.select("project", "instance", F.posexplode(F.col(f"test_transitions.{kind}.tests")).alias("pos", "test"))
