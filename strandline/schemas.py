"""Declared schemas of the engine's inputs. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import StructType


def __getattr__(name: str) -> StructType:
    """A schema by its name; DDL is parsed by a running session, so not before it is asked for."""
    if f"_{name}" not in globals() or not name.isupper():
        raise AttributeError(name)
    return StructType.fromDDL(globals()[f"_{name}"])


#: One row for each changed file of a pull request.
_PR_FILES = (
    "repo_full_name string, pr_number long, sha string, filename string, status string, additions long, deletions long, changes long, "
    "blob_url string, raw_url string, contents_url string, merge_commit_sha string, head_ref string, head_sha string, "
    "head_repo_full_name string, base_ref string, base_sha string, fail_to_pass string, pass_to_pass string"
)
_PULL_REQUESTS = (
    "number long, title string, body string, created_at string, merged_at string, diff_url string, resolved_issues array<string>, "
    "base struct<sha: string, repo: struct<full_name: string>>"
)
_TASK_INSTANCES = (
    "repo string, pull_number long, instance_id string, issue_numbers array<string>, base_commit string, merge_sha string, "
    "patch string, test_patch string, problem_statement string, hints_text string, created_at string"
)
_PREDICTIONS = (
    "instance_id string, model_name string, model_name_or_path string, full_output string, prompt_tokens long, completion_tokens long, "
    "total_tokens long, response_time double, cost double, base_commit string, error string, timestamp string, prompt string"
)
_TEST_RESULT = ("test_name string, class_name string, full_name string, status string, duration double, failure_message string, error_message string")
#: Fact table: one row for each test case of an instance before ("pre") and after ("post") a change.
_TEST_RESULTS = (
    "project string, instance_id string, phase string, pos long, class_name string, test_name string, status string, duration double, "
    "failure_message string, error_message string"
)
_EXECUTION = ("total_tests long, passed long, failed long, skipped long, errors long, duration double")
_EVALUATION_RESULT = (
    "instance_id string, model_name string, success boolean, error_message string, repo_cloned boolean, config_parsed boolean, "
    "container_created boolean, base_commit_checked_out boolean, test_patch_applied boolean, prediction_patch_applied boolean, "
    "total_duration double, test_execution struct<total_tests: long, passed: long, failed: long, skipped: long, errors: long, duration: double, "
    "exit_code: long, build_successful: boolean, passed_tests: array<string>, failed_tests: array<string>, skipped_tests: array<string>, error_tests: array<string>>"
)
_KIND_ = "struct<count: long, tests: array<string>>"
_TEST_ANALYSIS = (
    f"test_transitions struct<fail_to_pass: {_KIND_}, pass_to_pass: {_KIND_}, pass_to_fail: {_KIND_}, fail_to_fail: {_KIND_}>, "
    "execution_summary struct<pre_execution: struct<passed_count: long, failed_count: long, passed_tests: array<string>, failed_tests: array<string>>, "
    "post_execution: struct<passed_count: long, failed_count: long, passed_tests: array<string>, failed_tests: array<string>>>"
)
_TESTED_INSTANCES = (
    "instance_id string, repo string, base_commit string, FAIL_TO_PASS array<string>, PASS_TO_PASS array<string>, "
    "base_total_tests long, gold_total_tests long, java_version string, gradle_version string"
)
_JUNIT_SUITE = (
    "_name string, _tests long, _failures long, _errors long, _skipped long, _time double, "
    "testcase array<struct<_name: string, _classname: string, _time: double, failure: string, error: string, skipped: string>>"
)
_PROGRESS = ("completed_instances array<string>, failed_instances array<string>, last_update string")
