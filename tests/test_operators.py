import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
from strandline.operators import aggregates, joins, predicates, setops, sorting, transitions, windows


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def test_typed_filter_takes_strings_as_patterns_and_drops_nulls(spark):
    df = spark.createDataFrame([("abc", 1), ("ABC", 2), (None, 3), ("xbx", 4)], "s string, n int")
    assert rows(predicates.typed_filter(df, {"s": "b.", "n": (1, 3), "other": 1}), "n") == [(1,)]


def test_without_marker_keeps_nulls(spark):
    df = spark.createDataFrame([("x BUILD", None), (None, None), ("y", "BUILD"), ("y", "z")], "a string, b string")
    assert predicates.without_marker(df, ["a", "b"], "BUILD").count() == 2


def test_suffix_match_needs_a_separator(spark):
    df = spark.createDataFrame([("o__r-12",), ("o__r-112",), ("12",), ("r_12",), (None,), ("",)], "id string")
    ids = spark.createDataFrame([("12",)], "listed string")
    assert rows(predicates.suffix_match(df, ids, "id")) == [("12",), ("o__r-12",), ("r_12",)]
    assert predicates.suffix_match(df, ids, "id", allow=False).count() == 3


@pytest.mark.parametrize("log,code,ran,folded", [("BUILD SUCCESSFUL", 1, False, True), ("Build Failed", 0, False, False), ("nothing", 0, True, True), (None, None, False, False),
    ("> Task :testDebug", 1, False, True), ("Test Results: 3 Tests completed", 1, True, True), ("Execution failed for task x", 0, True, False), ("cannot find symbol; tests ran", 0, False, False)])
def test_run_classifier(spark, log, code, ran, folded):
    df = spark.createDataFrame([(log, code)], "log string, code int")
    found = df.select(predicates.tests_ran(F.col("log"), F.col("code")), predicates.tests_ran(F.col("log"), F.col("code"), fold=True)).first()
    assert tuple(found) == (ran, folded)


def test_compile_failed(spark):
    from strandline.functions import markers

    logs = [*(f"x {w.upper()} y" for w in markers.COMPILE_ERRORS), "BUILD FAILED", "does not exist", "", None]
    df = spark.createDataFrame([(x,) for x in logs], "log string")
    assert [r[0] for r in df.select(predicates.compile_failed(F.col("log"))).collect()] == [True] * 20 + [False] * 4


def test_within_limit_uses_the_least_limit(spark):
    df = spark.createDataFrame([(10,), (20,), (None,)], "n long")
    limits = spark.createDataFrame([("a", 15)], "model string, context_limit long")
    chosen = spark.createDataFrame([("a",), ("b",)], "model string")
    assert predicates.within_limit(df, F.col("n"), limits, chosen).count() == 2


def test_first_and_last_are_idempotent(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randint(0, 5), i, rng.random()) for i in range(100)] + [(None, 200, 0.1), (None, 201, 0.2)], "k int, pos long, v double")
    for f in (windows.keep_first, windows.keep_last):
        once = f(df, ["k"], [F.col("pos")])
        assert rows(once, "pos") == rows(f(once, ["k"], [F.col("pos")]), "pos") and once.count() == 7
    assert rows(windows.keep_last(df, ["k"], [F.col("pos")]), "pos") == rows(windows.keep_last_values(df, ["k"], "pos", ["v"]), "pos")


@pytest.mark.parametrize("n,size", [(3, 10), (4, 4), (5, 3), (1, 7), (2, 0)])
def test_shards_are_contiguous_and_even(spark, n, size):
    df = spark.createDataFrame([(i,) for i in range(size)], "id long").repartition(3)
    found = rows(windows.shards(df, n, [F.col("id")]), "id", "shard")
    counts = [sum(s == k + 1 for _, s in found) for k in range(n)]
    assert counts == [size // n + (k < size % n) for k in range(n)]
    assert [s for _, s in found] == sorted(s for _, s in found)


def test_take_while_is_no_filter(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, None), (2, 2, True)], "k int, n int, ok boolean")
    assert rows(windows.take_while(df, ["k"], [F.col("n")], F.col("ok")), "k", "n") == [(1, 1)]
    assert rows(windows.take_while(df, ["k"], [F.col("n")], F.col("ok"), inclusive=True), "k", "n") == [(1, 1), (1, 2), (2, 1)]


def test_running_stop_writes_less_than_it_counts(spark):
    df = spark.createDataFrame([(1, i, 3.0) for i in range(5)], "k int, n int, c double")
    out = rows(windows.running_stop(df, ["k"], [F.col("n")], F.col("c"), 9.0), "n", "counted", "written")
    assert out == [(0, True, True), (1, True, True), (2, True, False), (3, False, False), (4, False, False)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), max_size=12), st.integers(1, 20))
def test_budgets_and_chunks_against_loops(spark, sizes, budget):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "k int, pos int, s long")
    total, taken = 0, []
    for i, s in enumerate(sizes):
        if total + s < budget:
            total += s
            taken.append((i,))
    assert rows(windows.budget_fill(df, "k", ["pos"], "s", budget, []), "pos") == taken
    chunk = held = 0
    chunks = []
    for i, s in enumerate(sizes):
        if held > 0 and held + s > budget:
            chunk, held = chunk + 1, 0
        held += s
        chunks.append((i, chunk))
    assert rows(windows.chunk_greedy(df, "k", ["pos"], "s", budget, []), "pos", "chunk") == chunks


def test_lines_around_clamps(spark):
    df = spark.createDataFrame([("a\nb\nc\nd",)], "t string")
    assert df.select(windows.lines_around(F.col("t"), F.lit(1), F.lit(2), 15)).first()[0] == ["a", "b", "c"]


def test_symmetric_anti_gives_the_symmetric_difference(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([("2", 1), ("3", 2)], "k string, b int")
    assert rows(joins.symmetric_anti(a, b, "k"), "k", "side") == [("1", "left"), ("3", "right")]


def test_left_with_list_defaults_and_cuts(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, ["x", "y", "z"])], "k int, hits array<string>")
    assert rows(joins.left_with_list(a, b, "k", "hits", 2)) == [(1, ["x", "y"]), (2, [])]
    assert rows(joins.left_with_list(a, b, "k", "hits")) == [(1, ["x", "y", "z"]), (2, [])]


def test_guarded_semi_keeps_all_if_the_other_side_is_empty(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert joins.guarded_semi(a, b, "k").count() == 1 and joins.guarded_semi(a, b.where("false"), "k").count() == 2


def test_rule_match_takes_the_first_rule(spark):
    df = spark.createDataFrame([("gpt-4-mini",), ("other",), (None,)], "m string")
    out = joins.rule_match(df, F.col("m"), [("gpt-4", 1), ("mini", 2)], "r")
    assert [r["r"] for r in out.collect()] == [1, None, None]


def test_as_of_takes_the_last_at_or_before(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    b = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (1, 6, "z")], "k int, t int, v string")
    assert rows(joins.as_of(a, b, "k", "t", ["v"]), "k", "t") == [(1, 1), (1, 5), (2, 9)]
    assert {(r["k"], r["t"]): r["v"] for r in joins.as_of(a, b, "k", "t", ["v"]).collect()} == {(1, 5): "y", (1, 1): None, (2, 9): None}


def test_before_first_stops_at_the_first_late_comment(spark):
    comments = spark.createDataFrame([(1, 1, "a"), (1, 2, "c"), (1, 3, "a")], "k int, pos int, at string")
    commits = spark.createDataFrame([(1, 2, "z"), (1, 1, "b")], "k int, pos int, made string")
    assert rows(joins.before_first(comments, commits, "k", "at", "made", [F.col("pos")]), "pos") == [(1,)]


STATUSES = ["PASSED", "FAILED", "ERROR", "SKIPPED", None]


def test_transitions_of_every_pair(spark):
    data, n = [], 0
    for a in STATUSES:
        for b in STATUSES:
            for phase, s in (("pre", a), ("post", b)):
                if s:
                    data.append(("p", n, f"{a}-{b}", phase, 1, s))
            n += 1
    df = spark.createDataFrame(data, "project string, instance int, test string, phase string, pos int, status string")
    found = {r["test"]: r["kind"] for r in transitions.join_phases(df, ["project", "instance", "test"], "pos").collect()}
    for a in STATUSES:
        for b in STATUSES:
            bad = ("FAILED", "ERROR")
            want = (
                "FAIL_TO_PASS" if a in bad and b == "PASSED" else "PASS_TO_PASS" if a == b == "PASSED"
                else "PASS_TO_FAIL" if a == "PASSED" and b in bad else "FAIL_TO_FAIL" if a in bad and b in bad else None
            )
            assert found.get(f"{a}-{b}") == want
    strict = {r["test"]: r["kind"] for r in transitions.join_phases(df, ["project", "instance", "test"], "pos", ("FAILED",)).collect()}
    assert strict["ERROR-PASSED"] is None and strict["FAILED-PASSED"] == "FAIL_TO_PASS"


def test_transitions_keep_the_last_status(spark):
    df = spark.createDataFrame([("t", "pre", 1, "PASSED"), ("t", "pre", 2, "FAILED"), ("t", "post", 1, "PASSED")], "test string, phase string, pos int, status string")
    assert transitions.join_phases(df, ["test"], "pos").first()["kind"] == "FAIL_TO_PASS"


def test_total_row_is_the_sum_of_projects(spark):
    df = spark.createDataFrame([("a", 1, 2, 0, 1), ("a", 2, 0, 0, 0), ("b", 3, 5, 1, 0)], "project string, instance int, fail_to_pass long, pass_to_pass long, fail_to_fail long")
    out = {r["project"]: r for r in transitions.project_stats(df, "project", "instance", total=True).collect()}
    assert out[None]["fail_to_pass_sum"] == 7 == out["a"]["fail_to_pass_sum"] + out["b"]["fail_to_pass_sum"]
    assert out[None]["fail_to_pass_mean"] == 3.5 and out["a"]["fail_to_pass_instances"] == 1 and out["b"]["fail_to_fail_mean"] is None


def test_run_summary_has_all_three_means(spark):
    df = spark.createDataFrame([(True, 10.0, 4, 2, 2), (False, 0.0, 9, 9, 0), (False, 20.0, 1, 1, 0), (None, None, 1, 1, 0)], "success boolean, duration double, total long, passed long, failed long")
    r = aggregates.run_summary(df, []).first()
    assert (r["mean_success"], r["mean_positive"], r["mean_all"], r["total"], r["pass_rate"], r["success_rate"]) == (10.0, 15.0, 7.5, 4, 50.0, 25.0)


def test_empty_inputs_have_zero_rates(spark):
    df = spark.createDataFrame([], "success boolean, duration double, total long, passed long, failed long")
    assert aggregates.run_summary(df, []).first()["success_rate"] == 0.0
    suites = spark.createDataFrame([], "tests long, failures long, errors long, skipped long, time double")
    assert aggregates.suite_totals(suites).first()["success_rate"] == 0.0


def test_compare_runs_needs_two(spark):
    df = spark.createDataFrame([("r", True, 1.0, 1, 1, 0)], "run string, success boolean, duration double, total long, passed long, failed long")
    assert aggregates.compare_runs(df, "run").count() == 0


def test_set_operations(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], {"x": 1, "y": 2}, {"y": 3})], "a array<string>, b array<string>, m map<string,int>, n map<string,int>")
    r = df.select(setops.gained(F.col("a"), F.col("b")).alias("g"), setops.held(F.col("a"), F.col("b")).alias("h"), setops.merge_maps(F.col("m"), F.col("n")).alias("m")).first()
    assert (r["g"], r["h"], r["m"]) == (["c"], ["b"], {"x": 1, "y": 3})


def test_remaining_slots_below_zero_are_none(spark):
    df = spark.createDataFrame([(1, i, 7) for i in range(4)] + [(2, i, 2) for i in range(4)], "k int, n int, taken int")
    assert rows(sorting.remaining_slots(df, ["k"], [F.col("n")], 4, "taken"), "k", "n") == [(2, 0), (2, 1)]


def test_limit_zero_means_all(spark):
    df = spark.range(5)
    assert sorting.limited(df, [F.col("id")], 0).count() == 5 and sorting.limited(df, [F.col("id")], 2).count() == 2


def test_nearest_version(spark):
    known = [(8, 0, 0), (7, 4, 2), (7, 5, 0)]
    df = spark.createDataFrame([("7.4.1",), ("8.1",), ("nonsense",)], "v string")
    assert [r[0] for r in df.select(sorting.nearest_version(F.col("v"), known)).collect()] == ["7.4.2", "8.0.0", "7.4.2"]
