import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from strandline.llm import mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=8))
def test_targets_share_everything_that_fits(sizes):
    t = mixing.targets(sizes)
    assert all(x <= 3 * s + 1e-6 for x, s in zip(t, sizes))
    assert abs(sum(t) - sum(sizes)) < 1e-6 * max(1, sum(sizes))  # three times the sizes always hold it
    free = [x / mixing.WEIGHTS[i % 3] for i, (x, s) in enumerate(zip(t, sizes)) if x < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(0)
    p, size = rng.random(500), rng.integers(1, 3000, 500)
    q = mixing.flight(p, size, np.random.default_rng(1))
    open_ = (q > 1e-9) & (q < 1 - 1e-9)
    assert open_.sum() <= mixing.SPARE + 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
    landed = mixing.landing(q, size)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) < 200


def test_inclusion_probabilities_hold():
    size = np.arange(1, 31)
    total = sum(mixing.flight(np.full(30, 0.3), size, np.random.default_rng(s), spare=0) for s in range(1500)) / 1500
    assert np.abs(total - 0.3).max() < 0.06


def docs_of(spark, n):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 80))), f"s{min(int(rng.integers(0, 9)), 4)}" if i % 11 else None, "en") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = docs_of(spark, 900)
    first = mixing.mix(docs, block=64, fan=4)
    rows = sorted(tuple(r[c] for c in ("doc_id", "size", "source_size", "target", "taken")) for r in first.collect())
    assert len(rows) == 900
    by = {}
    for _, size, source_size, target, taken in rows:
        assert 0 <= taken <= 3 * size
        key = (source_size, target)
        by[key] = by.get(key, 0) + taken
    assert all(abs(t - k[1]) <= 0.01 * k[1] + 80 for k, t in by.items())
    again = mixing.mix(docs.repartition(7), block=64, fan=4)
    assert rows == sorted(tuple(r[c] for c in ("doc_id", "size", "source_size", "target", "taken")) for r in again.collect())


def test_apply_mix_repeats_rows(spark):
    docs = docs_of(spark, 300)
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in mixed.items() if v}


@pytest.mark.parametrize("rows", [[], [(None, None, None, 1)], [(1, "a b", "s", 1), (1, "a b", "s", 2), (2, "", "t", 3)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    assert mixing.mix(docs).count() == len(rows)
    total = mixing.mix(docs).agg(F.sum("copies")).first()[0] or 0
    assert mixing.apply_mix(docs).count() == total


def test_many_equal_rows_share_one_class(spark):
    rows = [(7, "a b c", "s")] * 3000 + [(i, "w " * (i % 40), f"s{i % 3}") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    same = [r["copies"] for r in out if r["doc_id"] == 7]
    assert len(same) == 3000 and max(same) - min(same) <= 1 and max(same) <= 3
    target = next(r["target"] for r in out if r["doc_id"] == 7)
    assert abs(3 * sum(same) - target) <= 3
    counts = {r["doc_id"]: r["count"] for r in mixing.apply_mix(docs).groupBy("doc_id").count().collect()}
    assert counts[7] == sum(same)


def test_repeated_in_parts(spark):
    rows = spark.createDataFrame([(1, 5), (2, 1), (3, 0), (4, 23)], "row_key long, n long")
    for some, most in ((4, 23), (100, 23)):
        got = sorted((r["row_key"], r["nth_"]) for r in mixing._repeated(rows, "n", some, most).collect())
        assert got == [(k, i) for k, n in ((1, 5), (2, 1), (4, 23)) for i in range(n)]


def test_landing_is_the_best_of_all_choices():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        p, size = rng.random(n) * 0.98 + 0.01, rng.integers(0, 500, n)
        unit = max(1.0, float(size.mean()))

        def cost(choice):
            moved = [c - q for c, q in zip(choice, p)]
            return abs(sum(m * s for m, s in zip(moved, size))) / unit + 0.1 * abs(sum(moved))

        assert cost(mixing.landing(p, size)) <= min(cost(c) for c in product((0, 1), repeat=n)) + 1e-9


def test_clashing_columns(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 2}", i, "x", {"k": i}) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, total long, doc_ string, row_key map<string,int>")
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns and out.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]
