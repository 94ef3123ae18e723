import math

import numpy as np
import pytest
from strandline.llm import embeddings

NAN, INF = float("nan"), float("inf")


def plain(rows, least):
    good = [(i, np.array(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in rows]
    links = {k: set() for k in range(len(rows))}
    at = {k: n for n, k in enumerate(range(len(rows)))}
    units = {k: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for k, (i, v) in enumerate(rows) if any(i == j and v == list(u) for j, u in good)}
    for a in units:
        for b in units:
            if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k in at:
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out.append((ids[k], len(links[k]), min(ids[n] for n in seen)))
    return sorted(out)


@pytest.mark.parametrize("tile,axes", [(16, 4), (512, 10)])
def test_against_brute_force(spark, monkeypatch, tile, axes):
    monkeypatch.setattr(embeddings, "LEAF", 8)
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(12, 10))
    vectors = [(centres[i % 12] + rng.normal(scale=0.12, size=10)).tolist() for i in range(240)]
    vectors += [vectors[0]] * 9 + [[2 * x for x in vectors[1]]] * 3
    vectors += [None, [], [0.0] * 10, [NAN] + [1.0] * 9, [INF] + [1.0] * 9, [None] + [1.0] * 9, [1.0], [2.0], [1e-200] * 10, [1e200] * 10]
    rows = list(enumerate(vectors, start=7))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r)[:3] for r in embeddings.near_duplicates(df, 0.95, axes, tile).collect())
    assert got == plain(rows, 0.95)


def sides_of(spark, vectors, tile, sides=8, axes=4):
    width = len(vectors[0])
    classes = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vectors)], "cls long, n long, embedding array<double>")
    basis, centre = embeddings.principal_axes(classes, width, axes)
    cut = embeddings.intervals(embeddings.tiles(classes, basis, centre, width, math.sqrt(0.1), tile).persist(), width, tile, sides).persist()
    return cut, basis


def test_far_sides_are_skipped(spark):
    rng = np.random.default_rng(3)
    spots = np.eye(6)
    cut, _ = sides_of(spark, [(spots[i % 6] + rng.normal(scale=0.01, size=6)).tolist() for i in range(600)], 10, 40)
    n = cut.select("side").distinct().count()
    pairs = embeddings.near_sides(embeddings.boxes(cut, cut.side, 4), 4, math.sqrt(0.1)).count()
    assert n <= pairs < n * (n + 1) / 2 / 2
    numbers = sorted(r["tile"] for r in cut.select("tile").collect())
    assert numbers == list(range(len(numbers)))


def test_evenly_spread_vectors(spark, monkeypatch):
    """A tile is sent to at most as many tasks as there are intervals, and few pairs get past the bound on the leading axes."""
    rng = np.random.default_rng(8)
    sent = {}
    for n in (1000, 5000):  # several tiles in each of the eight intervals
        vectors = rng.normal(size=(n, 64)).tolist()
        cut, basis = sides_of(spark, vectors, 32, axes=16)
        n_tiles = cut.count()
        pairs = embeddings.near_sides(embeddings.boxes(cut, cut.side, 16), 16, math.sqrt(0.1))
        assert pairs.count() <= 36
        per = {r["side"]: r["count"] for r in cut.groupBy("side").count().collect()}
        sent[n] = sum(per[r["pa"]] + (per[r["pb"]] if r["pa"] != r["pb"] else 0) for r in pairs.collect()) / n_tiles
        assert sent[n] <= 8
        if n == 1000:
            monkeypatch.setattr(embeddings, "LEAF", 64)
            side = embeddings.Side(sorted((r.asDict() for r in cut.collect()), key=lambda r: r["tile"]), basis)
            assert (side.bound @ side.bound.T >= 0.95 - embeddings.SLACK).sum() < n + 0.01 * n * n
            assert np.all(side.bound.astype(float) @ side.bound.T.astype(float) >= side.unit @ side.unit.T - 1e-6)
    assert sent[5000] <= 1.2 * sent[1000]


def test_a_common_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000 + i, [float(i % 70), 1.0, -2.0]) for i in range(700)]
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(out) == 3700 and all(out[i]["n_links"] == 2999 and out[i]["component_id"] == 0 for i in range(3000))


@pytest.mark.parametrize("rows", [[], [(1, None, "x")], [(None, [1.0, 2.0], "x"), (3, [1.0, 2.0], "y"), (3, [1.0, 2.0], "z")]])
def test_edges(spark, rows):
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string")).collect()
    assert len(out) == len(rows)
    if len(rows) == 3:
        assert sorted((r["n_links"], r["component_id"]) for r in out) == [(2, 3)] * 3 and sum(r["kept"] for r in out) == 2
