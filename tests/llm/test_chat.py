import itertools
import random
import re

import numpy as np
import pytest
from strandline.llm import chat

LEGAL = re.compile(r"^(?:S)?(?:UA)*$")


def plain_cost(roles, longest=3):
    """Least cost over all role choices, merges and empty turns, tried one by one."""
    if not roles:
        return 0.0
    best = float("inf")
    for out in itertools.product("SUA", repeat=len(roles)):
        for merge in itertools.product((False, True), repeat=len(roles) - 1):
            if any(m and out[i] != out[i + 1] for i, m in enumerate(merge)):
                continue
            turns = [out[0]] + [out[i + 1] for i, m in enumerate(merge) if not m]
            cost = chat.RELABEL * sum(a != b for a, b in zip(out, roles)) + chat.MERGE * sum(merge)
            best = min(best, cost + chat.INSERT * plain_inserts(turns))
    return best


def plain_inserts(turns):
    """Empty turns that make a sequence legal, least number; infinite if none do."""
    frontier, target, n = {0: ""}, "".join(turns), 0
    states = {(0, ""): 0}
    todo = [(0, "", 0)]
    best = float("inf")
    while todo:
        at, role, n = todo.pop(0)
        if n >= best:
            continue
        if at == len(target) and role in ("A", ""):
            best = n
            continue
        for nxt in {"": "SU", "S": "U", "U": "A", "A": "U"}[role]:
            step = (at + 1, nxt, n) if at < len(target) and target[at] == nxt else None
            for cand in filter(None, (step, (at, nxt, n + 1) if n < 6 else None)):
                if states.get(cand[:2], 99) > cand[2]:
                    states[cand[:2]] = cand[2]
                    todo.append(cand)
    return best


NAMES = {"S": "system", "U": "user", "A": "assistant", "X": "tool"}


def dp_cost(roles):
    best = np.array([0.0] + [chat.INF] * 3)
    for r in roles:
        best = (best[:, None] + chat.COST["XSUA".index(r)]).min(axis=0)
    return float((best + chat.ENDING).min())


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_cost_is_least(n):
    for roles in itertools.product("SUAX", repeat=n):
        assert dp_cost(roles) == plain_cost(roles), roles


def test_products_of_runs_equal_steps():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 101):
        classes = rng.integers(0, 4, n)
        m = chat.COST[classes[0]]
        for c in classes[1:]:
            m = chat.product(m, chat.COST[c])
        assert np.array_equal(m, chat.run_matrix(classes))


def turns_of(text):
    return [{"system": "S", "user": "U", "assistant": "A"}[r] for r in re.findall(r"<\|(system|user|assistant)\|>\n", text)]


def test_rendered_conversations_are_legal_and_whole(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "Tool", "USER", None]), f"c{conv}t{turn}<|x"))
    rows += [(100, t, rng.choice(["user", "assistant"]), f"c100t{t}") for t in range(700)]  # larger than a segment
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small data have several segments
    try:
        out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == len(rows)
    by = {}
    for r in sorted(out, key=lambda r: (r["conv_id"], r["place"])):
        by.setdefault(r["conv_id"], []).append(r)
    for conv, parts in by.items():
        text = "".join(p["rendered"] for p in parts)
        turns = turns_of(text)
        assert LEGAL.match("".join(turns)), (conv, turns)
        assert text.count(chat.CLOSE) == len(turns) and text.endswith(chat.CLOSE)
        assert [int(x) for x in re.findall(rf"c{conv}t(\d+)", text)] == sorted(p["turn"] for p in parts)
        cost = sum(chat.MERGE * p["merged"] + chat.INSERT * p["inserted"] + chat.RELABEL * (((p["role"] or "x").lower()) != p["role_out"]) for p in parts)
        roles = [{"system": "S", "user": "U", "assistant": "A"}.get((p["role"] or "").lower(), "X") for p in parts]
        assert cost == dp_cost(roles)
    segments = {p["place"] >> 33 for p in by[100]}
    assert len(segments) > 1


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, 1)], [(1, 0, "user", "a", 1), (1, 0, "user", "a", 2)]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place long")
    out = chat.repair(df).collect()
    assert len(out) == len(rows)
    if len(rows) == 2:
        assert sorted(r["role_out"] for r in out) == ["assistant", "user"]  # a change costs less than a merge and an empty turn
