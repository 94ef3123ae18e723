"""Chat formatting with minimum-cost repair of roles.

Legal conversations run through a small automaton: a system turn may come first, then user and assistant turns alternate,
and the last is an assistant's. Dynamic programming over this automaton gives each message the role that it is rendered
with, merges it with the turn before it, or puts empty turns between, at the least sum of costs. A message's costs are a
matrix from state to state, and costs of runs of messages are products of these in (min, +), which is associative: the
messages of all conversations are dealt to segments in order, each segment gives matrices for its conversations,
the few matrices of a conversation settle the state in which each segment begins and ends (only a segment's first and last
conversation can go on in another), and then each segment is solved on its own. A conversation of any length is so repaired in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import materialise

#: States: the role rendered last, or none yet. Roles that a message can be rendered with are the states but the first.
STATES = ("none", "system", "user", "assistant")
#: Costs of a merge, an empty turn put in, and a change of role.
MERGE, INSERT, RELABEL = 1.0, 3.0, 2.0
OPEN, CLOSE, JOIN = "<|{role}|>\n", "<|end|>\n", "\n\n"
INF = float("inf")
#: Rows of an output batch.
ROWS = 4096


def _path(before: int, role: int) -> list[int] | None:
    """The empty turns between a turn of `before` and one of `role`; None if none make it legal."""
    if before == role and role == 1 or role == 1 and before > 1:
        return None
    turns, at = [], before
    while True:
        follows = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}[at]
        if role in follows:
            return turns
        at = follows[-1]
        turns.append(at)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs [role class, before, after], empty turns [before, after] as numbers, costs of ending [state]."""
    cost = np.full((len(STATES), 4, 4), INF)
    for own in range(len(STATES)):  # class 0: a role that isn't known
        for before in range(4):
            for role in range(1, 4):
                relabel = RELABEL * (own != role)
                between = _path(before, role)
                if between is not None:
                    cost[own, before, role] = relabel + INSERT * len(between)
                if before == role:
                    cost[own, before, role] = min(cost[own, before, role], relabel + MERGE)
    return cost, np.array([0.0, 2 * INSERT, INSERT, 0.0])


COST, ENDING = _tables()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).min(axis=1)


def run_matrix(classes: np.ndarray) -> np.ndarray:
    """Costs from state to state of a run of messages: products in pairs, level by level."""
    m = COST[classes]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        half = len(m) // 2 * 2
        m = np.concatenate(((m[0:half:2, :, :, None] + m[1:half:2, None]).min(axis=2), odd))
    return m[0]


_COST = COST.tolist()
_ENDING = ENDING.tolist()


def choose(classes: list[int], begin: int, end: int | None) -> list[int]:
    """The states behind each message on the cheapest path from begin to end, or to the end that is cheapest to close.

    Of equal paths it is that with the least states, last first.
    """
    best = [INF] * 4
    best[begin] = 0.0
    back = []
    for c in classes:
        step, new, source = _COST[c], [INF] * 4, [0] * 4
        for before in range(4):
            at = best[before]
            if at < INF:
                for role in (1, 2, 3):
                    x = at + step[before][role]
                    if x < new[role]:
                        new[role], source[role] = x, before
        best = new
        back.append(source)
    if end is None:
        end = min(range(4), key=lambda k: best[k] + _ENDING[k])
    states = [end]
    for source in back[:0:-1]:
        states.append(source[states[-1]])
    return states[::-1]


def settle(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(begin, end) of each of a conversation's segments."""
    best = np.array([0.0, INF, INF, INF])
    back = []
    for m in matrices:
        step = best[:, None] + m
        back.append(step.argmin(axis=0))
        best = step.min(axis=0)
    at = int((best + ENDING).argmin())
    ends = []
    for b in back[::-1]:
        ends.append((int(b[at]), at))
        at = int(b[at])
    return ends[::-1]


def _shown(text: str) -> str:
    return text.replace("<|", "< |")


def _render(before: int, state: int, text: str, last: bool) -> tuple[str, int, bool]:
    """A message's part of the rendered conversation, the empty turns before or behind it, and whether it is merged."""
    between = _path(before, state)
    merged = before == state and (between is None or INSERT * len(between) > MERGE)
    turns = [] if merged else between
    out = JOIN if merged else CLOSE if before else ""
    out += "".join(OPEN.format(role=STATES[t]) + CLOSE for t in turns)
    out += _shown(text) if merged else OPEN.format(role=STATES[state]) + _shown(text)
    behind = 0
    if last:
        out += CLOSE
        for t in {1: (2, 3), 2: (3,), 3: ()}[state]:
            out += OPEN.format(role=STATES[t]) + CLOSE
            behind += 1
    return out, len(turns) + behind, merged


def repair(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text, ...): returns a row for each message, (conv_id, turn, place, role, role_out, merged, inserted, rendered).

    Messages stand in the order of turn (null last), then role and text; place orders the rows of a conversation, and its
    `rendered` parts one after another are the repaired conversation. inserted counts the empty turns in a part. Roles other
    than system, user and assistant, in lower case, and null ones are changed at the cost of a change. Null texts are empty,
    "<|" in a text becomes "< |". Repeated rows each are a message. Null conv_ids are one conversation. Other columns are ignored.
    """
    known = {r: i for i, r in enumerate(STATES) if i}
    own = F.coalesce(*[F.when(F.lower("role") == r, i) for r, i in known.items()], F.lit(0)).cast("int")
    base = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("class", own)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text")]
    dealt = base.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialise(dealt.select("*", F.spark_partition_id().alias("segment"), F.monotonically_increasing_id().alias("place")), "messages")

    def ordered(*columns: str) -> DataFrame:
        return dealt.select(*columns).repartition("segment").sortWithinPartitions("segment", "place")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the first and the last conversation of each segment, the only ones that others can share, their matrices."""
        held: list[tuple] = []  # of the segment at hand: the first conversation, and the last so far
        out: list[tuple] = []
        for segment, conv, columns in _conversations(batches):
            if held and held[0][0] != segment:
                out += held
                held = []
            held = [*held[:1], (segment, conv, columns["class"])]
        rows = [(segment, conv, run_matrix(np.array(classes)).ravel().tolist()) for segment, conv, classes in out + held]
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["segment", "conv_id", "matrix"])

    # two rows of a segment at most, so as many as there are tasks; they settle on the driver
    edges: dict = {}
    for r in ordered("segment", "place", "conv_id", "class").mapInArrow(matrices, "segment int, conv_id long, matrix array<double>").collect():
        edges.setdefault(r["conv_id"], []).append((r["segment"], r["matrix"]))
    states: dict = {}
    for conv, parts in edges.items():
        parts.sort(key=lambda p: p[0])
        found = settle([np.array(m).reshape(4, 4) for _, m in parts])
        for i, ((segment, _), (begin, end)) in enumerate(zip(parts, found, strict=True)):
            states[segment, conv] = (begin, end, i == len(parts) - 1)

    names = ["conv_id", "turn", "place", "role", "role_out", "merged", "inserted", "rendered"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        for segment, conv, columns in _conversations(batches):
            begin, end, last = states.get((segment, conv), (0, None, True))
            found = choose(columns["class"], begin, end)
            before = begin
            for i, (now, text) in enumerate(zip(found, columns["text"], strict=True)):
                rendered, inserted, merged = _render(before, now, text, last and i == len(found) - 1)
                held["rendered"].append(rendered)
                held["inserted"].append(inserted)
                held["merged"].append(merged)
                held["role_out"].append(STATES[now])
                before = now
            held["conv_id"] += [conv] * len(found)
            for n in ("turn", "place", "role"):
                held[n] += columns[n]
            if len(held["place"]) >= ROWS:
                yield _batch(held)
                held = {n: [] for n in names}
        if held["place"]:
            yield _batch(held)

    schema = "conv_id long, turn long, place long, role string, role_out string, merged boolean, inserted long, rendered string"
    return ordered("segment", "place", "conv_id", "turn", "role", "text", "class").mapInArrow(solve, schema)


def _batch(held: dict[str, list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(held.values(), kinds, strict=True)], names=list(held))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, dict[str, list]]]:
    """(segment, conv_id, columns) of each run of rows of one segment and conversation."""
    key, held = None, None
    for b in batches:
        columns = {n: b.column(n).to_pylist() for n in b.schema.names}
        keys = list(zip(columns["segment"], columns["conv_id"], strict=True))
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != key:
                if held is not None:
                    yield (*key, held)
                key, held = keys[at], {n: [] for n in columns}
            for n, v in columns.items():
                held[n] += v[at:end]
            at = end
    if held is not None:
        yield (*key, held)
