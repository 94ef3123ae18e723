"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes every document floor(r) times, and once more with the inclusion
probability r - floor(r). The flight phase moves these probabilities through the null space of the balancing
constraints (the documents' number and their tokens), a few documents at a time, until each is 0 or 1 but for at
most as many as there are constraints, and a few that are spared. A source is dealt to blocks by hash; what a block leaves open flies again with
what other blocks of the source leave, level by level, and the last few are landed by the choice nearest to balance.
Rows that are equal in every column are one class with a number: it takes the whole part of its expectation and flies
with the rest, so that no number of equal rows meets in a block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import WORD, materialise

WEIGHTS, MOST = (1.0, 2.0, 3.0), 3.0
#: Rows that one row is repeated to in one task: narrow ones and those with texts.
NARROW, WIDE = 1 << 16, 1 << 10
#: Documents in a block on average, blocks whose open documents meet, documents of a block that are left for the landing,
#: and the slack at which a probability counts as 0 or 1.
BLOCK, FAN, SPARE, EPS = 4096, 256, 10, 1e-9


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by repeating weights, each at most `most` times its size; the excess is shared anew by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while free and left > 0:
        unit = left / sum(w[i] for i in free)
        above = [i for i in free if w[i] * unit > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = w[i] * unit
            break
        for i in above:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in above]
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, spare: int = SPARE) -> np.ndarray:
    """Probabilities after the flight: between 0 and 1 are those of the last `spare`, which don't fly, and of two more at most.

    sum(p) and sum(p * size) are kept.
    """
    p = p.astype(float).copy()
    open_ = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    open_ = open_[: max(0, len(open_) - spare)]
    held = open_[:3]
    at = 3
    while len(held) == 3:
        a, b, c = held
        x, y, z = float(size[a]), float(size[b]), float(size[c])
        # u is orthogonal to (1, 1, 1) and to (x, y, z); with equal sizes two documents suffice
        u = (y - z, z - x, x - y) if not x == y == z else (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(held, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(held, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(held, u, strict=True):
            p[i] += step * v
        rest = [i for i in held if EPS < p[i] < 1 - EPS]
        for i in held:
            if i not in rest:
                p[i] = round(p[i])
        while len(rest) < 3 and at < len(open_):
            rest.append(open_[at])
            at += 1
        held = rest
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The open probabilities, SPARE + 2 at most, rounded to the 0s and 1s that keep sum(p * size) and sum(p) best."""
    p = p.copy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if n := len(open_):
        choices = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        moved = choices - p[open_]
        unit = max(1.0, float(size[open_].mean()))
        cost = np.abs(moved @ size[open_]) / unit + 0.1 * np.abs(moved.sum(axis=1))
        p[open_] = choices[int(np.argmin(cost))]
    return p


def _fly(docs: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """docs(source_no, block, row_key, doc_id, size, p, ...) with a new p: flown in each group of keys, and landed if last."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_key", "doc_key", "size"], kind="stable", ignore_index=True)
        p, size = pdf["p"].to_numpy(), pdf["size"].to_numpy()
        p = flight(p, size, np.random.default_rng([*(int(k) for k in key), len(pdf)]))
        pdf["p"] = landing(p, size) if last else p
        return pdf

    return docs.groupBy(*keys).applyInPandas(run, docs.schema)


def sizes_of(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text.cast("string"), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def keys_of(docs: DataFrame) -> tuple[Column, Column]:
    """(doc_key, row_key) of a row: rows are taken for equal if both are, that is if their doc_ids and a hash of all columns are."""
    doc_id = F.col("doc_id").cast("long")
    # maps have no hash of their own, but a text
    whole = [F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.coalesce(doc_id, F.lit(0)).alias("doc_key"), F.xxhash64(doc_id.isNull(), *whole).alias("row_key")


def source_targets(folded: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """folded(source, size, n): (source, source_no, source_size, target, classes), a row for each source, in the order of code points, null last."""
    rows = folded.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("classes")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["source_size"] for r in rows], weights, most)
    flat = [(r["source"], i, r["source_size"], t, r["classes"]) for i, (r, t) in enumerate(zip(rows, goal, strict=True))]
    return folded.sparkSession.createDataFrame(flat, "source string, source_no long, source_size long, target double, classes long")


def classes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(doc_key, row_key, doc_id, size, source_size, target, n, total): a row for each class of equal rows, n of them, which together are taken total times."""
    own = docs.select(*keys_of(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), sizes_of(F.col("text")).alias("size"))
    folded = materialise(own.groupBy("doc_key", "row_key", "doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = materialise(source_targets(folded, weights, most), "sources")
    n_most, n_sources = sources.agg(F.max("classes"), F.count("*")).first()
    n_most = n_most or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    want = ratio * F.col("n")
    # an expectation next to a whole number counts as that number
    whole = F.when(F.abs(want - F.round(want)) < 1e-12 * F.col("n"), F.round(want)).otherwise(F.floor(want)).cast("long")
    all_ = (
        folded.join(F.broadcast(sources) if n_sources <= 10_000 else sources, folded.source.eqNullSafe(sources.source))
        .drop(sources.source)
        .select(
            "source_no", "doc_key", "row_key", "doc_id", "size", "source_size", "target", "n",
            whole.alias("whole"), F.greatest(want - whole, F.lit(0.0)).alias("p"),
            F.greatest(F.lit(1), F.ceil(F.col("classes") / block)).alias("blocks"),
        )
    )
    cols = ["source_no", "block", "doc_key", "row_key", "doc_id", "size", "source_size", "target", "n", "whole", "p"]
    now = all_.withColumn("block", F.pmod(F.xxhash64("doc_key", "row_key"), F.col("blocks"))).select(*cols)
    done, blocks = [], -(-n_most // block)
    while True:
        last = blocks <= 1
        now = materialise(_fly(now, ["source_no", "block"], last), "flight")
        closed = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
        done.append(now if last else now.where(closed))
        if last:
            break
        now = now.where(~closed).withColumn("block", F.floor(F.col("block") / fan).cast("long")).select(*cols)
        blocks = -(-blocks // fan)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    total = (F.col("whole") + F.round("p").cast("long")).alias("total")
    return out.select("doc_key", "row_key", "doc_id", "size", "source_size", "target", "n", total)


def _repeated(rows: DataFrame, times: str, some: int, most: int) -> DataFrame:
    """Each row as often as `times` says, numbered from 0 in nth_. most: the largest number of times.

    Rows repeated over `some` times are dealt out anew, `some` repetitions to a task at a time.
    """
    few = rows.where(f"{times} between 1 and {some}").withColumn("nth_", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    if most <= some:
        return few
    parts = rows.where(f"{times} > {some}").withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / some))))
    begin = F.col("part_") * some
    many = parts.repartition("row_key", "part_").withColumn("nth_", F.explode(F.sequence(begin, F.least(begin + some, F.col(times)) - 1)))
    return few.unionByName(many.drop("part_"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """docs(doc_id, text, source, ...): returns (row_key, doc_id, size, source_size, target, copies, taken), a row for each row of docs.

    copies is how often the mix takes the row, at most `most` times, and taken = copies * size. Null and blank texts have
    size 0. A null source is a source of its own. A source without words has target 0 and takes nothing. Chances depend
    only on a row's columns, so reruns agree; of rows that are equal in all columns some may take one copy more than the
    others. There is a row of figures for each source on the driver: sources are names of collections, few against the documents.
    """
    found = materialise(classes(docs, weights, most, block, fan), "classes")
    rows = _repeated(found, "n", NARROW, found.agg(F.max("n")).first()[0] or 0)
    copies = (F.floor(F.col("total") / F.col("n")) + (F.col("nth_") < F.col("total") % F.col("n")).cast("long")).alias("copies")
    return rows.select("row_key", "doc_id", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it.

    Texts are shuffled once, equal rows folded before: by the keys of their class, which meet the narrow rows of the classes.
    """
    taken = materialise(classes(docs, weights, most).where("total > 0").select("doc_key", "row_key", "total"), "taken")
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_")
    folded = docs.select(*keys_of(docs), row).groupBy("doc_key", "row_key").agg(F.first("doc_").alias("doc_"))
    rows = _repeated(folded.join(taken, ["doc_key", "row_key"]), "total", WIDE, taken.agg(F.max("total")).first()[0] or 0)
    return rows.select(*[F.col("doc_").getField(c).alias(c) for c in names])
