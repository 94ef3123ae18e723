"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are rotated to their principal axes and sorted by the cells of an epsilon grid on the leading ones, with the
middle cells around the mean, so that what lies on either side of them is apart. The sorted sequence is cut into tiles
and the tiles into intervals; pairs of intervals are split recursively, and a pair whose bounding boxes are further apart
than epsilon, the distance that belongs to the least cosine, is skipped with all that it holds. What remains is a
triangular grid of interval pairs, a task each: a tile goes to as many tasks as its interval has partners, not as it has
tiles near it. Inside a task the recursion goes on down to blocks. Vectors that are spread evenly over many axes have
boxes that all touch; pairs of blocks are therefore held against each other first on the leading axes and the norm of the
rest, which bounds the cosine from above, and in full only where this bound reaches the least cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import join_hot, materialise
from strandline.llm.components import connected_components
from strandline.llm.simhash import merge

#: Grid axes, rows of a tile, rows of a block inside a task, bits that a level of intervals takes off.
AXES, TILE, LEAF, FAN_BITS = 16, 512, 512, 5
#: Intervals of tiles: as many as this, but more where one would hold more bytes of vectors.
SIDES, SIDE_BYTES = 8, 32 << 20
#: Slack of the single-precision filter, whose candidates are compared again in double precision.
SLACK = 1e-4


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>), null where it is null, zero or has null or non-finite components."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    some = F.exists(e, lambda x: F.coalesce(x != 0.0, F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(finite & some, e).alias("embedding"))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, filled up with zeros to the width, and their lengths."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    out /= np.abs(out).max(axis=1, initial=0, keepdims=True)  # neither overflow nor underflow of squares
    return out / np.linalg.norm(out, axis=1, keepdims=True), sizes


def principal_axes(classes: DataFrame, width: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading axes of the unit vectors' variance, and the mean's place on them: sums over all rows, width * width numbers on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, mean = np.zeros((width, width)), 0, np.zeros(width)
        for b in batches:
            u, _ = _matrix(b.column(0), width)
            total += u.T @ u
            mean += u.sum(axis=0)
            n += len(u)
        if n:
            flat = np.concatenate((total.ravel(), mean, [n]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

    rows = classes.select("embedding").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(width * width + width + 1)
    for r in rows:
        flat[r["at"]] = r["value"]
    n = max(flat[-1], 1.0)
    mean = flat[-1 - width : -1] / n
    _, vectors = np.linalg.eigh(flat[: width * width].reshape(width, width) / n - np.outer(mean, mean))
    basis = vectors[:, ::-1][:, :axes]
    return basis, mean @ basis


def _gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Squared least distance between boxes."""
    return (np.maximum(0.0, np.maximum(lo_b - hi_a, lo_a - hi_b)) ** 2).sum(axis=-1)


class Side:
    """Rows of an interval in grid order, with what pairs of their blocks need."""

    def __init__(self, rows: list[dict], basis: np.ndarray) -> None:
        self.cls, self.n, self.size = (np.frombuffer(b"".join(r[c] for r in rows), dtype=np.int64) for c in ("cls", "n", "size"))
        self.unit = np.frombuffer(b"".join(r["unit"] for r in rows)).reshape(len(self.cls), -1)
        at = self.unit @ basis
        rest = np.sqrt(np.maximum(0.0, (self.unit * self.unit).sum(axis=1) - (at * at).sum(axis=1)))
        self.bound = np.column_stack((at, rest)).astype(np.float32)
        begins = np.arange(0, len(at), LEAF)
        self.low, self.high = np.minimum.reduceat(at, begins), np.maximum.reduceat(at, begins)


def _pairs(a: Side, b: Side, same: bool, least: float, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows of two sides, block against block: pairs of intervals of blocks are split until they are provably distant or one block each."""

    def compare(i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        own, other = slice(i * LEAF, (i + 1) * LEAF), slice(k * LEAF, (k + 1) * LEAF)
        # the cosine is at most the product on the leading axes and that of the rests' norms
        near = a.bound[own] @ b.bound[other].T >= least - SLACK
        x, y = np.nonzero(near)
        if len(x) > near.size // 16:
            x, y = np.nonzero(a.unit[own] @ b.unit[other].T >= least)
            x, y = x + i * LEAF, y + k * LEAF
        else:
            x, y = x + i * LEAF, y + k * LEAF
            exact = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= least
            x, y = x[exact], y[exact]
        keep = a.size[x] == b.size[y]
        if same:
            keep &= x < y
        return x[keep], y[keep]

    def recurse(i: int, j: int, k: int, l: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if _gap(a.low[i:j].min(0), a.high[i:j].max(0), b.low[k:l].min(0), b.high[k:l].max(0)) > limit:
            return
        if j - i == 1 and l - k == 1:
            yield compare(i, k)
            return
        for p, q in ((i, (i + j) // 2), ((i + j) // 2, j)) if j - i > 1 else ((i, j),):
            for r, t in ((k, (k + l) // 2), ((k + l) // 2, l)) if l - k > 1 else ((k, l),):
                if not (same and t <= p):
                    yield from recurse(p, q, r, t)

    if len(a.low) and len(b.low):
        yield from recurse(0, len(a.low), 0, len(b.low))


def tiles(classes: DataFrame, basis: np.ndarray, centre: np.ndarray, width: int, eps: float, tile: int = TILE) -> DataFrame:
    """The classes in grid order, cut into tiles: (part, number) and bounding box, and the rows' class, count, length and vector as bytes."""
    d = basis.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, sizes = _matrix(b.column(2), width)
            cells = np.floor((u @ basis - centre) / eps + 0.5).astype(np.int32)
            columns = [b.column(0), b.column(1), pa.array(sizes.astype(np.int32)), pa.array([x.tobytes() for x in u], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(cells[:, k]) for k in range(d))], names=["cls", "n", "size", "unit", *(f"c{k}" for k in range(d))])

    cells = [f"c{k}" for k in range(d)]
    schema = "cls long, n long, size int, unit binary, " + ", ".join(f"{c} int" for c in cells)
    placed = classes.select("cls", "n", "embedding").mapInArrow(project, schema)
    ordered = placed.repartitionByRange(*cells, "cls").sortWithinPartitions(*cells, "cls").drop(*cells)
    box = [f"{side}{k}" for k in range(d) for side in ("lo", "hi")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, number = 0, 0

        def give(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            units = b"".join(t.column("unit").to_pylist())
            at = np.frombuffer(units).reshape(t.num_rows, -1) @ basis
            bounds = [v for k in range(d) for v in (at[:, k].min(), at[:, k].max())]
            values = [t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("cls", "n", "size")]
            out = [pa.array([t.column("part")[0].as_py()]), pa.array([number]), *(pa.array([float(v)]) for v in bounds), *(pa.array([v], pa.binary()) for v in [*values, units])]
            number += 1
            return pa.RecordBatch.from_arrays(out, names=["part", "number", *box, "cls", "n", "size", "unit"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= tile:
                t = pa.Table.from_batches(held)
                while t.num_rows >= tile:
                    yield give(t.slice(0, tile))
                    t = t.slice(tile)
                held, rows = t.to_batches(), t.num_rows
        if rows:
            yield give(pa.Table.from_batches(held))

    out = "part long, number long, " + ", ".join(f"{c} double" for c in box) + ", cls binary, n binary, size binary, unit binary"
    return ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(cut, out)


def intervals(cut: DataFrame, width: int, tile: int = TILE, sides: int = SIDES) -> DataFrame:
    """The tiles with their number in the sequence and that of their interval: consecutive tiles, as many in each."""
    counts = {r["part"]: r["n"] for r in cut.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    total, starts, at = sum(counts.values()), [], 0
    for part in sorted(counts):
        starts.append((part, at))
        at += counts[part]
    each = max(1, min(-(-total // sides), SIDE_BYTES // (tile * width * 8)))
    begun = cut.sparkSession.createDataFrame(starts, "part long, begin long")
    numbered = cut.join(F.broadcast(begun), "part").withColumn("tile", F.col("begin") + F.col("number")).drop("part", "number", "begin")
    return numbered.withColumn("side", F.floor(F.col("tile") / each).cast("long"))


def _apart(a: str, b: str, axes: int) -> Column:
    """Squared least distance between two rows' boxes."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{b}.lo{k}") - F.col(f"{a}.hi{k}"), F.col(f"{a}.lo{k}") - F.col(f"{b}.hi{k}")) for k in range(axes)]
    return reduce(lambda x, y: x + y, [g * g for g in gaps])


def boxes(cut: DataFrame, node: Column, axes: int) -> DataFrame:
    """(node, box) around the rows' boxes."""
    ends = [g(f"{s}{k}").alias(f"{s}{k}") for k in range(axes) for s, g in (("lo", F.min), ("hi", F.max))]
    return cut.groupBy(node.alias("node")).agg(*ends)


def near_sides(sides: DataFrame, axes: int, eps: float) -> DataFrame:
    """sides(node, box). Pairs (pa, pb), pa <= pb, of nodes whose boxes are within eps, by splitting pairs of sequence intervals level by level."""
    levels = [sides]
    top = sides.agg(F.max("node")).first()[0] or 0
    while top:
        top >>= FAN_BITS
        levels.append(boxes(levels[-1], F.shiftright("node", FAN_BITS), axes))
    pairs = levels[-1].select(F.col("node").alias("pa"), F.col("node").alias("pb"))
    for nodes in levels[-2::-1]:
        nodes = nodes.withColumn("up", F.shiftright("node", FAN_BITS))
        split = pairs.join(nodes.alias("a"), F.col("pa") == F.col("a.up")).join(nodes.alias("b"), F.col("pb") == F.col("b.up"))
        pairs = split.where((F.col("a.node") <= F.col("b.node")) & (_apart("a", "b", axes) <= eps * eps * (1 + 1e-9))).select(F.col("a.node").alias("pa"), F.col("b.node").alias("pb"))
    return pairs


def link_sides(cut: DataFrame, basis: np.ndarray, least: float, eps: float) -> DataFrame:
    """cut: tiles with their intervals. (u, v, links): for each pair of intervals a row for each linked class with the links that it has there, weighted by copies, and links (u, v) that join what the pair joins."""
    limit, axes = eps * eps * (1 + 1e-9), basis.shape[1]
    empty = {"u": pa.int64(), "v": pa.int64(), "links": pa.int64()}

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["second", "tile", "cls", "n", "size", "unit"]).to_pylist(), key=lambda r: (r["second"], r["tile"]))
        split = [[r for r in rows if r["second"] == k] for k in (0, 1)]
        same = table.column("pa")[0].as_py() == table.column("pb")[0].as_py()
        a = Side(split[0], basis) if split[0] else None
        b = a if same else Side(split[1], basis) if split[1] else None
        if a is None or b is None:
            return pa.table([pa.array([], t) for t in empty.values()], schema=pa.schema(empty))
        shift = 0 if same else len(a.cls)
        count, labels = np.zeros(shift + len(b.cls), dtype=np.int64), np.arange(shift + len(b.cls))
        for x, y in _pairs(a, b, same, least, limit):
            count += np.bincount(x, weights=b.n[y], minlength=len(count)).astype(np.int64)
            count += np.bincount(y + shift, weights=a.n[x], minlength=len(count)).astype(np.int64)
            labels = merge(labels, x, y + shift)
        cls = a.cls if same else np.concatenate((a.cls, b.cls))
        linked, moved = np.flatnonzero(count), np.flatnonzero(labels != np.arange(len(labels)))
        u, v = np.concatenate((cls[linked], cls[moved])), np.concatenate((cls[linked], cls[labels[moved]]))
        links = np.concatenate((count[linked], np.zeros(len(moved), dtype=np.int64)))
        return pa.table([pa.array(u), pa.array(v), pa.array(links)], schema=pa.schema(empty))

    around = boxes(cut, F.col("side"), axes)
    pairs = near_sides(around, axes, eps)
    halves = F.explode(F.when(F.col("pa") == F.col("pb"), F.array(F.struct(F.col("pa").alias("side"), F.col("pb").alias("other"), F.lit(0).alias("second")))).otherwise(
        F.array(*[F.struct(F.col(x).alias("side"), F.col(y).alias("other"), F.lit(k).alias("second")) for k, (x, y) in enumerate((("pa", "pb"), ("pb", "pa")))])
    ))
    sent = pairs.select("pa", "pb", halves.alias("h")).select("pa", "pb", "h.*").join(around.alias("o"), F.col("other") == F.col("o.node")).alias("h")
    # a tile that is far from the whole other interval isn't sent
    both = sent.join(cut.alias("t"), F.col("h.side") == F.col("t.side")).where(_apart("t", "h", axes) <= limit)
    return both.select("pa", "pb", "second", "t.tile", "t.cls", "t.n", "t.size", "t.unit").groupBy("pa", "pb").applyInArrow(run, "u long, v long, links long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, axes: int = AXES, tile: int = TILE) -> DataFrame:
    """vectors(vec_id, embedding, ...): returns (vec_id, n_links, component_id, kept), a row for each row of vectors.

    Vectors link at a cosine of `least` or more, in double precision. Equal vectors are folded first and count with their
    number. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Rows that share a vec_id each count. A null vec_id stays and is never kept. Other columns are ignored.
    """
    rows = usable(vectors)
    folded = rows.where("embedding is not null").groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    classes = materialise(folded.withColumn("cls", F.monotonically_increasing_id()), "classes")
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    basis, centre = principal_axes(classes, width, min(axes, width))
    eps = float(np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9)
    cut = materialise(intervals(materialise(tiles(classes, basis, centre, width, eps, tile), "cut"), width, tile), "tiles")
    found = materialise(link_sides(cut, basis, least, eps), "links")
    counts = found.where("links > 0").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("links = 0").select("u", "v"))
    labelled = classes.select("cls", "least_id").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least_id", F.coalesce("root", "cls").alias("root"))
    least_of = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least_of, "root").join(counts, "cls", "left").select("cls", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    by_vector = materialise(classes.join(named, "cls").select("embedding", "component_id", "n", (F.col("links") + F.col("n") - 1).alias("n_links")), "named")
    joined = join_hot(rows.where("embedding is not null"), by_vector, "embedding", "n").select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
