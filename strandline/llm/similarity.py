"""Near-duplicates by SimHash and the Jaccard similarity of word shingles: candidates from BK-trees, each link confirmed exactly.

Texts of equal shingle sets are folded first. Sets are dealt to shards, each shard has a BK-tree of its sets' 64-bit SimHash
fingerprints, each fingerprint is looked up in its shard's tree, and what lies within the radius is compared exactly: only
a similarity of at least `least` links. The radius follows from `least`: a pair at 0.8 differs in 9.7 bits on average and
lies beyond 29 with a probability below MISS. Fingerprints that differ in so many bits agree on no bit block that could deal
them (64 bits cut in 30 blocks leave one block of two bits in common), so the shards come from the shingles themselves:
BANDS bands of ROWS minima each deal the sets to buckets, and a pair of similarity s meets in some bucket with probability
1 - (1 - s ** ROWS) ** BANDS, 0.9999 at 0.8. Every set is tied to the least of each of its buckets, so the ties grow with the
sets, not with their pairs. What is tied together is one group, and a group is a shard. One of more than BLOCK sets is dealt
to blocks, each a shard of its own. Then a few leaders of the group's largest component are held against all blocks; what
links to them is one component, inside which nothing more is to be found. The sets that are left over are looked up in the
trees of all blocks, block against block, so that no link is lost and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.llm.common import binary, join_hot, materialise, trimmed
from strandline.llm.components import connected_components
from strandline.llm.simhash import BITS, CHUNK, build_trees, look_up, majority, merge, shingle_hashes, tree_hits

ROWS, BANDS, SEED = 5, 24, 7
#: Texts whose groups are solved together, and sets of a group in a block on average.
HELD, BLOCK = 1 << 13, 512
#: How often leaders are chosen, and leaders of a group at a time.
ROUNDS, LEADERS = 3, 8
#: The share of links that may lie beyond the radius, and the largest sets of which each size is tried for it.
MISS, SMALL = 1e-6, 24
#: Tree nodes met and shingles of whole shards held at once.
MET, SHINGLES = 1 << 18, 1 << 20


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; none for a text without words."""
    return [np.unique(np.array(shingle_hashes(t, width), dtype=np.uint64)) for t in texts]


def set_digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _parts(sizes: np.ndarray) -> list[np.ndarray]:
    """The sets that aren't empty, CHUNK shingles at a time."""
    full = np.flatnonzero(sizes)
    return np.split(full, np.flatnonzero(np.diff((np.cumsum(sizes[full]) - 1) // CHUNK)) + 1) if len(full) else []


def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash fingerprints, in which each distinct shingle counts once, as in the similarity; 0 for an empty set."""
    out = np.zeros(len(sets), dtype=np.uint64)
    for rows in _parts(np.array([len(s) for s in sets], dtype=np.int64)):
        out[rows] = majority([sets[i] for i in rows])
    return out


def _bit_differs(a: int, b: int, shared: int) -> float:
    """How often a bit of the fingerprints of sets of a and b hashes differs."""
    common, only_a, only_b = ([comb(n, k) / 2**n for k in range(n + 1)] for n in (shared, a - shared, b - shared))
    out = 0.0
    for k, p in enumerate(common):
        one, other = (sum(q for i, q in enumerate(only) if 2 * (k + i) > n) for only, n in ((only_a, a), (only_b, b)))
        out += p * (one * (1 - other) + other * (1 - one))
    return out


@lru_cache
def tree_radius(least: float) -> int:
    """The least radius that a pair of similarity `least` or more exceeds with a probability of at most MISS.

    Bits of a fingerprint are independent of one another. For large sets one differs by the angle between the sets; for
    small ones, where it may be more, all sizes are tried.
    """
    sizes = [(a, b, c) for b in range(1, SMALL + 1) for a in range(1, b + 1) for c in range(1, a + 1) if c < b and c >= least * (a + b - c) - 1e-9]
    p = max([acos(min(1.0, 2 * least / (1 + least))) / pi, *(_bit_differs(*x) for x in sizes)])
    radius, beyond = BITS, 0.0
    while radius and (beyond := beyond + comb(BITS, radius) * p**radius * (1 - p) ** (BITS - radius)) <= MISS:
        radius -= 1
    return radius


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; zeros for an empty one."""
    rng = np.random.default_rng(SEED)
    flips = rng.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64)
    factors = rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    for rows in _parts(sizes):
        flat = np.concatenate([sets[i] for i in rows])
        starts = np.concatenate(([0], np.cumsum(sizes[rows])[:-1]))
        for band in range(BANDS):
            key = np.full(len(rows), band, dtype=np.uint64)
            for i in range(band * ROWS, (band + 1) * ROWS):
                mixed = (flat ^ flips[i]) * factors[i]
                mixed ^= mixed >> np.uint64(32)
                mixed *= factors[i - 1]
                low = np.minimum.reduceat(mixed, starts)
                key = (key ^ low) * factors[i]
                key ^= key >> np.uint64(29)
            out[rows, band] = key
    return out


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(text.cast("string"))


def with_bands(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, digest, bands), a row for each row of docs."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(binary(b.column(2)), width)
            digests = pa.array(np.array([set_digest(s) for s in sets], dtype=np.uint64).view(np.int64))
            flat = pa.array(bands(sets).view(np.int64).ravel())
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), digests, pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "text_key", "digest", "bands"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, digest long, bands array<long>")


def link_sets(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the first that it reaches by links of Jaccard similarity `least` or more."""
    return link_shards(sets, np.zeros(len(sets), dtype=np.int64), least, tree_radius(least))


def link_shards(sets: list[np.ndarray], shard: np.ndarray, least: float, radius: int) -> np.ndarray:
    """For each set the first of its shard that it reaches by links. shard: for each set the first set of its shard, in order.

    Each is looked up in its shard's tree; what a lookup finds is compared exactly, unless the two are joined already.
    """
    labels = np.arange(len(sets))
    total = np.cumsum([len(s) for s in sets])[shard] // SHINGLES if len(sets) else shard
    cuts = np.flatnonzero(np.diff(total)) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sets)], strict=True):
        alike, found = alike_pairs(sets[a:z], least), np.arange(z - a)
        for q, node in tree_hits(set_prints(sets[a:z]), shard[a:z] - a, radius, MET):
            apart = (q > node) & (found[q] != found[node])
            q, node = q[apart], node[apart]
            same = alike(q, node)
            found = merge(found, q[same], node[same])
        labels[a:z] = found + a
    return labels


def alike_pairs(sets: list[np.ndarray], least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that says of pairs of the sets which have a Jaccard similarity of `least` or more; two empty sets have."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    words, codes = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (sizes, sizes)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(words), dtype=bool)

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(np.unique(b)) < len(np.unique(a)):
            a, b = b, a
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        shared = np.zeros(len(a), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(a)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)], strict=True) if len(a) else ():
            own = codes[starts[a[lo]] : starts[a[lo]] + sizes[a[lo]]]
            flat, ends = _gather(codes, starts, sizes, b[lo:hi])
            marked[own] = True
            sums = np.concatenate(([0], np.cumsum(marked[flat], dtype=np.int64)))
            marked[own] = False
            shared[lo:hi] = sums[ends] - sums[ends - sizes[b[lo:hi]]]
        out = np.empty(len(a), dtype=bool)
        out[order] = shared >= least * (sizes[a] + sizes[b] - shared) - 1e-9
        return out

    return alike


def _gather(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the named rows, one after another, and where each row's end."""
    ends = np.cumsum(sizes[rows])
    begin = np.repeat(starts[rows] - np.concatenate(([0], ends[:-1])), sizes[rows]) if len(rows) else np.empty(0, np.int64)
    return codes[begin + np.arange(len(begin))], ends


def confirmed(members: DataFrame, width: int, least: float) -> DataFrame:
    """members(group, block, several, digest, text), dealt and sorted by group and block, of one text a digest.

    Returns (group, block, digest, root, hashes, fp): for each set the least of its block that links reach. hashes and fp are
    the set's where the group has several blocks; sets of other groups that are their own root are left out.
    """
    wide, radius = pa.list_(pa.int64()), tree_radius(least)

    def solve(groups: np.ndarray, blocks: np.ndarray, several: np.ndarray, digests: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        head = np.concatenate(([True], (groups[1:] != groups[:-1]) | (blocks[1:] != blocks[:-1])))
        roots = digests[link_shards(sets, np.flatnonzero(head)[np.cumsum(head) - 1], least, radius)]
        told = np.flatnonzero((roots != digests) | several)
        hashes = pa.array([sets[i].view(np.int64) if several[i] else None for i in told.tolist()], wide)
        fps = pa.array(set_prints([sets[i] if several[i] else sets[i][:0] for i in told.tolist()]).view(np.int64), mask=~several[told])
        return pa.RecordBatch.from_arrays([*(pa.array(x[told]) for x in (groups, blocks, digests, roots)), hashes, fps], names=["group", "block", "digest", "root", "hashes", "fp"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        sets: list[np.ndarray] = []
        for b in batches:
            held.append((*(b.column(i).to_numpy(zero_copy_only=False) for i in range(4)),))
            sets += shingle_sets(binary(b.column(4)), width)
            if len(sets) >= HELD:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])  # the last block may go on
                if cut := int(np.argmax(last)):
                    yield solve(*(x[:cut] for x in columns), sets[:cut])
                held, sets = [(*(x[cut:] for x in columns),)], sets[cut:]
        if sets:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)), sets)

    return members.mapInArrow(run, "group long, block long, digest long, root long, hashes array<long>, fp long")


def with_prints(wide: DataFrame) -> DataFrame:
    """wide(hashes, ...) with fp, the fingerprint of the hashes."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [x.values.to_numpy().view(np.uint64) for x in b.column(b.schema.get_field_index("hashes"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(set_prints(sets).view(np.int64))], names=[*b.schema.names, "fp"])

    return wide.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in wide.schema)}, fp long")


def _alike(a: Column, b: Column, least: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= least * (F.size(a) + F.size(b) - shared) - 1e-9


def across_blocks(wide: DataFrame, least: float) -> DataFrame:
    """wide(group, block, digest, root, hashes, and fp if it is known): sets of groups of several blocks. Returns links (u, v) between roots that join what links across blocks join."""
    wide, radius = wide if "fp" in wide.columns else with_prints(wide), tree_radius(least)
    parts = materialise(wide.groupBy("group", "root").agg(F.count("*").alias("n")), "parts")
    sizes = materialise(parts.groupBy("group").agg(F.sum("n").alias("size")), "group-sizes")
    own = parts.groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("root"))
    joined, fresh, links = own, own, []
    for _ in range(ROUNDS):
        ranked = fresh.join(parts, ["group", "root"]).withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "root")))
        chosen = ranked.where(F.col("rank") <= LEADERS).select(F.col("group"), F.col("root").alias("leader"))
        sets = wide.where("digest = root").select(F.col("digest").alias("leader"), F.col("hashes").alias("told"), F.col("fp").alias("print"))
        leaders = chosen.join(sets, "leader").groupBy("group").agg(F.collect_list(F.struct("leader", "told", "print")).alias("leaders"))
        rest = wide.join(joined, ["group", "root"], "left_anti")
        met = join_hot(rest, materialise(leaders.join(sizes, "group"), "leaders"), "group", "size")
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("x.print"))) <= radius
        each = met.select("group", "root", "hashes", "fp", F.explode("leaders").alias("x")).where(near & _alike(F.col("hashes"), F.col("x.told"), least))
        hits = materialise(each.groupBy("group", "root").agg(F.min("x.leader").alias("v")), "met")
        links.append(hits.select(F.col("root").alias("u"), "v"))
        fresh = hits.select("group", "root")
        joined = materialise(joined.unionByName(fresh), "joined")
        if not fresh.take(1):
            break
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    left = materialise(wide.join(joined, ["group", "root"], "left_anti"), "left")
    if not left.take(1):
        return out
    of_group = left.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("lefts")).join(sizes.select("group", F.ceil(F.col("size") / BLOCK).alias("blocks")), "group")
    last = [F.sequence(F.lit(0).cast("long"), F.col(n) - 1) for n in ("blocks", "lefts")]
    of_group = materialise(of_group.join(sizes, "group"), "left-sizes")
    columns = ["group", "part", "block", "root", "hashes", "fp", "side"]
    query = join_hot(left.drop("block"), of_group, "group", "size").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("lefts"))).withColumn("block", F.explode(last[0])).withColumn("side", F.lit(0))
    every = join_hot(wide, of_group, "group", "size").withColumn("part", F.explode(last[1])).withColumn("side", F.lit(1))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "descending")])
        side, root, fps = (table.column(c).to_numpy() for c in ("side", "root", "fp"))
        members, fps = int((side == 1).sum()), fps.view(np.uint64)
        found = set()
        if 0 < members < len(side):
            alike = alike_pairs([x.values.to_numpy() for x in table.column("hashes").combine_chunks()], least)
            tree = build_trees(fps[:members], np.zeros(members, dtype=np.int64))
            lookups = np.arange(members, len(side))
            for q, node in look_up(fps, tree, lookups, np.zeros(len(lookups), dtype=np.int64), radius):
                apart = root[q] != root[node]
                q, node = q[apart], node[apart]
                same = alike(q, node)
                found |= set(zip(root[q[same]].tolist(), root[node[same]].tolist(), strict=True))
        u, v = ([x[k] for x in sorted(found)] for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    both = query.select(*columns).unionByName(every.select(*columns))
    return out.unionByName(both.groupBy("group", "part", "block").applyInArrow(compare, "u long, v long"))


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs(doc_id, text, ...): returns (doc_id, text_key, component), a row for each row of docs.

    Texts link if a tree finds their fingerprints and the Jaccard similarity of their sets of `width`-word shingles is at least
    `least`; component is the same for all that links reach. A text of fewer words is one shingle; null, empty and blank texts link with one another.
    """
    prints = materialise(with_bands(docs, width), "bands")
    bucket = prints.where("bands[0] <> 0").select("digest", F.explode("bands").alias("bucket"))
    least_of = bucket.groupBy("bucket").agg(F.min("digest").alias("hub"), F.max("digest").alias("last")).where("hub <> last")
    ties = bucket.join(least_of.select("bucket", "hub"), "bucket").where("digest <> hub").select(F.col("digest").alias("u"), F.col("hub").alias("v")).distinct()
    groups = materialise(connected_components(ties).select(F.col("node").alias("digest"), F.col("root").alias("group")), "groups")
    first = prints.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("row")).join(groups, "digest")
    wanted = first.select("group", "digest", F.col("row.doc_id").alias("wanted_id"), F.col("row.text_key").alias("wanted_key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_key") == F.col("wanted_key"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK))
    members = join_hot(texts.join(wanted, same).select("group", "digest", "text").dropDuplicates(["digest"]), materialise(sizes, "group-sizes"), "group", "size")
    dealt = members.select("group", F.pmod(F.xxhash64("digest"), blocks).alias("block"), (blocks > 1).alias("several"), "digest", "text")
    solved = materialise(confirmed(dealt.repartition("group", "block").sortWithinPartitions("group", "block", "digest"), width, least), "solved")
    roots = solved.where("root <> digest").select("digest", "root")
    wide = solved.where("hashes is not null")
    if wide.take(1):
        links = roots.select(F.col("digest").alias("u"), F.col("root").alias("v")).unionByName(across_blocks(wide, least))
        roots = connected_components(links).where("node <> root").select(F.col("node").alias("digest"), "root")
    roots = materialise(roots, "roots")
    return prints.select("doc_id", "text_key", "digest").join(roots, "digest", "left").select("doc_id", "text_key", F.coalesce("root", "digest").alias("component"))


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs, with all its columns, for each group of near-duplicates: that with the least (doc_id, text_key).

    Rows may share a doc_id or have none: a row is known by its doc_id and text. Of rows that repeat both one stays.
    """
    found = near_duplicates(docs, width, least)
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    kept = kept.select(F.col("row.doc_id").alias("kept_id"), F.col("row.text_key").alias("kept_key"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("kept_key_of_row") == F.col("kept_key"))
    named = docs.withColumn("kept_key_of_row", text_key(F.col("text"))).join(kept, same, "left_semi")
    return named.dropDuplicates(["doc_id", "kept_key_of_row"]).select(*docs.columns)
