"""Near-duplicates by SimHash, the links found in BK-trees.

A fingerprint sums up the hashed word shingles of a whole text. Texts with equal fingerprints are folded first, so the
trees hold each fingerprint once. Fingerprints that differ in at most `radius` bits agree on all bits of at least
`blocks - radius` of `blocks` bit blocks; every choice of that many blocks deals the fingerprints to shards, each shard
gets a tree of its own, and each fingerprint is looked up in the trees of its shards. Children are keyed by the
integer Hamming distance to their parent and a lookup follows only edges within the radius of its own distance, so no
link is lost and none but shard members meet. All the trees together grow with the corpus; they are therefore built
where the shuffle has put their shard and its lookups, and are not broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import binary, join_hot, materialise
from strandline.llm.components import connected_components

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once, and (lookup, node) pairs that a search holds at once.
CHUNK, FRONTIER = 1 << 17, 1 << 21
#: Rows of whole shards that are searched together.
SHARD_ROWS = 1 << 18


def shingle_hashes(text: bytes | None, width: int) -> list[int]:
    """XXH64 of each word shingle, repeats included; of the whole sequence if it has fewer words; [] without words."""
    words = (text or b"").lower().split()
    if not words:
        return []
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(flat, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    begin = np.concatenate(([0], ends[:-width])).tolist()
    return [digest(flat[a:b], SEED) for a, b in zip(begin, (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes, none of them empty: a bit is 1 if it is set in over half the hashes."""
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    sizes = np.array([len(h) for h in hashes])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    bits = np.unpackbits(np.concatenate(hashes).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.where(2 * sums > sizes[:, None], weights, np.uint64(0)).sum(axis=1, dtype=np.uint64)


def fingerprints(texts: list[bytes | None], width: int) -> np.ndarray:
    """A bit is 1 if it is set in over half the hashes; 0 without words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[list[int]] = []
    rows: list[int] = []

    def flush() -> None:
        if rows:
            out[rows] = majority([np.array(h, dtype=np.uint64) for h in held])
            held.clear()
            rows.clear()

    total = 0
    for i, text in enumerate(texts):
        if hashes := shingle_hashes(text, width):
            held.append(hashes)
            rows.append(i)
            total += len(hashes)
            if total >= CHUNK:
                flush()
                total = 0
    flush()
    return out


def with_fingerprint(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): fp has the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(binary(b.column(1)), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """The shards of a fingerprint: which blocks are compared, and their bits."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    keys = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(sum(1 << i for i in chosen)), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def build_trees(fps: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trees of all shards at once, level by level. root: for each item the first item of its shard, which is the tree's root.

    Returns the edges (parent * 65 + distance), sorted, and the child of each.
    """
    items = np.flatnonzero(root != np.arange(len(fps)))
    parent = root[items]
    edges, children = [], []
    while len(items):
        key = parent * 65 + np.bitwise_count(fps[items] ^ fps[parent])
        order = np.argsort(key, kind="stable")
        key, items = key[order], items[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        heads = items[first]
        edges.append(key[first])
        children.append(heads)
        parent = heads[np.cumsum(first) - 1][~first]
        items = items[~first]
    if not edges:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, child = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(key)
    return key[order], child[order]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each set after joining a[i] with b[i]."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            deeper = labels[labels]
            if np.array_equal(deeper, labels):
                break
            labels = deeper


def look_up(fps: np.ndarray, tree: tuple[np.ndarray, np.ndarray], q: np.ndarray, node: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Looks up each item q in the tree whose root is its node. Gives the pairs (q, node) within the radius, level by level."""
    edge, child = tree
    while len(q):
        d = np.bitwise_count(fps[q] ^ fps[node]).astype(np.int64)
        hit = d <= radius
        yield q[hit], node[hit]
        lo = np.searchsorted(edge, node * 65 + np.maximum(d - radius, 0))
        n = np.searchsorted(edge, node * 65 + np.minimum(d + radius, 64), side="right") - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        q, node = np.repeat(q, n), child[at]


def tree_hits(fps: np.ndarray, root: np.ndarray, radius: int, held: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Looks up each item in its own shard's tree, as many at once as may meet `held` nodes."""
    tree = build_trees(fps, root)
    size = np.bincount(root, minlength=len(fps))[root]
    begin = 0
    while begin < len(fps):
        end = max(begin + 1, int(np.searchsorted(np.cumsum(size[begin:]), held)) + begin)
        yield from look_up(fps, tree, np.arange(begin, end), root[begin:end], radius)
        begin = end


def search_trees(fps: np.ndarray, root: np.ndarray, radius: int) -> np.ndarray:
    """For each item the least item that it reaches by links inside its shard."""
    labels = np.arange(len(fps))
    for q, node in tree_hits(fps, root, radius):
        labels = merge(labels, q, node)
    return labels


def shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """shards(shard, fp), dealt and sorted by shard. Returns links (u, v) that join what its trees join, fewer than it has rows."""

    def solve(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        same = np.concatenate(([False], shard[1:] == shard[:-1]))
        several = same | np.concatenate((same[1:], [False]))
        if not several.any():
            return None
        shard, fps = shard[several], fp[several]
        head = np.concatenate(([True], shard[1:] != shard[:-1]))
        root = np.flatnonzero(head)[np.cumsum(head) - 1]
        labels = search_trees(fps.view(np.uint64), root, radius)
        linked = np.flatnonzero(labels != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[linked]), pa.array(fps[labels[linked]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            rows += b.num_rows
            if rows >= SHARD_ROWS and held[0][0][0] != held[-1][0][-1]:
                shard, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                if cut:
                    if (out := solve(shard[:cut], fp[:cut])) is not None:
                        yield out
                held, rows = [(shard[cut:], fp[cut:])], len(shard) - cut
        if held:
            if (out := solve(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
                yield out

    return shards.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4, blocks: int = 6) -> DataFrame:
    """docs(doc_id, text, ...): returns (doc_id, fingerprint, component_id), a row for each row of docs.

    Texts link if their fingerprints differ in at most `radius` bits; component_id is the least doc_id reachable.
    Null, empty and blank texts have fingerprint zero and link like any other. Rows that share a doc_id each count.
    A null doc_id stays; where a component has no other, its component_id is null. Other columns are ignored.
    """
    prints = materialise(with_fingerprint(docs, width), "fingerprints")
    folded = prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("n"))
    shards = folded.select(F.explode(block_keys(F.col("fp"), radius, blocks)).alias("shard"), "fp")
    links = shard_links(shards.repartition("shard").sortWithinPartitions("shard"), radius)
    roots = connected_components(links)
    labelled = folded.join(roots, folded.fp == roots.node, "left").select("fp", "least_doc", "n", F.coalesce("root", "fp").alias("root"))
    labelled = materialise(labelled, "roots")
    least = labelled.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = materialise(labelled.join(least, "root").select("fp", "n", "component_id"), "named")
    return join_hot(prints, named, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """One row of docs, with all its columns, for each group of near-duplicates: that with the least doc_id.

    Of rows that repeat this doc_id one stays. Rows without a doc_id can't be told apart and all stay.
    """
    kept = near_duplicates(docs, width, radius).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
