import random
import re

import numpy as np
import pytest
import xxhash
from strandline.llm import simhash
from strandline.llm.components import connected_components


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius):
    a = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= radius
    label = np.array(ids)
    while True:
        new = np.where(near, label[None], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def random_texts(rng, n):
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(n // 4)]
    out = list(base)
    while len(out) < n:
        words = rng.choice(base).split(" ")
        words[rng.randrange(len(words))] = "x"
        out.append(rng.choice([" ", "\t", "\n\n"]).join(words).upper())
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_against_brute_force(spark, width):
    rng = random.Random(width)
    texts = [None, "", " \n", "one", "ONE", "é È x y z", "a b c", "word " * 20000] + random_texts(rng, 250)
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    prints = [plain_fingerprint(t, width) for t in texts]
    want = plain_components([i * 3 for i in range(len(texts))], prints, 4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, width, 4).collect()}
    assert [got[i * 3]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i * 3]["component_id"] for i in range(len(texts))] == want


def test_trees_find_every_link_in_a_hot_shard():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = [centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(400)]
    fps = np.unique(np.array([*near, *rng.integers(0, 1 << 63, 300, dtype=np.uint64)], dtype=np.uint64))
    labels = simhash.search_trees(fps, np.zeros(len(fps), dtype=np.int64), 4)
    assert labels.tolist() == plain_components(list(range(len(fps))), fps.tolist(), 4)


def test_a_pair_at_the_radius_shares_a_shard(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = []
    for i in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        rows += [(i, a - (1 << 64) if a >> 63 else a), (i, b - (1 << 64) if b >> 63 else b)]
    df = spark.createDataFrame(rows, "pair int, fp long")
    keyed = df.select("pair", F.explode(simhash.block_keys(F.col("fp"), 4, 6)).alias("shard")).groupBy("pair", "shard").count()
    assert keyed.where("count = 2").select("pair").distinct().count() == 60


@pytest.mark.parametrize("rows", [[], [(None, None, "x")], [(1, "a b", "x"), (1, "a b", "y"), (None, "a b", "z")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    assert simhash.near_duplicates(docs).count() == len(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r[0] for r in rows})


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(path + star + [(5, 5), (2000, 2001)], "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(200)) and got[2001] == 2000 and len(got) == 263
