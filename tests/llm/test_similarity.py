import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from strandline.llm import similarity


def plain_set(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_components(texts, least):
    sets = [plain_set(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if plain_jaccard(sets[i], sets[j]) >= least:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


def edited_texts(rng, groups, copies):
    vocabulary = ["".join(rng.choice("aeiourtnsl") for _ in range(6)) for _ in range(500)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 160))]
        out.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 35)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [similarity.BLOCK, 4])
def test_the_stage_against_brute_force_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "ONE", "a b c", "a b c d"] + edited_texts(rng, 50, 4)
    want = plain_components(texts, 0.8)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(want)
    least = sum(plain_jaccard(plain_set(texts[i]), plain_set(texts[j])) < 0.9 for i in range(7, len(texts)) for j in [want[i]] if i != j)
    assert least > 10


@pytest.mark.parametrize("similarity_of_pair", [0.8, 0.85])
def test_recall_of_the_buckets(similarity_of_pair):
    rng = np.random.default_rng(5)
    shared = round(200 * similarity_of_pair)
    own = (200 - shared) // 2
    met = 0
    for _ in range(600):
        h = np.unique(rng.integers(0, 1 << 64, 200, dtype=np.uint64))
        rng.shuffle(h)
        a, b = similarity.bands([np.sort(h[: shared + own]), np.sort(np.concatenate((h[:shared], h[shared + own :])))])
        met += bool((a == b).any())
    assert met >= 597


def chained_texts(rng, length, copies):
    """Texts of which each is near the next only, each in several near copies, so that a group's links reach far beyond a leader's."""
    words = [f"w{i}" for i in range(100 + 4 * length)]
    base = [words[4 * i : 4 * i + 100] for i in range(length)]
    out = []
    for b in base:
        for _ in range(copies):
            own = list(b)
            own[rng.choice([0, 99])] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rounds", [1, 3])
def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch, rounds):
    monkeypatch.setattr(similarity, "BLOCK", 12)
    monkeypatch.setattr(similarity, "ROUNDS", rounds)
    rng = random.Random(6)
    texts = chained_texts(rng, 12, 12) + edited_texts(rng, 2, 40)
    sets = similarity.shingle_sets([t.encode() for t in texts], 5)
    rows = [(1, i % 12, i, [int(x) for x in s.view(np.int64)]) for i, s in enumerate(sets)]
    schema = "group long, block long, digest long, hashes array<long>"
    held = {}
    for b in range(12):
        mine = [r[2] for r in rows if r[1] == b]
        held |= dict(zip(mine, [mine[k] for k in similarity.link_sets([sets[i] for i in mine], 0.8)]))
    wide = spark.createDataFrame(rows, schema).join(spark.createDataFrame(list(held.items()), "digest long, root long"), "digest")
    wide = wide.select("group", "block", "digest", "root", "hashes")
    label = dict(held)
    links = [tuple(r) for r in similarity.across_blocks(wide, 0.8).collect()]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for u, v in links:
        a, b = sorted((root(u), root(v)))
        label[b] = a
    assert [root(i) for i in range(len(texts))] == plain_components(texts, 0.8)


def test_links_of_one_group_against_plain_code():
    rng = random.Random(2)
    texts = edited_texts(rng, 3, 30)
    sets = similarity.shingle_sets([t.encode() for t in texts], 5)
    assert similarity.link_sets(sets, 0.8).tolist() == plain_components(texts, 0.8)


def test_hubs_of_unlike_texts_do_not_link(spark):
    line = " ".join(f"w{i}" for i in range(60))
    texts = [line + " " + " ".join(f"t{k}x{i}" for i in range(40)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert similarity.keep_one(docs).count() == 40


def test_rows_that_share_or_lack_a_doc_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [(1, a, "p"), (1, b, "q"), (2, a, "r"), (3, b + " end", "s"), (None, c, "t"), (None, c, "u"), (None, d, "v"), (4, d, "w"), (1, a, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = similarity.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["text"][0], r["doc_id"] or 0) for r in kept.collect()) == [("a", 1), ("b", 1), ("c", 0), ("d", 0)]


def test_fingerprints_are_of_distinct_shingles():
    rng = random.Random(4)
    texts = ["a b c d e f " * 9, "one", "x y z"] + edited_texts(rng, 3, 2)
    for text, got in zip(texts, similarity.set_prints(similarity.shingle_sets([None, *(t.encode() for t in texts)], 5))[1:].tolist(), strict=True):
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in plain_set(text)]
        assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("a, b, shared", [(4, 5, 4), (9, 9, 8), (13, 14, 12), (180, 180, 160), (200, 160, 160)])
def test_the_radius_holds_pairs_of_similarity_0_8(a, b, shared):
    rng = np.random.default_rng(a)
    sets = []
    for _ in range(4000):
        h = rng.integers(0, 1 << 64, a + b - shared, dtype=np.uint64)
        sets += [h[:a], h[a - shared :]]
    prints = similarity.set_prints(sets)
    assert np.bitwise_count(prints[::2] ^ prints[1::2]).max() <= similarity.tree_radius(0.8) < 32


def test_links_of_many_shards_against_plain_code(monkeypatch):
    monkeypatch.setattr(similarity, "SHINGLES", 3000)
    monkeypatch.setattr(similarity, "MET", 50)
    rng = random.Random(9)
    sizes = [1, 3, 40, 1, 60, 7]
    texts = [edited_texts(rng, 1 + n // 9, n)[:n] for n in sizes]
    sets = [s for shard in texts for s in similarity.shingle_sets([t.encode() for t in shard], 5)]
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    want = np.concatenate([plain_components(t, 0.8) for t in texts]) + first
    assert similarity.link_shards(sets, first, 0.8, similarity.tree_radius(0.8)).tolist() == want.tolist()


@pytest.mark.parametrize("block, radius", [(similarity.BLOCK, 6), (4, 6), (4, 64)])
def test_links_of_the_stage_come_from_the_trees(spark, monkeypatch, block, radius):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "tree_radius", lambda least: radius)
    texts = edited_texts(random.Random(11), 8, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    prints = similarity.set_prints(similarity.shingle_sets([t.encode() for t in texts], 5))
    sets = [plain_set(t) for t in texts]
    near = np.array([[plain_jaccard(x, y) >= 0.8 for x in sets] for y in sets]) & (np.bitwise_count(prints[:, None] ^ prints) <= radius)
    for _ in texts:
        near = near @ near
    want = set(near.argmax(axis=1).tolist())
    assert kept == want and (radius == 64) == (want == set(plain_components(texts, 0.8)))
