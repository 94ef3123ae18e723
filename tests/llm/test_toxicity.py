import os
import random
import zlib

import numpy as np
import pytest
from strandline.llm import toxicity


def small(rng, steps=5, m=4):
    p = {k: v.astype(np.float64) for k, v in toxicity.init(rng, 3).items()}
    mask = np.ones((steps, m), dtype=bool)
    mask[3:, 1] = mask[2:, 2] = False
    return p, rng.normal(size=(steps, 2, m, 3 * toxicity.HIDDEN)), mask


@pytest.mark.parametrize("window", [None, [0, 0, 1, 0]])
@pytest.mark.parametrize("name", ["uz", "un", "wa", "va", "wo", "bo", "gx"])
def test_gradients_against_differences(name, window):
    rng = np.random.default_rng(0)
    p, gx, mask = small(rng)
    weight = rng.normal(size=4 if window is None else 2)
    pooled = () if window is None else (mask & (rng.random(mask.shape) < 0.7), np.array(window))

    def loss():
        return float((toxicity.forward(p, gx, mask, *pooled)[0] * weight).sum())

    _, memo = toxicity.forward(p, gx, mask, *pooled)
    g, d_gx = toxicity.backward(p, memo, mask, weight)
    array, grad = (gx, d_gx) if name == "gx" else (p[name], g[name])
    for at in [tuple(int(rng.integers(0, n)) for n in array.shape) for _ in range(6)]:
        old = array[at]
        array[at] = old + 1e-5
        up = loss()
        array[at] = old - 1e-5
        down = loss()
        array[at] = old
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 56, 57, 500])
def test_stretches_own_each_word_once(n):
    begins, own = toxicity.stretches_of(n)
    mine = [range(o, min(n, o + toxicity.OWN)) for o in own]
    assert [i for r in mine for i in r] == list(range(n))
    assert all(b <= r[0] and r[-1] < b + toxicity.WINDOW for b, r in zip(begins, mine))


def plain_grams(word):
    flat = [1, *[c + 3 for c in word], 2]
    out = []
    for n in toxicity.LENGTHS:
        for i in range(max(1, len(flat) - n + 1)):
            h = n
            for c in (flat[i : i + n] + [0] * n)[:n]:
                h = (h ^ c) * 0x9E3779B1 % 2**32
                h ^= h >> 15
            out.append(h)
    return out


def plain_score(model, text):
    """The score of a text by loops over words, stretches and windows."""
    import math

    p, hidden = model["p"], toxicity.HIDDEN
    words = [w for w in text.lower().translate(None, toxicity.STRIPPED).split()]
    vocabulary = {w.encode(): i + 1 for i, w in enumerate(model["vocabulary"].to_pylist())}

    def given(word):
        number, grams = vocabulary.get(word, 0), plain_grams(word)
        odds = [float(model["gram_odds"][g % toxicity.GRAMS]) for g in grams]
        char = np.mean([p["char"][g % toxicity.CHAR_ROWS] for g in grams], axis=0)
        return np.concatenate(([model["word_odds"][number], max(odds), sum(odds) / len(odds), number > 0, min(len(word), 20) / 10], p["word"][number], char)).astype(float)

    def run(xs, k):
        h, out = np.zeros(hidden), []
        for x in xs:
            s = x @ p["wx"][k].astype(float) + p["bx"][k][0]
            zr = 1 / (1 + np.exp(-(s[: 2 * hidden] + h @ p["uz"][k])))
            z, r = zr[:hidden], zr[hidden:]
            n = np.tanh(s[2 * hidden :] + (r * h) @ p["un"][k])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    xs, states = [given(w) for w in words], []
    for own in range(0, len(words), toxicity.OWN):
        begin = max(0, own - toxicity.MARGIN)
        part = xs[begin : begin + toxicity.WINDOW]
        both = [np.concatenate(x) for x in zip(run(part, 0), run(part[::-1], 1)[::-1])]
        states += both[own - begin : own - begin + toxicity.OWN]
    logits = []
    for i in range(max(1, len(words) - toxicity.WINDOW + 1)):
        some = states[i : i + toxicity.WINDOW]
        weight = np.array([math.exp(np.tanh(h @ p["wa"]) @ p["va"]) for h in some])
        logits.append((weight / weight.sum()) @ np.array(some) @ p["wo"] + p["bo"][0])
    a, b, c = model["final"]
    return 1 / (1 + math.exp(-(a + b * max(logits) + c * math.log(len(logits)))))


def test_scores_match_plain_loops():
    texts, labels = corpus(260)
    model = toxicity.train([t.encode() for t in texts], np.array(labels))
    rng = random.Random(4)
    some = [" ".join(rng.choice(texts[rng.randrange(260)].split()) for _ in range(n)) for n in (1, 2, 23, 24, 25, 31, 32, 33, 47, 48, 49, 130)]
    some = [t.encode() for t in [*some, "É ñandú x, y! \n IDIOT zz", "a" * 300]]
    got = toxicity.Scorer(model).scores(some)
    assert np.abs(got - [plain_score(model, t) for t in some]).max() < 1e-4


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    stems = ["idiot", "vequ", "lowei"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 300))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "ta", "no", "mo", "ri"]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_learns_and_generalises():
    texts, labels = corpus(700)
    model = toxicity.train([t.encode() for t in texts[:500]], np.array(labels[:500]))
    scores = toxicity.Scorer(model).scores([t.encode() for t in texts[500:]])
    assert np.mean((scores >= 0.5) == np.array(labels[500:])) > 0.95
    again = toxicity.train([t.encode() for t in texts[:500]], np.array(labels[:500]))
    assert np.array_equal(scores, toxicity.Scorer(again).scores([t.encode() for t in texts[500:]]))
    odd = toxicity.Scorer(model).scores([None, b"", b" \n", b"###", b"x" * 50_000, b"one"])
    assert ((odd >= 0) & (odd < 0.5)).all()


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, None), (2, 1)], [(None, 1), (1, 7)]])
def test_without_both_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y"), (None, "", "z")], "doc_id long, text string, score string")
    out = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"]: r["held_out"] for r in out} == {1: zlib.crc32(b"1") % 5 == 0, 2: zlib.crc32(b"2") % 5 == 0, None: False}
    assert toxicity.score(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_keep_clean_keeps_columns(spark):
    texts, labels = corpus(300)
    docs = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long")
    kept = toxicity.keep_clean(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert sum(i in left for i, y in enumerate(labels) if not y) > 0.95 * labels.count(0) and sum(i in left for i, y in enumerate(labels) if y) < 0.1 * sum(labels)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy(spark):
    from strandline.llm.common import table

    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    some = labels.where("doc_id < 4000")
    own = docs.join(some.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.score(own, some).where("held_out").join(some, "doc_id").select("score", "predicted", "toxic").collect()
    hits = [r["predicted"] == r["toxic"] for r in rows]
    assert len(rows) > 200 and np.mean(hits) > 0.97


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1 if i % 2 else i, f"text {i % 9}") for i in range(4000)], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in [1, *range(0, 4000, 2)]], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, "toxic", 50).collect()
    assert len(rows) == 50 and not any(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    again = toxicity.training_rows(docs.repartition(3), labels, "toxic", 50).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_clashing_columns(spark):
    texts, labels = corpus(120)
    docs = spark.createDataFrame([(i, t, i, "x", {"a": i}) for i, t in enumerate(texts)], "doc_id long, text string, score_ int, score string, score__ map<string,int>")
    kept = toxicity.keep_clean(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    assert kept.columns == docs.columns and all(r["score_"] == r["doc_id"] and r["score__"] == {"a": r["doc_id"]} for r in kept.collect())
