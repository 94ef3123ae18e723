"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input has a part from the word (its log-odds in toxic texts and a learned vector) and a part from its
characters (the log-odds of its character n-grams and the mean of their learned vectors). The network reads a text in
stretches that overlap, and each word has the states of the stretch that it stands well inside of. Windows begin at every
word: the states of a window's words are pooled by attention to one logit, and a text's score comes from its highest
window and the number of its windows. Log-odds are cross-fitted: while the network learns from a text, they are those of
the other texts.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.llm.common import binary, trimmed, worker_cache

#: Labelled texts that are learned from, at most: the least by hash of doc_id. Texts, of these, that the last step is fitted on.
TRAIN_TEXTS, CALIBRATION_TEXTS = 3000, 1000
#: Words of a window, a power of two, which is also what the network reads at once; words of a stretch that are its own, and what it reads before them.
WINDOW, OWN, MARGIN = 32, 24, 4
#: Units in each direction, learned numbers of a word and of its characters, attention units.
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 4, 4, 8
#: Buckets of character n-grams for log-odds and for learned vectors, lengths of n-grams, words with log-odds at most.
GRAMS, CHAR_ROWS, LENGTHS, VOCABULARY = 1 << 18, 1 << 12, (3, 4, 5), 50_000
STATIC, SHRINK = 5, 4.0
EPOCHS, BATCH, RATE, FOLDS = 6, 256, 0.02, 4
#: Words whose inputs a worker remembers, words or stretches worked on at once.
REMEMBERED, AT_ONCE = 150_000, 4096
STRIPPED = b".,;:!?'\"()*#$%&|<>"

_IN = STATIC + WORD_DIM + CHAR_DIM


def words_of(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts' distinct words, the numbers of all words, one text after another, and how many words each text has."""
    plain = [(t or b"").lower().translate(None, STRIPPED).strip() or None for t in texts]
    lists = pc.ascii_split_whitespace(pa.array(plain, pa.large_binary()).view(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words' character n-grams, with marks for the word's ends, and where each word's begin."""
    parts, sizes = [np.empty(0, dtype=np.uint32)], [np.empty(0, dtype=np.int64)]
    for a in range(0, len(words), AT_ONCE):
        some = pa.array(words.slice(a, AT_ONCE).view(pa.large_binary()).to_pylist(), pa.large_binary())
        offsets = np.frombuffer(some.buffers()[1], dtype=np.int64)[: len(some) + 1]
        length = np.diff(offsets) + 2  # with both marks
        pad = max(LENGTHS)
        begin = np.cumsum(length + pad) - length - pad
        flat = np.zeros(int((length + pad).sum()) + pad, dtype=np.uint32)
        inside = np.repeat(begin + 1 - offsets[:-1], length - 2) + np.arange(offsets[-1])
        flat[inside] = np.frombuffer(some.buffers()[2] or b"", dtype=np.uint8)[: offsets[-1]].astype(np.uint32) + 3
        flat[begin], flat[begin + length - 1] = 1, 2
        counts = [np.maximum(1, length - n + 1) for n in LENGTHS]
        each = sum(counts)
        out = np.empty(int(each.sum()), dtype=np.uint32)
        place = np.cumsum(each) - each
        for n, count in zip(LENGTHS, counts, strict=True):
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(begin, count) + nth
            h = np.full(len(at), n, dtype=np.uint32)
            for i in range(n):
                h = (h ^ flat[at + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out[np.repeat(place, count) + nth] = h
            place = place + count
        parts.append(out)
        sizes.append(each)
    each = np.concatenate(sizes)
    return np.concatenate(parts), np.cumsum(each) - each


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    raw = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return raw * (toxic + clean) / (toxic + clean + SHRINK)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(rng: np.random.Generator, words: int) -> dict[str, np.ndarray]:
    h, a = HIDDEN, ATTENTION
    p = {
        "word": rng.normal(0, 0.05, (words + 1, WORD_DIM)), "char": rng.normal(0, 0.05, (CHAR_ROWS, CHAR_DIM)),
        "wx": rng.normal(0, 1 / np.sqrt(_IN), (2, _IN, 3 * h)), "bx": np.zeros((2, 1, 3 * h)),
        "uz": rng.normal(0, 1 / np.sqrt(h), (2, h, 2 * h)), "un": rng.normal(0, 1 / np.sqrt(h), (2, h, h)),
        "wa": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, a)), "va": rng.normal(0, 1 / np.sqrt(a), a),
        "wo": rng.normal(0, 1 / np.sqrt(2 * h), 2 * h), "bo": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def read(p: dict, gx: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, dict]:
    """States (step, stretch, 2 * HIDDEN) of stretches, their attention scores, and what backward() needs.

    gx: (step, direction, stretch, 3 * HIDDEN) input sums, direction 1 in reverse; mask: (step, stretch).
    """
    steps, _, m, _ = gx.shape
    h = np.zeros((2, m, HIDDEN), dtype=gx.dtype)
    states = np.empty((steps, 2, m, HIDDEN), dtype=gx.dtype)
    memo: dict = {"z": [], "r": [], "n": [], "before": []}
    for t in range(steps):
        on = np.stack((mask[t], mask[steps - 1 - t]))[:, :, None]
        zr = _sigmoid(gx[t, :, :, : 2 * HIDDEN] + h @ p["uz"])
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        n = np.tanh(gx[t, :, :, 2 * HIDDEN :] + (r * h) @ p["un"])
        new = np.where(on, n + z * (h - n), h)
        if keep:
            for k, v in (("z", z), ("r", r), ("n", n), ("before", h)):
                memo[k].append(v)
        h = states[t] = new
    both = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)
    u = np.tanh(both @ p["wa"])
    return both, u @ p["va"], memo | {"both": both, "u": u}


def forward(p: dict, gx: np.ndarray, mask: np.ndarray, pool: np.ndarray | None = None, window: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Logits of windows, and what backward() needs. pool: which words of the stretches belong to a window, all if not given; window: to which, each stretch to its own if not given."""
    both, score, memo = read(p, gx, mask, keep=True)
    pool, window = mask if pool is None else pool, np.arange(mask.shape[1]) if window is None else window
    n = int(window.max()) + 1
    top = np.full(n, -np.inf, dtype=score.dtype)
    np.maximum.at(top, window, np.where(pool, score, -np.inf).max(axis=0))
    e = np.where(pool, np.exp(np.where(pool, score - top[window], 0)), 0)
    weight = (e / np.bincount(window, weights=e.sum(axis=0), minlength=n)[window]).astype(score.dtype)
    pooled = np.zeros((n, 2 * HIDDEN), dtype=score.dtype)
    np.add.at(pooled, window, np.einsum("tm,tmd->md", weight, both))
    return pooled @ p["wo"] + p["bo"], memo | {"weight": weight, "pooled": pooled, "window": window}


def backward(p: dict, memo: dict, mask: np.ndarray, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters behind the inputs, and of the input sums."""
    both, u, weight, pooled, window = (memo[k] for k in ("both", "u", "weight", "pooled", "window"))
    steps, m = mask.shape
    g = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()])}
    d_pooled = (d_logit[:, None] * p["wo"])[window]
    d_both = weight[:, :, None] * d_pooled
    d_weight = np.einsum("md,tmd->tm", d_pooled, both)
    mean = np.bincount(window, weights=(weight * d_weight).sum(axis=0), minlength=len(pooled))[window].astype(both.dtype)
    d_score = weight * (d_weight - mean)
    g["va"] = np.einsum("tm,tma->a", d_score, u)
    d_u = d_score[:, :, None] * p["va"] * (1 - u * u)
    g["wa"] = np.einsum("tmd,tma->da", both, d_u)
    d_both += d_u @ p["wa"].T
    d_states = np.stack((d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:]), axis=1)
    g["uz"], g["un"] = np.zeros_like(p["uz"]), np.zeros_like(p["un"])
    d_gx = np.zeros((steps, 2, m, 3 * HIDDEN), dtype=both.dtype)
    d_h = np.zeros((2, m, HIDDEN), dtype=both.dtype)
    for t in range(steps - 1, -1, -1):
        on = np.stack((mask[t], mask[steps - 1 - t]))[:, :, None]
        z, r, n, h = (memo[k][t] for k in ("z", "r", "n", "before"))
        total = d_h + d_states[t]
        d = np.where(on, total, 0)
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        back = d_n @ p["un"].transpose(0, 2, 1)
        d_r = back * h * r * (1 - r)
        d_zr = np.concatenate((d_z, d_r), axis=2)
        g["un"] += (r * h).transpose(0, 2, 1) @ d_n
        g["uz"] += h.transpose(0, 2, 1) @ d_zr
        d_gx[t] = np.concatenate((d_zr, d_n), axis=2)
        d_h = d * z + back * r + d_zr @ p["uz"].transpose(0, 2, 1) + np.where(on, 0, total)
    return g, d_gx


def input_sums(p: dict, x: np.ndarray) -> np.ndarray:
    """(direction, row, 3 * HIDDEN) of inputs (row, _IN)."""
    return x @ p["wx"] + p["bx"]


def stretches_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of n words begin, and the first words that are their own; the next OWN - 1 are too, as far as there are any."""
    own = np.arange(0, n, OWN)
    return np.maximum(own - MARGIN, 0), own


def _index(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all stretches of a text, -1 behind its end, and which of them are a stretch's own."""
    begin, own = stretches_of(len(ids))
    at = begin[:, None] + np.arange(WINDOW)
    numbers = np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], -1) if len(ids) else at
    return numbers, (at >= own[:, None]) & (at < np.minimum(own + OWN, len(ids))[:, None])


def inputs(number: np.ndarray, lengths: np.ndarray, grams: tuple, word_odds: np.ndarray, gram_odds: np.ndarray, p: dict) -> np.ndarray:
    """The inputs of words, given by number in the vocabulary (0: not in it), length in bytes, and grams_of()."""
    flat, starts = grams
    odds = gram_odds[flat % GRAMS]
    sizes = np.diff(np.append(starts, len(flat)))
    x = np.empty((len(number), _IN), dtype=np.float32)
    if not len(number):
        return x
    x[:, 0] = word_odds[number]
    x[:, 1] = np.maximum.reduceat(odds, starts)
    x[:, 2] = np.add.reduceat(odds, starts) / sizes
    x[:, 3] = number > 0
    x[:, 4] = np.minimum(lengths, 20) / 10
    x[:, STATIC : STATIC + WORD_DIM] = p["word"][number]
    x[:, STATIC + WORD_DIM :] = np.add.reduceat(p["char"][flat % CHAR_ROWS], starts) / sizes[:, None]
    return x


def top_windows(p: dict, sums: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text with words the logit of its highest window and the number of its windows: one from every word that WINDOW words follow, itself included, or one.

    ids: numbers of the texts' words, one text after another, for the input sums; counts: the texts' numbers of words, none 0.
    A window's logit is a quotient of two sums over its words; all windows' sums come from sums over 1, 2, 4, ... words.
    """
    starts = np.cumsum(counts) - counts
    many = -(-counts // OWN)
    owner = np.repeat(np.arange(len(counts)), many)
    own = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * OWN
    begin = np.maximum(own - MARGIN, 0)
    length, mine = np.minimum(counts[owner] - begin, WINDOW), np.minimum(counts[owner] - own, OWN)
    e, value = np.empty(len(ids)), np.empty(len(ids))
    step = np.arange(WINDOW)
    for a in range(0, len(owner), AT_ONCE):
        some = slice(a, a + AT_ONCE)
        at = (starts[owner[some]] + begin[some])[:, None] + step
        part = np.where(step < length[some, None], ids[np.minimum(at, len(ids) - 1)], -1).T
        both, score, _ = read(p, np.stack((sums[0][part], sums[1][part[::-1]]), axis=1), part >= 0)
        first = (own - begin)[some, None]
        kept = (step >= first) & (step < first + mine[some, None])
        e[at[kept]] = np.exp(score.T[kept].astype(float))
        value[at[kept]] = (both @ p["wo"]).T[kept]
    padded = np.maximum(counts, WINDOW)
    base = np.cumsum(padded) - padded
    place = np.repeat(base - starts, counts) + np.arange(len(ids))
    below, above = np.zeros(int(padded.sum())), np.zeros(int(padded.sum()))
    below[place], above[place] = e, e * value
    width = 1
    while width < WINDOW:
        below, above = (np.concatenate((x[:-width] + x[width:], x[len(x) - width :])) for x in (below, above))
        width *= 2
    windows = padded - WINDOW + 1
    edges = np.stack((base, base + windows), axis=1).ravel()
    logits = above / np.where(below > 0, below, 1.0)
    return np.maximum.reduceat(np.append(logits, 0.0), edges)[::2] + float(p["bo"][0]), windows


def train(texts: list[bytes], labels: np.ndarray) -> dict:
    """The model of labelled texts, in an order that doesn't depend on how they were stored."""
    labels = labels.astype(bool)
    rate = (labels.sum() + 0.1) / (len(labels) + 1)  # a tenth without any label
    if not labels.any() or labels.all():
        return {"rate": float(rate)}
    rng = np.random.default_rng(7)
    words, flat_ids, counts = words_of(texts)
    docs = np.split(flat_ids.astype(np.int64), np.cumsum(counts)[:-1])
    grams, starts = grams_of(words)
    in_bytes = pc.binary_length(words).to_numpy()
    ends = np.append(starts[1:], len(grams))
    fold = np.arange(len(docs)) % FOLDS
    word_counts = np.zeros((FOLDS, 2, len(words)))
    gram_counts = np.zeros((FOLDS, 2, GRAMS))
    for ids, label, f in zip(docs, labels, fold, strict=True):
        own = np.unique(ids)
        word_counts[f, int(label), own] += 1
        if len(own):
            held = np.concatenate([grams[starts[i] : ends[i]] for i in own])
            gram_counts[f, int(label), np.unique(held % GRAMS)] += 1
    sizes = np.array([[np.sum((fold == f) & (labels == bool(k))) for k in (0, 1)] for f in range(FOLDS)])

    def odds(skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        use = [f for f in range(FOLDS) if f != skip]
        w, g, n = word_counts[use].sum(0), gram_counts[use].sum(0), sizes[use].sum(0)
        return log_odds(w[1], w[0], n[1], n[0]).astype(np.float32), log_odds(g[1], g[0], n[1], n[0]).astype(np.float32)

    all_odds, gram_odds = odds(None)
    often = word_counts.sum((0, 1))
    chosen = [int(i) for i in np.lexsort((np.arange(len(words)), -np.abs(all_odds))) if often[i] >= 2][:VOCABULARY]
    vocab_of = np.zeros(len(words), dtype=np.int64)
    vocab_of[chosen] = np.arange(1, len(chosen) + 1)
    p = init(rng, len(chosen))

    def blocks(skip: int | None) -> Iterator[tuple[int, np.ndarray]]:
        """Where some words begin and their inputs, block by block, with the log-odds of all folds but one."""
        w, g = odds(skip)
        w = np.concatenate(([0], w[chosen])).astype(np.float32)
        for a in range(0, len(words), AT_ONCE):
            b = min(len(words), a + AT_ONCE)
            own = grams[starts[a] : ends[b - 1]], starts[a:b] - starts[a]
            yield a, inputs(vocab_of[a:b], in_bytes[a:b], own, w, g, p)

    static = np.empty((FOLDS, len(words), STATIC), dtype=np.float32)
    for f in range(FOLDS):
        for a, x in blocks(f):
            static[f, a : a + len(x)] = x[:, :STATIC]
    rows, sizes_ = (grams % CHAR_ROWS).astype(np.uint16), ends - starts
    # windows that are learned from, pooled of their stretches' own words as windows are that are scored: of a toxic text the
    # most suspect one, of a clean one the most suspect and two by chance
    picked, pooled, pieces, target, of_fold = [], [], [], [], []
    for k, ids in enumerate(docs):
        if not len(ids):
            continue
        index, own = _index(ids)
        place = stretches_of(len(ids))[0][:, None] + np.arange(WINDOW)
        x = static[fold[k]][ids]
        sums = np.concatenate(([0], np.cumsum(np.maximum(x[:, 0], 0) + np.maximum(x[:, 1], 0), dtype=float)))
        starts_ = np.arange(max(1, len(ids) - WINDOW + 1))
        best = [int((sums[np.minimum(starts_ + WINDOW, len(ids))] - sums[starts_]).argmax())]
        if not labels[k]:
            best += list(rng.integers(0, len(starts_), 2))
        for begin in best:
            held = own & (place >= begin) & (place < begin + WINDOW)
            rows_ = np.flatnonzero(held.any(axis=1))
            picked.append(index[rows_])
            pooled.append(held[rows_])
            pieces.append(len(rows_))
            target.append(float(labels[k]))
            of_fold.append(fold[k])
    if not picked or len(set(target)) < 2:
        return {"rate": float(rate)}
    picked, pooled, pieces, target = np.concatenate(picked), np.concatenate(pooled), np.array(pieces), np.array(target, dtype=np.float32)
    of_fold, first_piece = np.repeat(of_fold, pieces), np.cumsum(pieces) - pieces
    balance = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean())).astype(np.float32)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    epochs = max(EPOCHS, -(-EPOCHS * 40 * BATCH // (len(target) * 4)))
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for a in range(0, len(order), BATCH):
            chosen_ = order[a : a + BATCH]
            window = np.repeat(np.arange(len(chosen_)), pieces[chosen_])
            at = np.concatenate([np.arange(first_piece[i], first_piece[i] + pieces[i]) for i in chosen_])
            part, mask = picked[at].T, picked[at].T >= 0
            own, back = np.unique(part[mask], return_inverse=True)
            # inputs of the batch's (fold, word) pairs
            x = np.zeros((WINDOW, len(at), _IN), dtype=np.float32)
            learned = np.empty((len(own), WORD_DIM + CHAR_DIM), dtype=np.float32)
            spans = [rows[starts[i] : starts[i] + sizes_[i]] for i in own]
            learned[:, :WORD_DIM] = p["word"][vocab_of[own]]
            flat, lengths = np.concatenate(spans), sizes_[own]
            begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            learned[:, WORD_DIM:] = np.add.reduceat(p["char"][flat], begins) / lengths[:, None]
            folds = np.broadcast_to(of_fold[at], part.shape)
            x[mask, :STATIC] = static[folds[mask], part[mask]]
            x[mask, STATIC:] = learned[back]
            sums = x[:, None] @ p["wx"] + p["bx"]
            gx = np.stack((sums[:, 0], sums[::-1, 1]), axis=1)
            logit, memo = forward(p, gx, mask, pooled[at].T, window)
            d = (_sigmoid(logit) - target[chosen_]) * balance[chosen_] / len(chosen_)
            g, d_gx = backward(p, memo, mask, d.astype(np.float32))
            d_sums = np.stack((d_gx[:, 0], d_gx[::-1, 1]))  # (direction, step, window, 3 * HIDDEN)
            flat_x, flat_d = x.reshape(-1, _IN), d_sums.reshape(2, -1, 3 * HIDDEN)
            g["wx"] = np.einsum("mi,kmo->kio", flat_x, flat_d, optimize=True)
            g["bx"] = flat_d.sum(axis=1, keepdims=True)
            d_x = np.einsum("kmo,kio->mi", flat_d, p["wx"], optimize=True).reshape(x.shape)[mask][:, STATIC:]
            d_learned = _sums_at(back, d_x, len(own))
            g["word"] = _sums_at(vocab_of[own], d_learned[:, :WORD_DIM], len(p["word"]))
            g["char"] = _sums_at(flat, np.repeat(d_learned[:, WORD_DIM:] / lengths[:, None], lengths, axis=0), CHAR_ROWS)
            step += 1
            for k in p:
                grad = g[k] + (1e-4 * p[k] if k in ("word", "char") else 0)
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                p[k] -= (RATE / (1 + step / 200) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # a text's logit from its highest window and its number of windows, fitted on texts with the other texts' log-odds
    features, goal = [], []
    for f in range(FOLDS):
        mine = [k for k in np.flatnonzero(fold == f)[: CALIBRATION_TEXTS // FOLDS] if len(docs[k])]
        if mine:
            sums = np.empty((2, len(words), 3 * HIDDEN), dtype=np.float32)
            for a, x in blocks(f):
                sums[:, a : a + len(x)] = input_sums(p, x)
            top, windows = top_windows(p, sums, np.concatenate([docs[k] for k in mine]), np.array([len(docs[k]) for k in mine]))
            features += list(zip(top, np.log(windows), strict=True))
            goal += list(labels[mine])
    final = _calibrate(np.array(features), np.array(goal, dtype=float))
    return {"rate": float(rate), "p": p, "vocabulary": words.take(pa.array(np.array(chosen, dtype=np.int64))), "word_odds": np.concatenate(([0], all_odds[chosen])).astype(np.float32), "gram_odds": gram_odds, "final": final}


def _sums_at(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=rows[:, k], minlength=n) for k in range(rows.shape[1])], axis=1)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression near the network's own logit: Newton steps with ridge, halved until the loss falls."""
    x = np.column_stack((np.ones(len(x)), np.clip(x[:, 0], -30, 30), x[:, 1]))
    prior, ridge = np.array([0.0, 1.0, 0.0]), np.array([0.05, 1.0, 1.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (ridge * (w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(50):
        q = _sigmoid(x @ w)
        grad = x.T @ (q - y) + ridge * (w - prior)
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.diag(ridge), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


class Scorer:
    """Scores texts, remembering the input sums of words."""

    def __init__(self, model: dict) -> None:
        self.model = model
        if "p" in model:
            self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.sums = np.zeros((2, 0, 3 * HIDDEN), dtype=np.float32)

    def learn(self, words: pa.Array) -> None:
        m, n = self.model, len(self.known)
        if n + len(words) > self.sums.shape[1]:
            more = max(REMEMBERED - n, len(words))  # pages that aren't touched take no memory
            self.sums = np.concatenate((self.sums[:, :n], np.zeros((2, more, 3 * HIDDEN), dtype=np.float32)), axis=1)
        number = pc.add(pc.fill_null(pc.index_in(words, value_set=m["vocabulary"]), -1), 1).to_numpy()
        lengths = pc.binary_length(words).to_numpy()
        for a in range(0, len(words), AT_ONCE):
            some = slice(a, a + AT_ONCE)
            x = inputs(number[some], lengths[some], grams_of(words.slice(a, AT_ONCE)), m["word_odds"], m["gram_odds"], m["p"])
            self.sums[:, n + a : n + a + len(x)] = input_sums(m["p"], x)
        self.known = pa.concat_arrays([self.known, words])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words, new ones learned."""
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            new = words.filter(at.is_null())
            if len(self.known) + len(new) > REMEMBERED:
                self.clear()
                new = words
            self.learn(new)
            at = pc.index_in(words, value_set=self.known)
        return at.to_numpy()

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        m = self.model
        out = np.full(len(texts), min(m["rate"], 0.01))
        if "p" not in m:
            out[:] = m["rate"]
            return out
        words, ids, counts = words_of(texts)
        some = counts > 0
        if some.any():
            top, windows = top_windows(m["p"], self.sums_of(words), ids, counts[some])
            a, b, c = m["final"]
            out[some] = _sigmoid(a + b * top + c * np.log(windows))
        return out

    def sums_of(self, words: pa.Array) -> np.ndarray:
        at = self.numbers(words)
        return self.sums[:, at]


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_TEXTS) -> DataFrame:
    """(doc_id, text, label) of at most `most` rows of labelled documents that aren't held out, the least by hash of doc_id, then of text."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id")  # at most `most` rows of two numbers
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most)  # each task gives its least, however often rows repeat


def held_out(doc_id: object) -> object:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_TEXTS) -> bytes:
    """The pickled model, trained in one task from at most `most` texts. Rows that repeat a doc_id each count, `most` in all at most.

    Of the words in these texts at most VOCABULARY have log-odds and vectors of their own; all others have those of their n-grams.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), binary(b.column(1)), b.column(2).to_pylist(), strict=True)
        worker_cache(("train",), lambda: None)  # room: what the worker has kept goes
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1] or b""))
        model = train([r[1] or b"" for r in rows], np.array([r[2] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = training_rows(docs, labels, label, most).repartition(1)
    row = found.mapInArrow(run, "model binary").first()  # none if there are no rows to learn from
    return bytes(row["model"]) if row else pickle.dumps(train([], np.empty(0)))


def _scored(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, str]:
    """docs with a last column score of a name that docs doesn't have, which is returned too; the other columns go along as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, most))
    at, name = docs.columns.index("text"), "score_"
    while name in docs.columns:
        name += "_"

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = model.value
        scorer = worker_cache(("scorer", zlib.crc32(blob)), lambda: Scorer(pickle.loads(blob)))
        for b in batches:
            texts = binary(b.column(at))
            found: list[np.ndarray] = []
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t or b"")
                if size >= 1 << 20:
                    found.append(scorer.scores(texts[begin : i + 1]))
                    begin, size = i + 1, 0
            found.append(scorer.scores(texts[begin:]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(found))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())])), name


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_TEXTS) -> DataFrame:
    """docs(doc_id, text, ...) and labels(doc_id, toxic, ...): returns (doc_id, held_out, score, predicted), a row for each row of docs.

    Null, empty and blank texts get a low score. Without labels of both kinds every score is the smoothed rate of toxic
    labels. Texts are scored whole and labels, languages, sources and doc_ids are never part of a score. A null doc_id isn't
    held out. Rows that repeat a doc_id get a score each; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored, _ = _scored(texts, labels, label, most)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored.select("doc_id", out, F.col("score_").alias("score"), (F.col("score_") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_TEXTS) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below 0.5."""
    scored, name = _scored(docs, labels, label, most)
    return scored.where(f"`{name}` < 0.5").drop(name)
