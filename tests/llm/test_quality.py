import random
import re

import numpy as np
import pytest
from strandline.llm import quality


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_base_counts_against_plain_code(spark):
    rng = random.Random(2)
    bits = ["a", "b", "cc", "é", "#", "<x>", " ", " ", "\n", "\n\n", "\t", " ", "\U0001f600", "line of text", "\x0b", "\r"]
    texts = [None, "", "\n\n", "a b c", "a b c a b c"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 150))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.measure(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_divergence():
    a, b = np.array([1.0, 0, 1]), np.array([0, 2.0, 0])
    assert quality.divergence(a, b) == 1.0 and quality.divergence(a, 3 * a) == 0.0
    assert quality.divergence(a, a + b) == quality.divergence(a + b, a)


def test_odd_texts_go_and_clean_and_short_ones_stay(spark):
    rng = random.Random(4)
    common = ["the", "of", "and", "to", "in", "is", "that", "it"]

    def clean(n):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(n)) + "."

    rows = [(i, clean(300), "en") for i in range(80)] + [(100, " ".join(f"{w}###%%%" for w in clean(300).split()), "en"), (101, " ".join("zqx" + str(i) for i in range(300)), "en"), (102, clean(60), "en"), (103, clean(300), None)]
    got = {r["doc_id"]: r for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(80)) and got[102]["kept"] and got[103]["kept"]
    assert not got[100]["kept"] and not got[101]["kept"] and not got[100]["base_failed"]
    assert got[102]["char_distance"] is None


@pytest.mark.parametrize("rows", [[], [(None, None, None, True)], [(1, "a", "en", True), (1, "a", "en", False)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean")
    out = quality.measure(docs).collect()
    assert len(out) == len(rows) and all(r["base_failed"] and not r["kept"] for r in out)


def plain_references(rows):
    from collections import Counter

    out = {}
    for _, text, lang in rows:
        if lang is not None and text:
            words, classes = out.setdefault(lang, (Counter(), Counter()))
            words.update(plain_words(text))
            classes.update(plain_classes(text))
    return {k: v for k, v in out.items() if v[0]}


def plain_words(text):
    kept = "".join(c.lower() if c.isascii() else c for c in text if c not in ".,;:!?'\"()")
    return re.findall(r"[^\x20\x09-\x0D]+", kept)


def plain_classes(text):
    names = {c: k for k, cs in quality.CLASSES.items() for c in cs.decode()}
    return [names.get(c, "other") for c in text]


def plain_distance(p, q):
    import math

    a, b = sum(p.values()), sum(q.values())
    total = 0.0
    for k in p.keys() | q.keys():
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(0.0, total / 2))


def plain_measure(rows, least=100):
    from collections import Counter

    known = plain_references(rows)
    largest = sorted(known, key=lambda k: (-known[k][0].total(), k))[: quality.LANGUAGES]
    out = {}
    for i, text, lang in rows:
        base = plain(text)
        c = w = None
        if known and base[0] >= least:
            found = []
            for k in [lang] if lang in known else largest:
                words, classes = known[k]
                often = dict(sorted(words.items(), key=lambda e: (-e[1], e[0].encode()))[: quality.COMMON])
                own, rest = Counter(x if x in often else None for x in plain_words(text)), words.total() - sum(often.values())
                found.append((plain_distance(Counter(plain_classes(text)), classes), plain_distance(own, {**often, None: rest}) if own else 1.0))
            c, w = min(found, key=sum)
        wider = quality.SLACK / max(base[0], 1) ** 0.5
        kept = not base[5] and (c is None or (c <= quality.CHAR_LIMIT + wider and w <= quality.WORD_LIMIT + wider))
        out[i] = (c, w, kept)
    return out


@pytest.mark.parametrize("languages", [256, 2, 1])
def test_distances_against_plain_code(spark, monkeypatch, languages):
    """However few references are broadcast, a text is held against its own language."""
    monkeypatch.setattr(quality, "LANGUAGES", languages)
    rng = random.Random(9)
    stems = {k: ["".join(rng.choice("abcdeféñ") for _ in range(rng.randint(1, 6))) for _ in range(90)] for k in ("aa", "bb", "cc", "dd")}

    def text(k, n):
        return "".join(rng.choice(stems[k]).title() + rng.choice([" ", ". ", " #", "\n", ", "]) for _ in range(n))

    rows = [(i, text(k, rng.choice([60, 120, 300])), k) for i, k in enumerate(["aa"] * 14 + ["bb"] * 9 + ["cc"] * 6 + ["dd"] * 3)]
    rows += [(50, text("bb", 200), None), (51, text("aa", 200), "cc"), (52, "", "ee"), (53, None, None), (54, " \n", "ff"), (55, "zq9 " * 40 + text("dd", 120), "dd")]
    got = {r["doc_id"]: r for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    want = plain_measure(rows)
    assert len(got) == len(rows)
    for i, (c, w, kept) in want.items():
        r = got[i]
        assert (r["char_distance"] is None) == (c is None) and r["kept"] == kept
        assert c is None or (abs(r["char_distance"] - c) < 1e-9 and abs(r["word_distance"] - w) < 1e-9)
