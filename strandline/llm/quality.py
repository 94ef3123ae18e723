"""Quality rules on whole texts: counts of each text, and how far it diverges from its language.

A reference for each language, taken from all documents, has the shares of character classes and of the language's most
frequent words. A text's own two histograms are held against them by Jensen-Shannon distance. Short texts have rough
histograms; below a minimum length no divergence is judged, and above it the limits widen as texts get shorter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.common import binary, materialise

#: Character classes of the histogram, by UTF-8 byte; each other code point's first byte counts as "other".
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\v\f\r",
    "line": b"\n",
    "stop": b".,;:!?'\"()-",
    "symbol": b"#*$%&|<>",
}
SYMBOLS, BLANK, STRIPPED = b"#*$%&|<>", b" \t\n\v\f\r", b".,;:!?'\"()"
#: Frequent words of a language, languages whose references go to all tasks, words of a text below which divergence isn't judged.
COMMON, LANGUAGES, LEAST_WORDS = 48, 256, 100
#: Limits of the distances (square roots of divergences in bits) for long texts, and what a text of n words adds: slack / sqrt(n).
CHAR_LIMIT, WORD_LIMIT, SLACK = 0.2, 0.32, 1.0
#: Distinct words that a task holds before it hands its counts on.
HELD = 300_000

_CLASS_OF = np.full(256, len(CLASSES), dtype=np.int64)
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _i
_CLASS_OF[0x80:0xC0] = len(CLASSES) + 1  # inside a code point
N_CLASSES = len(CLASSES) + 1


def class_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each class, and the count of each byte."""
    by = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    return np.bincount(_CLASS_OF, weights=by, minlength=N_CLASSES + 1)[:N_CLASSES], by


def plain_words(text: bytes) -> list[bytes]:
    return text.lower().translate(None, STRIPPED).split()


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of `width` words that are found twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    key = ids[: n - width + 1]
    for k in range(1, width):  # numbers stay below n * n
        key = key * len(number) + ids[k : n - width + 1 + k]
        if k < width - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    often = counts[back] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= often
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2: 0 if alike, 1 if apart."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, each.sum() / 2)))


def references(docs: DataFrame) -> DataFrame:
    """A row for each language of docs that has words: (lang, total, entries), its words in all and (word, n) of its COMMON most frequent ones and, behind a line end, of its character classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def give() -> pa.RecordBatch:
            flat = [(k, w, n) for k, c in held.items() for w, n in c.items()]
            flat += [(k, b"\n%d" % i, int(n)) for k, c in classes.items() for i, n in enumerate(c) if n]
            held.clear()
            classes.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.binary()), pa.array([x[2] for x in flat], pa.int64())],
                names=["lang", "word", "n"],
            )

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), binary(b.column(1)), strict=True):
                if lang is None or not text:
                    continue
                held.setdefault(lang, Counter()).update(plain_words(text))
                classes[lang] = classes.get(lang, 0) + class_counts(text)[0]
            if sum(map(len, held.values())) > HELD:
                yield give()
        if held:
            yield give()

    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = materialise(texts.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    line = F.substring("word", 1, 1) == F.lit(b"\n")
    total = counts.where(~line).groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.where(~line).withColumn("rank", rank).where(F.col("rank") <= COMMON).drop("rank")
    entries = top.unionByName(counts.where(line)).groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("entries"))
    return materialise(total.join(entries, "lang"), "references")


def reference(total: int, entries: list[tuple[bytes, int]]) -> tuple[np.ndarray, dict[bytes, int], np.ndarray]:
    """Of a row of references(): character classes, the frequent words' numbers, and their counts with the rest last."""
    classes, index, n = np.zeros(N_CLASSES), {}, []
    for word, count in sorted(entries, key=lambda e: (-e[1], e[0])):
        if word[:1] == b"\n":
            classes[int(word[1:])] = count
        else:
            index[word] = len(index)
            n.append(count)
    return classes, index, np.array([*n, total - sum(n)], dtype=float)


def measure(docs: DataFrame, least_words: int = LEAST_WORDS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """docs(doc_id, text, lang, ...): returns a row for each row of docs.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.
    Null, empty and blank texts have no words and fail. A text of fewer than `least_words` words that doesn't fail is kept,
    its distances null; so is every such text where no language has a reference. A text is held against its language. A text
    without one is held against the nearest of the LANGUAGES languages with most words. Repeated rows each count; other
    columns are ignored. The references of these LANGUAGES go to all tasks; texts of any further language meet theirs in a join.
    """
    known = references(docs)
    largest = known.orderBy(F.desc("total"), "lang").limit(LANGUAGES).collect()
    held = {r["lang"]: reference(r["total"], [(bytes(e["word"]), e["n"]) for e in r["entries"]]) for r in largest}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for b in batches:
            counts, failed, chars, common, kept = [], [], [], [], []
            brought = [None] * b.num_rows if b.num_columns == 3 else zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
            for lang, text, own_reference in zip(b.column(1).to_pylist(), binary(b.column(2)), brought, strict=True):
                text = text or b""
                words = text.split()
                classes, by = class_counts(text)
                n, repeat = len(words), repeated_words(words)
                counts.append((n, int(classes.sum() - by[list(BLANK)].sum()), int(by[list(SYMBOLS)].sum()), duplicate_lines(text), repeat))
                bad = n < 50 or 100 * repeat > 50 * n
                c = w = None
                if held and n >= least_words:
                    own = plain_words(text)
                    if own_reference and own_reference[1]:
                        total, entries = own_reference
                        against = [reference(total, [(e["word"], e["n"]) for e in entries])]
                    else:
                        against = [held[lang]] if lang in held else held.values()
                    c, w = min((_distances(classes, own, r) for r in against), key=sum)
                wider = SLACK / np.sqrt(max(n, 1))
                failed.append(bad)
                chars.append(c)
                common.append(w)
                kept.append(not bad and (c is None or c <= char_limit + wider and w <= word_limit + wider))
            columns = [b.column(0), *(pa.array([x[i] for x in counts], pa.int64()) for i in range(5))]
            columns += [pa.array(failed, pa.bool_()), pa.array(chars, pa.float64()), pa.array(common, pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "char_distance", "word_distance", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    if len(largest) < LANGUAGES:
        return rows.mapInArrow(run, schema)
    further = known.join(F.broadcast(known.sparkSession.createDataFrame([(k,) for k in held], "lang string")), "lang", "left_anti")
    among = rows.where(F.col("lang").isNull() | F.col("lang").isin(list(held)))
    # a text without words may have a language without reference
    others = rows.where(~F.col("lang").isin(list(held))).join(further, "lang", "left").select("doc_id", "lang", "text", "total", "entries")
    return among.mapInArrow(run, schema).unionByName(others.mapInArrow(run, schema))


def _distances(classes: np.ndarray, words: list[bytes], reference: tuple) -> tuple[float, float]:
    shares, index, common = reference
    own = np.zeros(len(common))
    for w, n in Counter(words).items():
        own[index.get(w, -1)] += n
    if not own.sum() or not common.sum():
        return divergence(classes, shares), 1.0
    return divergence(classes, shares), divergence(own, common)
