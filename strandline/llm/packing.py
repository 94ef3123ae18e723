"""Packing token sequences by multiway differencing.

Each document's ids are cut into whole windows and a rest. The rests are dealt to groups by hash, and in each group the
Karmarkar-Karp method works on partial partitions, tuples of one load for each window: the two with the largest
differences between their loads are merged, the large loads of one upon the small loads of the other, until one
partition is left, whose windows are near-equal. Where a window exceeds the capacity the number of windows rises by one.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import give_back, materialise, trimmed, worker_cache

CAPACITY, END = 4096, 2
#: Rests in a group, on average; the distinct parts of words that a worker remembers; the bytes of texts that it encodes at once, and the entries whose ids it gathers at once.
GROUP, PARTS, TEXT_BYTES, ENTRIES = 1024, 600_000, 1 << 21, 1 << 16


def _append(ids: array, starts: array, sizes: array, more: np.ndarray, each: np.ndarray) -> None:
    starts.frombytes((len(ids) + np.cumsum(each) - each).astype("<u4").tobytes())
    sizes.frombytes(each.astype("<u4").tobytes())
    ids.frombytes(more.tobytes())


def _gather(ids: array | np.ndarray, starts: array | np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of entries, one after another."""
    ids, starts, out, done = np.asarray(ids, dtype="<u4"), np.asarray(starts), np.empty(int(sizes.sum()), dtype="<u4"), 0
    for a in range(0, len(at), ENTRIES):
        n = sizes[a : a + ENTRIES]
        ends = np.cumsum(n)
        place = np.repeat(starts[at[a : a + ENTRIES]].astype(np.int64) - ends + n, n) + np.arange(ends[-1])
        out[done : done + len(place)] = ids[place]
        done += len(place)
    return out


class WordCache:
    """Ids of texts, each distinct word encoded once. Arrow splits texts into words and numbers them.

    Words are what stands between ASCII white space: the tokenizer drops white space, and no token or normalisation spans
    it. A new word is lower-cased and split as the tokenizer's pattern does it, and parts that are new too are encoded many
    at once; a part's last token carries the word-end mark. Words with rare characters go through the tokenizer as a whole.
    """

    #: Fixed value: the tokenizer's pattern.
    PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Characters whose normalisation or class isn't plain, and the begin of special tokens.
    RARE = re.compile("[\x00-\x1f\x7f-\xa0\u0250-\U0010ffff]|<\\|")
    #: The same among letters, for Arrow's patterns, and the one whose lower case is two; signs that may stand behind a word's letters and are one part there.
    RARE_LETTER, SIGNS = r"[^\x{21}-\x{7e}\x{a1}-\x{12f}\x{131}-\x{24f}]", ".,;:!?%&$#*|<>()\"-"
    #: Parts encoded as one text, and such texts encoded at once.
    JOINED, BATCH = 256, 64

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.light = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.light.normalizer = None
        self.light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.clear()

    def clear(self) -> None:
        self.held = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = array("I"), array("I"), array("I")

    def split(self, word: str) -> list[str]:
        """A word's parts; one with rare characters is a part of its own, marked. An empty word has none."""
        return ["\0" + word] if self.RARE.search(word) else self.PART.findall(word.lower())

    def learn(self, parts: list[str]) -> None:
        """New parts, once each."""
        plain = [p for p in parts if p and p[0] != "\0"]
        groups = [plain[i : i + self.JOINED] for i in range(0, len(plain), self.JOINED)]
        joined = [" ".join([p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in g]) for g in groups]
        ids, sizes = [np.empty(0, dtype="<u4")], [np.empty(0, dtype=np.int64)]
        for group, found in zip(groups, self._encoded(joined), strict=True):
            own = np.array(found.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[own]) + 1
            if len(ends) == len(group):
                ids.append(own)
                sizes.append(np.diff(ends, prepend=0))
            else:
                self._add_whole(group, ids, sizes, group)
        rare = [p for p in parts if p and p[0] == "\0"]
        self._add_whole(rare, ids, sizes, [p[1:] for p in rare])
        empty = [p for p in parts if not p]  # behind a word without signs, and between white space
        sizes.append(np.zeros(len(empty), dtype=np.int64))
        self.held = pa.concat_arrays([self.held, pa.array(plain + rare + empty, pa.string())])
        _append(self.flat, self.starts, self.sizes, np.concatenate(ids), np.concatenate(sizes))

    def _encoded(self, texts: list[str]) -> Iterator:
        for i in range(0, len(texts), self.BATCH):
            yield from self.light.encode_batch_fast(texts[i : i + self.BATCH], add_special_tokens=False)

    def _add_whole(self, parts: list[str], ids: list, sizes: list, texts: list[str]) -> None:
        each = [np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4") for t in texts]
        ids += each
        sizes.append(np.array([len(x) for x in each], dtype=np.int64))

    def numbers(self, parts: pa.Array) -> np.ndarray:
        """The numbers of parts, new ones learned."""
        coded = parts.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.held)
        if at.null_count:
            new = coded.dictionary.filter(at.is_null())
            if len(self.held) + len(new) > PARTS:
                self.clear()
                new = coded.dictionary
            self.learn(new.to_pylist())
            at = pc.index_in(coded.dictionary, value_set=self.held)
        return at.to_numpy().astype(np.int64)[coded.indices.to_numpy()]

    def parts_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The parts of words, one word after another, and how many a word has.

        Words of plain letters and signs behind them are split as whole columns, the others one by one.
        """
        core = pc.utf8_rtrim(words, self.SIGNS)
        plain = pc.and_not(pc.utf8_is_alpha(core), pc.match_substring_regex(core, self.RARE_LETTER))
        own, core, rest = words.filter(plain), pc.utf8_lower(core.filter(plain)), words.filter(pc.invert(plain)).to_pylist()
        split = [self.split(w) for w in rest]
        number = self.numbers(pa.concat_arrays([core, _behind(own, core), pa.array(list(chain.from_iterable(split)), pa.string())]))
        n, mask = len(own), plain.to_numpy(zero_copy_only=False)
        each = np.full(len(words), 2)
        each[~mask] = [len(x) for x in split]
        place = np.cumsum(each) - each
        out = np.empty(int(each.sum()), dtype=np.int64)
        out[place[mask]], out[place[mask] + 1] = number[:n], number[n : 2 * n]
        out[np.repeat(~mask, each)] = number[2 * n :]
        return out, each

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end. Each distinct word is looked at once."""
        # ASCII letters can be lower-cased here, but not into a special token
        special = pc.match_substring(texts, "<|")
        lower = pc.if_else(special, texts, pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(lower.cast(pa.large_string()))
        coded = lists.flatten().cast(pa.string()).dictionary_encode()
        parts, each = self.parts_of(coded.dictionary)
        part_sizes = np.array(self.sizes, dtype=np.int64)[parts]
        ids = _gather(self.flat, self.starts, parts, part_sizes)
        bounds = np.concatenate(([0], np.cumsum(part_sizes)))[np.concatenate(([0], np.cumsum(each)))]
        index = coded.indices.to_numpy()
        sizes = np.diff(bounds)[index]
        ends = np.cumsum(sizes)
        words = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        return _gather(ids, bounds[:-1], index, sizes), np.concatenate(([0], ends))[np.cumsum(words)]


def _behind(words: pa.Array, core: pa.Array) -> pa.Array:
    """What each word has behind its first characters, which are as many bytes as those of `core`."""
    total, own = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (words, core))
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words)] if len(words) else np.empty(0, np.int32)
    more = total - own
    ends = np.cumsum(more)
    place = np.repeat(offsets + own - ends + more, more) + np.arange(ends[-1] if len(ends) else 0)
    at = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(at), pa.py_buffer(data[place].tobytes())])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids with `end` behind, cut into windows and a rest."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(("words", tokenizer_path), lambda: WordCache(tokenizer_path))
        for b in batches:
            row, start, length, crc, total = [], [], [], [], []
            texts, at = b.column(1), 0
            bytes_to = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
            while at < len(texts):  # some texts at a time, by size
                begin = at
                at = max(begin + 1, int(np.searchsorted(bytes_to, (bytes_to[begin - 1] if begin else 0) + TEXT_BYTES, "right")))
                flat, ends = cache.encode(texts.slice(begin, at - begin))
                for i, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True), begin):
                    ids = np.append(flat[a:z], np.uint32(end)).astype("<u4")
                    for s in range(0, len(ids), capacity):
                        part = ids[s : s + capacity]
                        row.append(i)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(ids))
                give_back()
            columns = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each item, by Karmarkar-Karp differencing in `windows` ways."""
    n = len(sizes)
    if windows == 1 or not n:
        return np.zeros(n, dtype=np.int64)
    parent = np.arange(n)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def part(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in parts:
            return parts.pop(i)
        loads, items = np.zeros(windows, dtype=np.int64), np.full(windows, -1)
        loads[0], items[0] = sizes[i], i
        return loads, items  # loads fall

    name = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (x, p), (y, q) = part(a), part(b)
        y, q = y[::-1], q[::-1]
        loads, both = x + y, (p >= 0) & (q >= 0)
        parent[q[both]] = p[both]
        items = np.where(p >= 0, p, q)
        order = np.argsort(-loads, kind="stable")
        loads, items = loads[order] - loads[order[-1]], items[order]
        parts[name] = (loads, items)
        heapq.heappush(heap, (-int(loads[0]), name))
        name += 1
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            break
        parent = up
    return np.unique(parent, return_inverse=True)[1]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item; no window exceeds the capacity, no item is larger than it."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, windows)
        if not len(sizes) or np.bincount(found, weights=sizes).max() <= capacity:
            return found
        windows += 1


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text, ...): returns a row for each piece with its place (sequence_id, offset) in a sequence of at most `capacity` ids.

    Null, empty and blank texts have the end id alone. Repeated rows are packed each on its own; a null doc_id stays null.
    No rows give no sequences. Other columns are ignored.
    """
    cut = materialise(pieces(docs, tokenizer_path, capacity, end), "pieces")
    rests = cut.where(F.col("length") < capacity).count()
    groups = max(1, -(-rests // group))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        whole = (pdf["length"] == capacity).to_numpy()
        window = np.empty(len(pdf), dtype=np.int64)
        window[~whole] = packed = pack(pdf["length"].to_numpy()[~whole], capacity)
        window[whole] = np.arange(whole.sum()) + (packed.max() + 1 if len(packed) else 0)
        order = np.lexsort((pdf["start"], window))
        pdf, window = pdf.iloc[order].reset_index(drop=True), window[order]
        before = pdf["length"].cumsum() - pdf["length"]
        pdf["offset"] = before - before.groupby(window).transform("first")
        pdf["sequence_id"] = window + (int(key[0]) << 32)
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    salt = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return cut.withColumn("bin", F.pmod(salt, F.lit(groups))).groupBy("bin").applyInPandas(run, schema)
