import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from strandline.llm import packing
from strandline.llm.queries import tokenizer_path


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


ODD = ["İstanbul don't WE'LL it's 'S ... ,.x é.à ÀÉ", "x\x85y 中文字 Ωσς é ﬁ <|endoftext|> <|ENDOFTEXT|> 12.5", "a\x1cb ½ ²³ ª µ ß ŉ q­", " \n ", "", None, "́ x 'll'd",
       "naïve façade, straße; ÉCOLE! ¿qué?", "\U0001f600\U0001f601 ok", "a" * 3000]


def test_pieces_hold_every_id_once(spark):
    texts = ODD + ["word another third, " * 3000, "tiny"] + [f"text {i} of some words" for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    ids = plain_ids(texts)
    rows = packing.pack_documents(docs, tokenizer_path(), group=40).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for i, want in enumerate(ids):
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(want)
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 160))
def test_pack_fits_and_places_each_item_once(sizes, capacity):
    found = packing.pack(np.array(sizes, dtype=np.int64), capacity)
    assert len(found) == len(sizes)
    if sizes:
        assert np.bincount(found, weights=sizes).max() <= capacity


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2000, 600)
    loads = np.bincount(packing.differencing(sizes, 50), weights=sizes, minlength=50)
    assert loads.max() - loads.min() < 0.01 * loads.mean()
    assert packing.differencing(np.array([8, 7, 6, 5, 4]), 2).tolist() != [0] * 5


def test_padding_is_little():
    rng = np.random.default_rng(2)
    sizes = np.minimum(rng.exponential(900, 1024).astype(np.int64) + 1, 4095)
    windows = packing.pack(sizes, 4096).max() + 1
    assert windows * 4096 <= 1.03 * sizes.sum()


@pytest.mark.parametrize("rows", [[], [(None, None, 1)], [(1, "same", 5), (1, "same", 5)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    assert packing.pack_documents(docs, tokenizer_path()).count() == len(rows)
