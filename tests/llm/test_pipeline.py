import random

import corpus_pipeline
import pytest
from strandline.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(8)
    known = ["write", "to", "or", "call", "soon", "it", "is", "urgent", "and", "important", "for", "us", "all"] + ["".join(rng.choice("aeiourtnsl") for _ in range(rng.randint(2, 8))) for _ in range(200)]

    def filler() -> str:
        return " ".join(rng.choice(known) for _ in range(40))

    rows = [(i, filler(), "en", f"s{i % 3}", 10) for i in range(60)]
    rows += [(100 + i, rows[5][1], "en", "s0", 10) for i in range(20)]
    rows += [(200 + i, "you idiot " + filler() + " scum idiot", "en", "s1", 10) for i in range(30)]
    rows += [(300, "write to bob@example.com or call +1 555 555 0101 soon, it is urgent and important for us all", "en", "s2", 10), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0, 1) for i in range(60)] + [(200 + i, 1, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS
        kept[name] = docs.collect()
    ids = {k: [r["doc_id"] for r in v] for k, v in kept.items()}
    assert not any(200 <= i < 230 for i in ids["toxicity"]) and {300, 301} <= set(ids["toxicity"])
    assert len(set(ids["toxicity"])) >= 60 + 20 + 2 - 3
    assert sum(100 <= i < 200 for i in ids["simhash_neardup"]) == 0 and len(ids["simhash_neardup"]) == len(set(ids["simhash_neardup"]))
    assert sorted(ids["pii"]) == sorted(ids["simhash_neardup"])
    text = next(r for r in kept["pii"] if r["doc_id"] == 300)["text"]
    assert text.startswith("write to <email> or call <phone> soon")
    assert set(ids["mixing"]) <= set(ids["pii"]) and ids["mixing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted(set(ids["mixing"]))
    assert len([r for r in packed if r["start"] == 0]) == len(ids["mixing"])


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(tuple(r[k] for k in key) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(tuple(r[k] for k in key) for r in docs.collect())
