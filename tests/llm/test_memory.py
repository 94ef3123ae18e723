import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
#: One core, so that one Python worker runs all tasks: the stages over texts of many words, and after each what the idle worker would have to give back.
SCRIPT = """
import json, random, sys

from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.driver.memory", "2g").getOrCreate()

import corpus_pipeline

rng = random.Random(5)
words = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 9))) for _ in range(60000)]
rows = [(i, " ".join(rng.choices(words, k=300)) + (" you idiot scum" if i % 50 == 0 else ""), "en", f"s{i % 3}", 10) for i in range(5000)]
spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(sys.argv[1] + "/documents.parquet")
spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(0, 5000, 10)], "doc_id long, toxic int").write.parquet(sys.argv[1] + "/labels.parquet")


def idle(batches):
    import ctypes, os, re

    import pyarrow as pa

    def held():
        return int(re.search("Anonymous:\\\\s+(\\\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

    for _ in batches:
        pass
    before = held()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [before - held()]})


docs = spark.read.parquet(sys.argv[1] + "/documents.parquet")
found = {}
for name, stage in [x for x in corpus_pipeline.STAGES if x[0] in ("toxicity", "simhash_neardup", "packing")]:
    corpus_pipeline.materialise(stage(spark, docs, sys.argv[1]), name)
    found[name] = max(r["mb"] for r in spark.range(0, 8, 1, 8).mapInArrow(idle, "pid long, mb double").collect())  # idle workers take turns
print(json.dumps(found))
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_idle_workers_hold_no_freed_memory(tmp_path):
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")]), "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    found = json.loads(out.stdout.splitlines()[-1])
    assert {name: mb for name, mb in found.items() if mb > 25} == {}
