import json

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from strandline import schemas
from strandline.plans import reports
from strandline.sources import readers, sinks
from strandline.streaming import state

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType())])


def test_csv_with_quotes_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None)], SCHEMA)
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(readers.read_csv(spark, str(tmp_path / "c"), SCHEMA).collect()) == [(1, 'a "q", b\nc'), (2, None)]
    assert sorted(readers.read_csv_strings(spark, str(tmp_path / "c"), ["id", "name"]).collect())[1] == ("2", "")


def test_positional_csv_gives_the_rest_to_the_last_column(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b,c\n1,2,3,4,5\n6\n")
    assert sorted(tuple(r) for r in readers.read_positional(spark, str(tmp_path / "p.csv"), ["a", "b", "c"]).collect()) == [("1", "2", "3,4,5"), ("6", "", "")]


def test_jsonl_routes_rows(spark, tmp_path):
    lines = ['{"id": 1, "name": "a"}', "", "{bad", '{"id": 2}', '{"id": 3, "name": "c", "x": 1}', '{"id": 4, "name": null}']
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    good, rejected = readers.read_jsonl(spark, str(tmp_path / "d.jsonl"), SCHEMA)
    assert sorted(r["id"] for r in good.collect()) == [1, 4]
    assert sorted(r["reason"] for r in rejected.collect()) == ["malformed", "missing key", "unexpected key"]
    good, rejected = readers.read_jsonl(spark, str(tmp_path / "d.jsonl"), SCHEMA, strict=False)
    assert good.count() == 4 and rejected.count() == 1
    assert readers.read_jsonl_dynamic(spark, str(tmp_path / "d.jsonl"), SCHEMA).where("id is not null").count() == 4


def test_dataset_by_ending(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "x"}, {"id": 2, "name": "y"}]')
    assert readers.read_dataset(spark, str(tmp_path / "a.json"), SCHEMA).count() == 2
    try:
        readers.read_dataset(spark, str(tmp_path / "a.txt"), SCHEMA)
        raise AssertionError
    except ValueError:
        pass


def test_documents_know_their_folders(spark, tmp_path):
    for p, i, text in (("P", "i1", '{"id": 1}'), ("P", "i2", "{nope"), ("Q", "i3", '{"id": 3, "name": "n"}')):
        (tmp_path / p / i).mkdir(parents=True)
        (tmp_path / p / i / "r.json").write_text(text)
    good, bad = readers.read_documents(spark, str(tmp_path), SCHEMA)
    assert sorted((r["project"], r["instance"], r["id"]) for r in good.collect()) == [("P", "i1", 1), ("Q", "i3", 3)]
    assert [r["instance"] for r in bad.collect()] == ["i2"]
    assert readers.files_below(spark, [str(tmp_path), str(tmp_path / "P")], "*.json").count() == 3
    assert [r["instance"] for r in state.done_by_marker(spark, str(tmp_path / "Q"), "r.json").collect()] == ["i3"]


def test_junit_file(spark, tmp_path):
    (tmp_path / "TEST-a.xml").write_text('<testsuite tests="2" failures="1"><testcase name="a" classname="C" time="0.5"/><testcase name="b" classname="C"><failure>m</failure></testcase></testsuite>')
    suites = readers.read_junit(spark, str(tmp_path / "TEST-a.xml"))
    r = suites.first()
    assert (r["suite"], r["tests"], r["failures"], r["errors"], r["time"]) == ("TEST-a.xml", 2, 1, 0, 0.0)
    assert [(c["test_name"], c["status"], c["duration"]) for c in readers.junit_cases(suites).collect()] == [("a", "PASSED", 0.5), ("b", "FAILED", 0.0)]


def test_whole_files_mark_binary(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    assert sorted(r["text"] for r in readers.read_whole(spark, str(tmp_path)).collect()) == ["[binary file]", "é"]


def test_cutoff_keeps_one_more(spark):
    df = spark.createDataFrame([(i, f"2024-0{9 - i}") for i in range(5)], "n int, at string")
    assert readers.until_cutoff(df, [F.col("n")], F.col("at"), "2024-07").count() == 4
    assert readers.until_cutoff(df, [F.col("n")], F.col("at"), "2024-07", most=1).count() == 2


def test_pages_end_at_a_gap(spark, tmp_path):
    (tmp_path / "page-1.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "page-2.jsonl").write_text('{"a": 3}\n')
    (tmp_path / "page-4.jsonl").write_text('{"a": 4}\n')
    assert sorted((r["page"], r["pos"]) for r in readers.read_pages(spark, str(tmp_path)).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    sinks.write_routed(df, {str(tmp_path / "all"): F.lit(True), str(tmp_path / "named"): F.col("name").isNotNull()})
    assert spark.read.json(str(tmp_path / "all")).count() == 2 and spark.read.json(str(tmp_path / "named")).count() == 1
    sinks.append_jsonl(df, str(tmp_path / "all"))
    assert spark.read.json(str(tmp_path / "all")).count() == 4
    assert json.loads(sinks.as_json_array(df, [-F.col("id")]).first()["json"])[0]["id"] == 2
    sinks.write_by_entity(df, str(tmp_path / "by"), "id")
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"id=1", "id=2"}
    doc = sinks.summary_document(df.agg(F.count("*").alias("n")), df, "id").first()
    assert doc["n"] == 2 and doc["results"][1]["name"] == "a"
    lines = spark.createDataFrame([("bad",), ('{"id": 1}',)], "value string")
    parsed = F.get_json_object("value", "$.id")
    assert sorted(r[0] for r in sinks.pass_through(lines, parsed, F.to_json(F.struct(parsed.alias("id")))).collect()) == ["bad", '{"id":"1"}']
    assert "pass  1.50" in sinks.report("T", [("pass", 1.5)])


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k int, v double")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = state.file_stream(spark, str(tmp_path / "in"), df.schema, files=2)
    state.run_to_end(state.running_stats(stream, ["k"], F.col("v")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(state.running_stats(df, ["k"], F.col("v")).collect())


def test_resume_adds_nothing_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    for _ in range(2):
        out = state.resume_append(df, str(tmp_path / "s"), "id", SCHEMA)
    assert out.count() == 2


def test_evaluation_report(spark):
    rows = [("i1", "m", True, 10.0, (2, 2, 0)), ("i2", "m", False, 5.0, None)]
    df = spark.createDataFrame(rows, "instance_id string, model_name string, success boolean, total_duration double, test_execution struct<total_tests: long, passed: long, failed: long>")
    df = df.withColumn("error_message", F.lit(None).cast("string"))
    assert "success_rate   50.00" in reports.evaluation_text(df, "run")
    assert schemas.EVALUATION_RESULT["test_execution"].nullable
