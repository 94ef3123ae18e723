"""Queries of scans and sinks: rows are written to the shared folder in each format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from strandline.plans import reports
from strandline.registry import load, query
from strandline.sources import readers, sinks
from strandline.storage import shared_path
from strandline.streaming import state

NATION = StructType([StructField("n_nationkey", IntegerType()), StructField("n_name", StringType()), StructField("n_regionkey", IntegerType())])


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


def write_text(df: DataFrame, path: str, value: Column, by: list[str] | None = None) -> None:
    """Lines, in folders by column if there are any."""
    rows = df.select(value.alias("value"), *(by or []))
    (rows.repartition(*by).write.partitionBy(*by) if by else rows.write).text(path)


@query("SELECT c_custkey, c_name || '\"q\", ' || chr(10) || c_mktsegment AS note, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance FROM customer")
def csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    note = F.concat("c_name", F.lit('"q", \n'), "c_mktsegment")
    rows = load(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("balance"))
    sinks.write_csv(rows, path)
    return readers.read_csv(spark, path, rows.schema)


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS n_name FROM nation UNION ALL SELECT n_nationkey::VARCHAR, n_name FROM nation WHERE n_regionkey = 1")
def csv_strings_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    sinks.write_csv(nations(spark, sf_dir).select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("n_name")), path)
    sinks.append_csv(nations(spark, sf_dir).where("n_regionkey = 1").select("n_nationkey", "n_name"), path)
    return readers.read_csv_strings(spark, path, ["n_nationkey", "n_name"])


@query("SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'a,b' ELSE '' END AS rest FROM supplier")
def csv_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "positional")
    key = F.col("s_suppkey").cast("string")
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(key, F.lit(","), "s_name", F.lit(",a,b"))).otherwise(key).alias("line"))
    write_text(rows, path, F.explode(F.array(F.lit("key,name,rest"), F.col("line"))), ["s_suppkey"])
    return readers.read_positional(spark, f"{path}/*", ["key", "name", "rest"])


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN NULL ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 3 < 2")
def jsonl_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "jsonl")
    key = F.col("n_nationkey") % 3
    row = F.to_json(F.struct("n_nationkey", "n_name"))
    write_text(nations(spark, sf_dir), path, F.when(key == 0, row).when(key == 1, F.to_json(F.struct("n_nationkey", F.lit(1).alias("more")))).otherwise(F.concat(F.lit("{bad "), row)))
    return readers.read_jsonl_dynamic(spark, path, StructType.fromDDL("n_nationkey int, n_name string")).where("n_nationkey is not null")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation WHERE n_regionkey = 2")
def jsonl_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "append") + ".jsonl"
    sinks.write_jsonl(nations(spark, sf_dir), path)
    sinks.append_jsonl(nations(spark, sf_dir).where("n_regionkey = 2").withColumn("n_name", F.lit(None).cast("string")), path)
    return readers.read_dataset(spark, path, NATION)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "array")
    write_text(sinks.as_json_array(nations(spark, sf_dir), [F.col("n_nationkey")]), f"{path}/all.json", F.col("json"))
    return readers.read_dataset(spark, f"{path}/all.json", NATION)


@query("SELECT 'project=' || n_regionkey AS project, 'instance=' || n_nationkey AS instance, n_name, n_nationkey % 4 <> 3 AS good FROM (SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 4 <> 3 THEN n_name END AS n_name FROM nation)")
def documents_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "documents")
    rows = nations(spark, sf_dir).withColumns({"project": F.col("n_regionkey"), "instance": F.col("n_nationkey")})
    body = F.to_json(F.struct("n_name"))
    write_text(rows, path, F.when(F.col("n_nationkey") % 4 == 3, F.concat(F.lit("{x"), body)).otherwise(body), ["project", "instance"])
    good, bad = readers.read_documents(spark, path, StructType.fromDDL("n_name string"), "part-*")
    return good.select("project", "instance", "n_name", F.lit(True).alias("good")).unionByName(bad.select("project", "instance", F.lit(None).cast("string").alias("n_name"), F.lit(False).alias("good")))


@query("SELECT r_regionkey, length(r_name) + 1 AS length FROM region")
def files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "listed")
    write_text(load(spark, sf_dir, "region"), path, F.col("r_name"), ["r_regionkey"])
    found = readers.files_below(spark, [path, path], "part-*")
    return found.select(F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).cast("int").alias("r_regionkey"), "length")


@query("""SELECT r_name AS suite, count(*) AS tests, count(*) FILTER (n_nationkey % 4 = 1) AS failures, 0::BIGINT AS skipped, string_agg('t' || n_nationkey || CASE n_nationkey % 4 WHEN 1 THEN ' FAILED' WHEN 2 THEN ' ERROR' WHEN 3 THEN ' SKIPPED' ELSE ' PASSED' END, ',' ORDER BY n_nationkey) AS cases
  FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def junit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "junit")
    kind = F.col("n_nationkey") % 4
    child = F.when(kind == 1, "><failure>f</failure></testcase>").when(kind == 2, "><error>e</error></testcase>").when(kind == 3, "><skipped>s</skipped></testcase>").otherwise("/>")
    case = F.concat(F.lit('<testcase classname="C" name="t'), F.col("n_nationkey").cast("string"), F.lit('"'), child)
    joined = nations(spark, sf_dir).join(load(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    held = joined.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", case.alias("c")))), lambda x: x["c"]), "").alias("cases"), F.count("*").alias("n"), F.count_if(kind == 1).alias("f"))
    xml = F.concat(F.lit('<testsuite name="'), "r_name", F.lit('" tests="'), F.col("n").cast("string"), F.lit('" failures="'), F.col("f").cast("string"), F.lit('">'), "cases", F.lit("</testsuite>"))
    write_text(held.withColumn("folder", F.col("r_name")), path, xml, ["folder"])
    suites = readers.read_junit(spark, f"{path}/*/*")
    cases = readers.junit_cases(suites).groupBy("suite").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "test_name", "status").alias("c")))), lambda x: x["c"]), ",").alias("cases"))
    return suites.select("suite", "tests", "failures", "skipped").join(cases, "suite")


@query("SELECT n_nationkey, n_regionkey + 1 AS page, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS pos FROM nation WHERE n_regionkey < 3")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "pages")
    by = nations(spark, sf_dir).groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: x.cast("string")), "\n").alias("value"))
    # the fourth page is absent, so the fifth is never asked for
    write_text(by.where("n_regionkey <> 3").withColumn("page", F.col("n_regionkey") + 1), path, F.col("value"), ["page"])
    return readers.read_pages(spark, path).select(F.col("value").cast("int").alias("n_nationkey"), "page", "pos")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= coalesce((SELECT min(o_orderkey) FROM orders WHERE o_orderdate < (SELECT min(o_orderdate) + INTERVAL 3 DAY FROM orders)), 0)) UNION ALL
  SELECT -o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4)""")
def listing_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    day = load(spark, sf_dir, "orders").agg(F.date_format(F.min("o_orderdate") + F.expr("interval 3 days"), "yyyy-MM-dd'T'HH:mm:ss").alias("day")).first()["day"]
    some = readers.until_cutoff(rows, [F.col("o_orderkey")], F.col("at"), day).select("o_orderkey")
    return some.unionByName(readers.until_cutoff(rows, [F.col("o_orderkey")], F.col("at"), "0000", most=3).select((-F.col("o_orderkey")).alias("o_orderkey")))


@query("SELECT n_regionkey, md5(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10)) AS text_md5 FROM nation GROUP BY 1")
def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "texts")
    held = nations(spark, sf_dir).groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\n").alias("value"))
    write_text(held, path, F.col("value"), ["n_regionkey"])
    found = readers.read_whole(spark, path).where(F.contains("path", F.lit("n_regionkey=")))
    return found.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("n_regionkey"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT 'even' AS route, n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'low', n_nationkey FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'all', n_nationkey FROM nation")
def routed_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "routes")
    routes = {"even": F.col("n_nationkey") % 2 == 0, "low": F.col("n_nationkey") < 10, "all": F.lit(True)}
    sinks.write_routed(nations(spark, sf_dir), {f"{path}/{k}": v for k, v in routes.items()})
    read = [spark.read.schema(NATION).json(f"{path}/{k}").select(F.lit(k).alias("route"), "n_nationkey") for k in routes]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "entities")
    sinks.write_by_entity(nations(spark, sf_dir), path, "n_regionkey")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    lines = files.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("n_regionkey"), F.explode(F.split(F.btrim(F.col("content").cast("string"), F.lit("\n")), "\n")))
    return lines.groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM nation) AS total, md5((SELECT string_agg(n_name || ':' || n_regionkey, ',' ORDER BY n_nationkey) FROM nation)) AS results_md5""")
def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nations(spark, sf_dir)
    path = shared_path(spark, "summary")
    write_text(sinks.summary_document(rows.agg(F.count("*").alias("total")), rows, "n_nationkey"), path, F.to_json(F.struct("total", "results")))
    schema = "total long, results map<string, struct<n_name: string, n_regionkey: int>>"
    doc = spark.read.text(path, wholetext=True).where("value <> ''").select(F.from_json("value", schema).alias("d")).select("d.*")
    by_number = F.array_sort(F.transform(F.map_entries("results"), lambda e: F.struct(e["key"].cast("int").alias("key"), e["value"].alias("value"))))
    entries = F.transform(by_number, lambda e: F.concat_ws(":", e["value"]["n_name"], e["value"]["n_regionkey"].cast("string")))
    return doc.select("total", F.md5(F.array_join(entries, ",").cast("binary")).alias("results_md5"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{\"id\":\"' || n_nationkey || '\"}' ELSE 'raw ' || n_nationkey END AS line FROM nation")
def pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    lines = nations(spark, sf_dir).select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('{"id": '), key, F.lit(', "x": 1}'))).otherwise(F.concat(F.lit("raw "), key)).alias("line"))
    parsed = F.get_json_object("line", "$.id")
    return sinks.pass_through(lines, parsed, F.to_json(F.struct(parsed.alias("id"))), "line")


@query("""SELECT 'orders' || chr(10) || '======' || chr(10) || 'instances     ' || count(*) || chr(10) || 'success_rate  ' || format('{:.2f}', 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)) || chr(10) AS report FROM orders""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    success = F.col("o_orderstatus") == "F"
    execution = F.struct(F.lit(2).cast("long").alias("total_tests"), F.lit(1).cast("long").alias("passed"), F.lit(1).cast("long").alias("failed"))
    rows = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("instance_id"), F.lit("m").alias("model_name"), success.alias("success"), F.lit(1.0).alias("total_duration"),
        F.when(success, execution).alias("test_execution"), F.lit(None).cast("string").alias("error_message"),
    )
    whole = reports.evaluation_text(rows, "orders").split("\n")
    told = {x.split()[0]: x.split()[-1] for x in whole[2:] if x}
    text = sinks.report("orders", [(k, told[k]) for k in ("instances", "success_rate")])
    return spark.createDataFrame([(text,)], "report string")


@query("SELECT 'n_nationkey=' || n_nationkey AS instance FROM nation WHERE n_nationkey % 3 = 0")
def done_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "markers")
    write_text(nations(spark, sf_dir).where("n_nationkey % 3 = 0"), f"{path}/done", F.col("n_name"), ["n_nationkey"])
    return state.done_by_marker(spark, f"{path}/done", "part-*")


@query("SELECT 'kept' AS run, n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'forced', n_nationkey FROM nation WHERE n_regionkey = 2")
def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = nations(spark, sf_dir).select("n_nationkey", "n_regionkey"), shared_path(spark, "once")
    for region in (1, 2):
        kept = state.run_once(rows.where(F.col("n_regionkey") == region), f"{path}/a")
    state.run_once(rows.where("n_regionkey = 1"), f"{path}/b")
    forced = state.run_once(rows.where("n_regionkey = 2"), f"{path}/b", force=True)
    return kept.select(F.lit("kept").alias("run"), "n_nationkey").unionByName(forced.select(F.lit("forced").alias("run"), "n_nationkey"))


@query("SELECT doc_id, md5(text) AS key, doc_id % 2 = 0 AS hit FROM documents")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key")).withColumn("own", F.concat_ws(":", "key", "doc_id"))
    hits, misses = state.cached(items, items.where("doc_id % 2 = 0").select("own", F.lit(True).alias("hit")), "own")
    return hits.select("doc_id", "key", "hit").unionByName(misses.select("doc_id", "key", F.lit(False).alias("hit")))


@query("SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_path(spark, "distinct")
    folder, _, name = f"{sf_dir}/events.parquet".rpartition("/")
    stream = spark.readStream.schema(load(spark, sf_dir, "events").schema).option("pathGlobFilter", name).parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    first = state.distinct_stream(stream, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type", F.lit(True).alias("seen"))
    state.run_to_end(first, f"{base}/out", f"{base}/checkpoint", "append")
    return spark.read.parquet(f"{base}/out")
