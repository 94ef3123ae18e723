"""Registry of the engine's queries over the driver's tables, each with its equivalent in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.functions import extract, scalars
from strandline.operators import aggregates, joins, predicates, setops, sorting, transitions, windows
from strandline.registry import ORACLE_SQL, QUERIES, load, query
from strandline.storage import shared_path

__all__ = ["ORACLE_SQL", "QUERIES"]


# --- transitions

#: Tests of events: those before this day stand for "pre", the others for "post".
POST = "2024-01-16"
STATUS_SQL = "CASE WHEN value < 25 THEN 'FAILED' WHEN value < 35 THEN 'ERROR' WHEN value < 45 THEN 'SKIPPED' ELSE 'PASSED' END"
RESULTS_SQL = f"""results AS (
  SELECT event_type AS project, user_id % 10 AS instance, user_id AS test, CASE WHEN ts < TIMESTAMP '{POST}' THEN 'pre' ELSE 'post' END AS phase, event_id AS pos, {STATUS_SQL} AS status
  FROM events
), last AS (
  SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY project, instance, test, phase ORDER BY pos DESC) = 1
), joined AS (
  SELECT coalesce(a.project, b.project) AS project, coalesce(a.instance, b.instance) AS instance, coalesce(a.test, b.test) AS test,
    coalesce(a.status, 'NOT_FOUND') AS pre_status, coalesce(b.status, 'NOT_FOUND') AS post_status
  FROM (SELECT * FROM last WHERE phase = 'pre') a FULL JOIN (SELECT * FROM last WHERE phase = 'post') b
  ON a.project = b.project AND a.instance = b.instance AND a.test = b.test
)"""


def kind_sql(failures: str) -> str:
    return f"""CASE WHEN pre_status IN ({failures}) AND post_status = 'PASSED' THEN 'FAIL_TO_PASS' WHEN pre_status = 'PASSED' AND post_status = 'PASSED' THEN 'PASS_TO_PASS'
      WHEN pre_status = 'PASSED' AND post_status IN ({failures}) THEN 'PASS_TO_FAIL' WHEN pre_status IN ({failures}) AND post_status IN ({failures}) THEN 'FAIL_TO_FAIL' END"""


INSTANCES_SQL = f"""WITH {RESULTS_SQL}, kinds AS (SELECT *, {kind_sql("'FAILED', 'ERROR'")} AS kind FROM joined), instances AS (
  SELECT project, instance, count(*) FILTER (kind = 'FAIL_TO_PASS') AS fail_to_pass, count(*) FILTER (kind = 'PASS_TO_PASS') AS pass_to_pass,
    count(*) FILTER (kind = 'PASS_TO_FAIL') AS pass_to_fail, count(*) FILTER (kind = 'FAIL_TO_FAIL') AS fail_to_fail,
    count(*) FILTER (pre_status = 'NOT_FOUND') AS added, count(*) FILTER (post_status = 'NOT_FOUND') AS removed, count(*) AS tests
  FROM kinds GROUP BY ALL
)"""
STATS_SQL = "count(*) AS instances, " + ", ".join(
    f"count(*) FILTER ({k} > 0) AS {k}_instances, sum({k})::BIGINT AS {k}_sum, max({k}) AS {k}_max, sum({k}) / nullif(count(*) FILTER ({k} > 0), 0)::DOUBLE AS {k}_mean"
    for k in ("fail_to_pass", "pass_to_pass", "fail_to_fail")
)


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    status = F.when(v < 25, "FAILED").when(v < 35, "ERROR").when(v < 45, "SKIPPED").otherwise("PASSED")
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("project"), (F.col("user_id") % 10).alias("instance"), F.col("user_id").alias("test"),
        F.when(F.col("ts") < POST, "pre").otherwise("post").alias("phase"), F.col("event_id").alias("pos"), status.alias("status"),
    )


def event_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.per_instance(transitions.join_phases(event_results(spark, sf_dir), ["project", "instance", "test"], "pos"), ["project", "instance"])


@query(f"{INSTANCES_SQL} SELECT * FROM instances")
def transitions_by_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_instances(spark, sf_dir)


@query(f"{INSTANCES_SQL} SELECT project, {STATS_SQL} FROM instances GROUP BY project")
def transitions_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.project_stats(event_instances(spark, sf_dir), "project", "instance")


@query(f"{INSTANCES_SQL} SELECT project, {STATS_SQL} FROM instances GROUP BY ROLLUP (project)")
def transitions_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.project_stats(event_instances(spark, sf_dir), "project", "instance", total=True)


@query(f"""{INSTANCES_SQL} SELECT project, string_agg(instance || ':' || fail_to_pass, ',' ORDER BY fail_to_pass DESC, instance) AS ranked
  FROM instances WHERE fail_to_pass > 0 GROUP BY project""")
def transitions_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.ranked_list(event_instances(spark, sf_dir), "project", "instance", "fail_to_pass")


@query(f"WITH {RESULTS_SQL} SELECT *, {kind_sql(repr('FAILED'))} AS kind FROM joined")
def transitions_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.join_phases(event_results(spark, sf_dir), ["project", "instance", "test"], "pos", ("FAILED",))


@query(f"""WITH {RESULTS_SQL}, p AS (SELECT DISTINCT project, instance, phase, test::VARCHAR AS test FROM results WHERE status = 'PASSED'),
  keys AS (SELECT DISTINCT project, instance FROM results)
  SELECT k.project, k.instance,
    coalesce((SELECT string_agg(test, ',' ORDER BY test) FROM p a WHERE a.project = k.project AND a.instance = k.instance AND a.phase = 'post'
      AND NOT EXISTS (SELECT 1 FROM p b WHERE b.project = k.project AND b.instance = k.instance AND b.phase = 'pre' AND b.test = a.test)), '') AS gained,
    coalesce((SELECT string_agg(test, ',' ORDER BY test) FROM p a WHERE a.project = k.project AND a.instance = k.instance AND a.phase = 'post'
      AND EXISTS (SELECT 1 FROM p b WHERE b.project = k.project AND b.instance = k.instance AND b.phase = 'pre' AND b.test = a.test)), '') AS kept
  FROM keys k""")
def transitions_setdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transitions.by_sets(event_results(spark, sf_dir), ["project", "instance"], F.col("test").cast("string"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("gained", "kept")})


# --- predicates


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_returnflag FROM lineitem
  WHERE regexp_matches(l_returnflag, '[AR]') AND l_quantity BETWEEN 10 AND 20 AND l_linenumber = 2""")
def typed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {"l_returnflag": "[AR]", "l_quantity": (10, 20), "l_linenumber": 2, "absent": 1}
    out = predicates.typed_filter(load(spark, sf_dir, "lineitem"), conditions)
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(p_type, 'PROMO|SMALL') AND p_size BETWEEN 5 AND 30")
def typed_filter_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.typed_filter(load(spark, sf_dir, "part"), {"p_type": "PROMO|SMALL", "p_size": (5, 30)}).select("p_partkey", "p_name", "p_type")


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
  WHERE NOT contains(coalesce(o_orderpriority, ''), 'URGENT') AND NOT contains(coalesce(o_orderstatus, ''), 'F')""")
def exclude_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predicates.without_marker(load(spark, sf_dir, "orders"), ["o_orderpriority"], "URGENT")
    return predicates.without_marker(out, ["o_orderstatus"], "F").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey, o_totalprice, '' AS fail_to_pass, '' AS pass_to_pass FROM orders")
def project_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predicates.with_defaults(load(spark, sf_dir, "orders"), {"fail_to_pass": "", "pass_to_pass": ""}, drop=("o_orderdate", "absent"))
    return out.select("o_orderkey", "o_custkey", "o_totalprice", "fail_to_pass", "pass_to_pass")


@query("""SELECT c_custkey, n_orders FROM (SELECT c_custkey, c_name, c_mktsegment, min(o_orderdate) AS merged, count(o_orderkey) AS n_orders
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) WHERE merged IS NOT NULL AND n_orders > 0 AND c_name <> '' AND trim(c_mktsegment) <> ''""")
def valid_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("merged"), F.collect_list("o_orderkey").alias("keys"))
    joined = load(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    valid = predicates.valid_pull(F.col("merged"), F.col("keys")) & predicates.has_text(F.col("c_name")) & predicates.has_text(F.col("c_mktsegment"), trimmed=True)
    return joined.where(valid).select("c_custkey", F.size("keys").cast("long").alias("n_orders"))


@query("""SELECT c_custkey, pre_total, post_total FROM (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') AS pre_total, count(*) FILTER (o_orderstatus = 'O') AS post_total
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) WHERE NOT (pre_total = 0 AND post_total = 0)""")
def zero_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("pre_total"), F.count_if(F.col("o_orderstatus") == "O").alias("post_total"))
    joined = load(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(predicates.active(F.col("pre_total"), F.col("post_total"))).select("c_custkey", "pre_total", "post_total")


LISTED = ["000000012", "000000077", "Customer#000000003", "3"]


@query(f"""WITH ids(x) AS (VALUES {", ".join(f"('{x}')" for x in LISTED)}), c AS (SELECT c_custkey, replace(c_name, '#', '-') AS name FROM customer)
  SELECT c_custkey, name, EXISTS (SELECT 1 FROM ids WHERE name = x OR ends_with(name, '-' || x) OR ends_with(name, '_' || x)) AS allowed FROM c""")
def suffix_allow_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = load(spark, sf_dir, "customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("-")).alias("name"))
    ids = spark.createDataFrame([(x,) for x in LISTED], "listed string")
    allowed = predicates.suffix_match(named, ids, "name").withColumn("allowed", F.lit(True))
    return allowed.unionByName(predicates.suffix_match(named, ids, "name", allow=False).withColumn("allowed", F.lit(False)))


@query("""WITH ids AS (SELECT 'Supplier-' || lpad(x, 9, '0') AS id FROM (VALUES ('3'), ('7'), ('11')) v(x))
  SELECT s_suppkey, replace(s_name, '#', '-') AS listed FROM supplier WHERE replace(s_name, '#', '-') IN (SELECT id FROM ids)""")
def normalised_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([("000000003",), ("000000007",), ("000000011",)], "listed string")
    known = extract.normal_ids(ids, [("supply", "Supplier"), ("demand", "Customer")], context="supply.jsonl")
    return predicates.allow_list(load(spark, sf_dir, "supplier").select("s_suppkey", F.replace("s_name", F.lit("#"), F.lit("-")).alias("listed")), known, "listed")


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents WHERE length(text) // 4 <= 400")
def min_limit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("small", 400), ("large", 2000)], "model string, context_limit long")
    chosen = spark.createDataFrame([("small",), ("large",), ("unknown",)], "model string")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"))
    return predicates.within_limit(docs, F.col("tokens"), limits, chosen)


@query("""SELECT event_id, CASE WHEN contains(p, 'build failed') THEN false WHEN contains(p, 'tests completed') THEN true ELSE user_id % 2 = 0 END AS ran,
    CASE WHEN p LIKE '%error:%' THEN true ELSE false END AS broken
  FROM (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'build failed. error: x' WHEN 'click' THEN '3 tests completed' ELSE 'nothing' END AS p FROM events)""")
def run_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.when(F.col("event_type") == "error", "BUILD FAILED. error: x").when(F.col("event_type") == "click", "3 tests completed").otherwise("nothing")
    rows = load(spark, sf_dir, "events").select("event_id", log.alias("log"), (F.col("user_id") % 2).alias("code"))
    return rows.select("event_id", predicates.tests_ran(F.col("log"), F.col("code")).alias("ran"), (F.size(predicates.error_lines(F.col("log"))) > 0).alias("broken"))


# --- first and last rows, order


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.keep_first(load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.keep_last_values(load(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", ["value"])


@query("SELECT doc_id, ntile(7) OVER (ORDER BY doc_id)::INTEGER AS shard FROM documents")
def ntile_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shards(load(spark, sf_dir, "documents").select("doc_id"), 7, [F.col("doc_id")])


@query("""SELECT conv_id, turn, role FROM (SELECT *, sum(CASE WHEN length(text) < 1000 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS bad FROM conversations)
  WHERE bad = 0""")
def temporal_take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    return windows.take_while(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], F.length("text") < 1000).select("conv_id", "turn", "role")


@query("""WITH c AS (SELECT o_custkey, min_by(o_orderdate, o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
  j AS (SELECT o.o_custkey, o.o_orderkey, o.o_orderdate < c.first AS ok, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS n FROM orders o JOIN c USING (o_custkey))
  SELECT o_custkey, o_orderkey FROM (SELECT *, bool_and(ok) OVER (PARTITION BY o_custkey ORDER BY n) AS held FROM j) WHERE held""")
def comments_before_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").withColumn("pos", F.col("o_orderkey"))
    commits = orders.where("o_orderstatus = 'F'").select("o_custkey", "pos", F.col("o_orderdate").alias("committed"))
    return joins.before_first(orders, commits, "o_custkey", "o_orderdate", "committed", [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER w AS n,
    sum(CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey))
  SELECT o_custkey, o_orderkey FROM o WHERE n <= 4 AND coalesce(bad, 0) = 0""")
def take_while_inclusive_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    order = [F.desc("o_orderdate"), F.col("o_orderkey")]
    return windows.take_while(rows, ["o_custkey"], order, F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"), inclusive=True, most=4).select("o_custkey", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey, round(running, 2) AS running, running - o_totalprice < 500000 AS counted, running < 500000 AS written FROM (
  SELECT o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running FROM orders)""")
def cost_running_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    out = windows.running_stop(rows, ["o_custkey"], [F.col("o_orderkey")], F.col("o_totalprice"), 500_000)
    return out.select("o_custkey", "o_orderkey", F.round("running", 2).alias("running"), "counted", "written")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
  f AS (SELECT source, doc_id, n_chars, n, n_chars < 20000 AS taken, CASE WHEN n_chars < 20000 THEN n_chars ELSE 0 END AS total FROM d WHERE n = 1
    UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.n, f.total + d.n_chars < 20000, CASE WHEN f.total + d.n_chars < 20000 THEN f.total + d.n_chars ELSE f.total END
    FROM f JOIN d ON d.source = f.source AND d.n = f.n + 1)
  SELECT source, doc_id, n_chars FROM f WHERE taken""")
def budget_fill_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.budget_fill(load(spark, sf_dir, "documents"), "source", ["doc_id"], "n_chars", 20_000, [])


@query("""WITH l AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
  m AS (SELECT *, contains(line, 'License') AS important, length(line) + 1 AS size FROM l),
  s AS (SELECT *, coalesce(sum(size) FILTER (important) OVER (PARTITION BY doc_id), 0) AS reserved, coalesce(sum(size) FILTER (NOT important) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS used FROM m)
  SELECT doc_id, count(*) AS n_lines, sum(size)::BIGINT AS total FROM s WHERE important OR used <= 500 - reserved GROUP BY doc_id""")
def budget_prefix_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = windows.number_lines(load(spark, sf_dir, "documents"), "text", ["doc_id"])
    size = (F.length("line") + 1).cast("long")
    out = windows.budget_prefix(lines, ["doc_id"], [F.col("line_no")], F.contains("line", F.lit("License")), size, 500)
    return out.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(size).alias("total"))


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
  f AS (SELECT source, doc_id, n_chars, n, 0 AS chunk, n_chars AS total FROM d WHERE n = 1
    UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.n, CASE WHEN f.total > 0 AND f.total + d.n_chars > 8000 THEN f.chunk + 1 ELSE f.chunk END,
      CASE WHEN f.total > 0 AND f.total + d.n_chars > 8000 THEN d.n_chars ELSE f.total + d.n_chars END
    FROM f JOIN d ON d.source = f.source AND d.n = f.n + 1)
  SELECT source, doc_id, n_chars, chunk FROM f""")
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.chunk_greedy(load(spark, sf_dir, "documents"), "source", ["doc_id"], "n_chars", 8000, [])


@query("""SELECT doc_id, line_no, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no FROM documents)""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.number_lines(load(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("""SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), greatest(3 - 2, 0) + 1, 3 + 4), '|') AS around FROM documents""")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = windows.lines_around(F.col("text"), F.lit(3), F.lit(4), 2)
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(around, "|").alias("around"))


@query("SELECT user_id, event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DECIMAL(18, 2)::VARCHAR AS moved FROM events")
def hunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.running_offset(load(spark, sf_dir, "events"), ["user_id"], [F.col("event_id")], F.col("value"), "moved")
    return out.select("user_id", "event_id", F.col("moved").cast("decimal(18,2)").cast("string").alias("moved"))


@query("SELECT conv_id, turn, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before FROM conversations")
def look_back_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.look_back(load(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], F.col("role"), 2, "before")
    return out.select("conv_id", "turn", F.array_join("before", ",").alias("before"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n % 10 = 0")
def checkpoint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.every_nth(load(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], 10).select("o_orderkey")


# --- joins


@query("SELECT o_orderkey, o_custkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority IS NOT NULL GROUP BY ALL")
def inner_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum("l_extendedprice").alias("total"))
    out = joins.inner(load(spark, sf_dir, "orders"), lines, "o_orderkey", ("o_orderpriority",))
    return out.select("o_orderkey", "o_custkey", "n_lines", F.round("total", 2).alias("total"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.anti(load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("""WITH a AS (SELECT o_custkey::VARCHAR AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey::VARCHAR AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
  SELECT k, n, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, n, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def symmetric_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = load(spark, sf_dir, "orders")
    one = [by.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")) for s in ("F", "P")]
    return joins.symmetric_anti(one[0], one[1], "k").select("k", "n", "side")


@query("""SELECT c_custkey, coalesce(array_to_string(list_slice(hits, 1, 3), ','), '') AS hits FROM customer LEFT JOIN
  (SELECT o_custkey, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS hits FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def left_default_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = aggregates.collected(load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], F.col("o_orderkey").cast("string"), ["o_orderkey"], "hits")
    out = joins.left_with_list(load(spark, sf_dir, "customer").select("c_custkey"), hits, "c_custkey", "hits", 3)
    return out.select("c_custkey", F.array_join("hits", ",").alias("hits"))


@query("""WITH p(event_type, in_price, out_price) AS (VALUES ('view', 0.5, 1.5), ('click', 1.0, 2.0), ('purchase', 3.0, 15.0))
  SELECT event_id, round(user_id / 1e6 * coalesce(in_price, 0) + event_id / 1e6 * coalesce(out_price, 0), 9) AS cost FROM events LEFT JOIN p USING (event_type)""")
def broadcast_price_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("view", 0.5, 1.5), ("click", 1.0, 2.0), ("purchase", 3.0, 15.0)], "event_type string, in_price double, out_price double")
    out = joins.lookup(load(spark, sf_dir, "events"), prices, "event_type", {"in_price": 0.0, "out_price": 0.0})
    return out.select("event_id", F.round(joins.cost(F.col("user_id"), F.col("event_id"), F.col("in_price"), F.col("out_price")), 9).alias("cost"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'ring' WHEN contains(lower(p_name), 'red') THEN 'red' WHEN contains(lower(p_name), 'bolt') THEN 'bolt' END AS family FROM part""")
def substring_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.rule_match(load(spark, sf_dir, "part").select("p_partkey", "p_name"), F.lower("p_name"), [("ring", "ring"), ("red", "red"), ("bolt", "bolt")], "family").select("p_partkey", "family")


WEIGHTS = [(r"^https://", 1.5), (r"/(?:en|de)/", 2.0), (r"page=[0-9]+", 1.2), (r"example\.org", 3.0)]


@query("""SELECT page_id, greatest(1.0, CASE WHEN regexp_matches(url, '^https://') THEN 1.5 ELSE 1 END, CASE WHEN regexp_matches(url, '/(?:en|de)/') THEN 2 ELSE 1 END,
    CASE WHEN regexp_matches(url, 'page=[0-9]+') THEN 1.2 ELSE 1 END, CASE WHEN regexp_matches(url, 'example\\.org') THEN 3 ELSE 1 END)::DOUBLE AS score FROM pages""".replace("\\\\", "\\"))
def theta_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", joins.heaviest_pattern(F.col("url"), WEIGHTS).alias("score"))


@query("""WITH s AS (SELECT page_id, url, html, CASE WHEN contains(html, 'lang="de"') THEN 1 ELSE 0 END AS de, CASE WHEN regexp_matches(url, '^https://') THEN 1.5 ELSE 1.0 END
    * CASE WHEN (contains(lower(html), 'track') AND contains(lower(url), 'track')) OR (contains(lower(html), 'ref') AND contains(lower(url), 'ref')) OR (contains(lower(html), '/en/') AND contains(lower(url), '/en/')) THEN 1.5 ELSE 1.0 END
    * CASE WHEN contains(lower(html), lower(regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1'))) THEN 2.0 ELSE 1.0 END AS score FROM pages)
  SELECT page_id, score::DOUBLE AS score FROM s""".replace("\\\\", "\\"))
def keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = extract.relevance(F.col("url"), F.col("html"), [(r"^https://", 1.5)], ("track", "ref", "/en/"))
    return load(spark, sf_dir, "pages").select("page_id", score.alias("score"))


@query("SELECT p_partkey, p_brand, p_type FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.p_size > 45)")
def element_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return joins.anti(part.select("p_partkey", "p_brand", "p_type"), part.where("p_size > 45").select("p_brand", "p_type"), ["p_brand", "p_type"])


@query("""SELECT s_suppkey, 'some' AS kind FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT s_suppkey, 'none' FROM supplier""")
def semi_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, lines = load(spark, sf_dir, "supplier").select("s_suppkey"), load(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    some = joins.guarded_semi(suppliers, lines.where("l_quantity > 49"), "s_suppkey").withColumn("kind", F.lit("some"))
    return some.unionByName(joins.guarded_semi(suppliers, lines.where("l_quantity > 1000"), "s_suppkey").withColumn("kind", F.lit("none")))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), h AS (SELECT DISTINCT string_split(path, '/')[1] AS prefix FROM p)
  SELECT page_id, prefix AS module FROM p LEFT JOIN h ON starts_with(path, prefix || '/')""")
def longest_prefix_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = load(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    hosts = paths.select(F.get(F.split("path", "/"), F.lit(0)).alias("prefix")).distinct().withColumn("module", F.col("prefix"))
    return joins.longest_prefix(paths, hosts, "path", "prefix", "module").select("page_id", "module")


@query("""WITH w AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'lost/' || p_name END AS path FROM part), f AS (SELECT p_name AS path, min_by(p_brand, p_partkey) AS brand FROM part GROUP BY 1),
  n AS (SELECT string_split(p_name, '/')[-1] AS name, min_by(p_brand, p_partkey) AS brand FROM part GROUP BY 1)
  SELECT p_partkey, coalesce(f.brand, n.brand) AS brand FROM w LEFT JOIN f USING (path) LEFT JOIN n ON n.name = string_split(w.path, '/')[-1]""")
def exact_or_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    wanted = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("lost/"), "p_name")).alias("path"))
    files = part.select(F.col("p_name").alias("path"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("pos"))
    return joins.exact_or_suffix(wanted, files, "path", "brand", "pos").select("p_partkey", "brand")


@query("""SELECT c.c_custkey, coalesce(string_agg(n.n_name, chr(10) ORDER BY r.pos), '') AS n_name
  FROM customer c LEFT JOIN (SELECT c_custkey, unnest([c_nationkey, c_nationkey + 1, 99]) AS k, unnest([0, 1, 2]) AS pos FROM customer) r USING (c_custkey) LEFT JOIN nation n ON n.n_nationkey = r.k GROUP BY 1""")
def enriched_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = load(spark, sf_dir, "customer").select("c_custkey", F.array("c_nationkey", F.col("c_nationkey") + 1, F.lit(99)).alias("refs"))
    return joins.enrich_text(parents, "refs", load(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "key"), "key", "n_name", ["c_custkey"])


@query("""SELECT e.event_id, (SELECT arg_max(o.value, o.event_id) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND o.ts <= e.ts AND o.ts = (SELECT max(x.ts) FROM events x
    WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts <= e.ts)) AS last_purchase FROM events e WHERE e.event_type = 'error'""")
def as_of_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts", "value")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return joins.as_of(events.where("event_type = 'error'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", ["last_purchase"]).select("event_id", "last_purchase")


# --- aggregates

RUNS_SQL = """runs AS (SELECT o_orderpriority AS run, o_orderstatus = 'F' AS success, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS duration,
    o_orderkey % 7 AS total, o_orderkey % 3 AS passed, o_orderkey % 2 AS failed FROM orders)"""
SUMMARY_SQL = """count(*) AS instances, count(*) FILTER (success) AS successful, coalesce(sum(total) FILTER (success), 0)::BIGINT AS total, coalesce(sum(passed) FILTER (success), 0)::BIGINT AS passed,
    coalesce(sum(failed) FILTER (success), 0)::BIGINT AS failed, round(avg(duration) FILTER (success), 4) AS mean_success, round(avg(duration) FILTER (duration > 0), 4) AS mean_positive,
    round(avg(coalesce(duration, 0)), 4) AS mean_all, round(sum(duration) / 3600, 4) AS hours, round(100.0 * count(*) FILTER (success) / count(*), 6)::DOUBLE AS success_rate,
    coalesce(round(100.0 * sum(passed) FILTER (success) / nullif(sum(total) FILTER (success), 0), 6), 0)::DOUBLE AS pass_rate"""


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    duration = F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice"))
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("run"), (F.col("o_orderstatus") == "F").alias("success"), duration.alias("duration"),
        (key % 7).alias("total"), (key % 3).alias("passed"), (key % 2).alias("failed"),
    )


def rounded(df: DataFrame) -> DataFrame:
    digits = {"mean_success": 4, "mean_positive": 4, "mean_all": 4, "hours": 4, "success_rate": 6, "pass_rate": 6}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items() if c in df.columns})


@query(f"WITH {RUNS_SQL} SELECT {SUMMARY_SQL} FROM runs")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.run_summary(order_runs(spark, sf_dir), []))


@query(f"WITH {RUNS_SQL} SELECT run, {SUMMARY_SQL} FROM runs GROUP BY run")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.compare_runs(order_runs(spark, sf_dir), "run"))


CHAIN = [("large", "big"), ("economy", "big"), ("small", "little"), ("promo", "offer")]


@query("""SELECT category, n, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS share FROM (SELECT CASE WHEN contains(lower(p_type), 'large') THEN 'big' WHEN contains(lower(p_type), 'economy') THEN 'big'
    WHEN contains(lower(p_type), 'small') THEN 'little' WHEN contains(lower(p_type), 'promo') THEN 'offer' ELSE 'other' END AS category, count(*) AS n FROM part GROUP BY 1)""")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.histogram(load(spark, sf_dir, "part"), extract.error_category(F.col("p_type"), CHAIN))
    return out.withColumn("share", F.round("share", 6))


@query("""SELECT event_type, count(*) AS requests, count(*) FILTER (value >= 10) AS successful, coalesce(sum(user_id) FILTER (value >= 10), 0)::BIGINT AS tokens, round(sum(value), 2) AS cost,
    round(avg(value) FILTER (value >= 10), 6) AS mean_time, round(100.0 * count(*) FILTER (value >= 10) / count(*), 6)::DOUBLE AS success_rate FROM events GROUP BY 1""")
def per_model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_type", F.when(F.col("value") < 10, "error").alias("error"), F.col("user_id").alias("tokens"), F.col("value").alias("cost"), F.col("value").alias("response_time"))
    out = aggregates.model_stats(rows, "event_type")
    return out.withColumns({"cost": F.round("cost", 2), "mean_time": F.round("mean_time", 6), "success_rate": F.round("success_rate", 6)})


@query("""SELECT l_returnflag, count(DISTINCT k) AS n FROM (SELECT l_returnflag, unnest([l_partkey, l_suppkey, l_orderkey]) AS k FROM lineitem) GROUP BY 1""")
def distinct_union_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", F.array("l_partkey", "l_suppkey").alias("a"), F.array("l_orderkey").alias("b"))
    return aggregates.distinct_over(rows, ["l_returnflag"], ["a", "b"], "n")


@query("SELECT c_nationkey, arg_max(c_custkey, c_acctbal * 1e7 - c_custkey / 1e6) AS longest, arg_min(c_custkey, c_acctbal * 1e7 + c_custkey / 1e6) AS shortest FROM customer GROUP BY 1")
def argmax_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.extremes(load(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal")


@query("""SELECT event_type, count(*) FILTER (s = 'PASSED') AS passed, count(*) FILTER (s = 'FAILED') AS failed, count(*) FILTER (s = 'SKIPPED') AS skipped, count(*) FILTER (s = 'ERROR') AS error, count(*) AS total
  FROM (SELECT event_type, """ + STATUS_SQL + """ AS s FROM events) GROUP BY 1""")  # fmt: skip
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    status = F.when(v < 25, "FAILED").when(v < 35, "ERROR").when(v < 45, "SKIPPED").otherwise("PASSED")
    return aggregates.status_counts(load(spark, sf_dir, "events").withColumn("status", status), ["event_type"], "status")


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def module_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    held = aggregates.collected(joined, ["r_name"], F.col("n_name"), ["n_nationkey"], "held")
    return held.select("r_name", F.array_join("held", ",").alias("nations"), F.size("held").cast("long").alias("n"))


@query("SELECT conv_id, string_agg(role, '|' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY 1")
def string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.collected(load(spark, sf_dir, "conversations"), ["conv_id"], F.col("role"), ["turn", "role", "text"], "roles", "|")


@query("""SELECT count(*) AS suites, sum(tests)::BIGINT AS tests, sum(failures)::BIGINT AS failures, sum(errors)::BIGINT AS errors, sum(skipped)::BIGINT AS skipped,
    floor(10000.0 * (sum(tests) - sum(failures) - sum(errors) - sum(skipped)) / sum(tests)) / 100 AS success_rate FROM (SELECT l_orderkey, count(*) AS tests, count(*) FILTER (l_returnflag = 'R') AS failures,
    0 AS errors, count(*) FILTER (l_returnflag = 'A') AS skipped FROM lineitem GROUP BY 1)""")
def suite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    suites = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("tests"), F.count_if(F.col("l_returnflag") == "R").alias("failures"), F.lit(0).cast("long").alias("errors"),
        F.count_if(F.col("l_returnflag") == "A").alias("skipped"), F.lit(0.0).alias("time"),
    )
    return aggregates.suite_totals(suites).drop("time")


@query(f"""{INSTANCES_SQL} SELECT count(*) AS instances, count(*) FILTER (instance < 8) AS successful, sum(fail_to_pass) FILTER (instance < 8)::BIGINT AS fail_to_pass, sum(pass_to_pass) FILTER (instance < 8)::BIGINT AS pass_to_pass,
    sum(pass_to_fail) FILTER (instance < 8)::BIGINT AS pass_to_fail, sum(fail_to_fail) FILTER (instance < 8)::BIGINT AS fail_to_fail, round(count(*) FILTER (instance < 8) / count(*), 6) AS success_rate FROM instances""")
def transition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_instances(spark, sf_dir).withColumn("success", F.col("instance") < 8)
    return aggregates.transition_totals(rows, percent=False).withColumn("success_rate", F.round("success_rate", 6))


@query("""SELECT count(*) AS instances, sum(pre)::BIGINT AS pre, sum(post)::BIGINT AS post, sum(fixed)::BIGINT AS fixed, count(*) FILTER (fixed = 0) AS none_fixed FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS pre,
    count(*) FILTER (o_orderstatus = 'O') AS post, count(*) FILTER (o_orderstatus = 'P') AS fixed FROM orders GROUP BY 1) WHERE pre > 0 OR post > 0""")
def fixed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "pre_total"), ("O", "post_total"), ("P", "fixed"))]
    return aggregates.fixed_summary(load(spark, sf_dir, "orders").groupBy("o_custkey").agg(*counts))


# --- sorting and sets


@query("""(SELECT doc_id, n_chars, 'top' AS "end" FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) UNION ALL (SELECT doc_id, n_chars, 'bottom' FROM documents ORDER BY n_chars, doc_id LIMIT 10)""")
def top_bottom_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.top_and_bottom(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("SELECT doc_id, length(text)::INTEGER AS length FROM documents ORDER BY length(text), doc_id LIMIT 25")
def shortest_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.shortest(load(spark, sf_dir, "documents"), "text", "doc_id", 25).select("doc_id", "length")


@query("""SELECT p_brand, arg_min(p_name, (CASE WHEN contains(p_type, 'SMALL') THEN 0 ELSE 1 END, length(p_name), p_name)) AS p_name FROM part GROUP BY 1""")
def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.pick(load(spark, sf_dir, "part"), ["p_brand"], "p_name", [F.when(F.contains("p_type", F.lit("SMALL")), 0).otherwise(1)])


@query("""SELECT s_nationkey, s_suppkey, rank FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INTEGER AS rank FROM supplier) WHERE rank <= greatest(4 - s_nationkey % 6, 0)""")
def remaining_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").withColumn("taken", F.col("s_nationkey") % 6)
    return sorting.remaining_slots(rows, ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 4, "taken").select("s_nationkey", "s_suppkey", "rank")


@query("""(SELECT 'except' AS op, k FROM (SELECT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 10)) UNION ALL
  (SELECT 'intersect', k FROM (SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 10))""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), load(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("k"))
    return setops.except_distinct(a, b, "k").select(F.lit("except").alias("op"), "k").unionByName(setops.intersect_distinct(a, b, "k").select(F.lit("intersect").alias("op"), "k"))


@query("SELECT o_custkey, o_orderkey, 'new' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, o_orderkey, 'old' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def merge_right_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    old, new = rows.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("old")), rows.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("new"))
    return setops.merge_right_wins(old, new, "o_orderkey").select("o_custkey", "o_orderkey", "origin")


# --- scalars and extraction


@query("""SELECT doc_id, length(text) // 4 AS by_chars, (length(text) // 4) * 6 // 5 AS with_margin, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) * 13 // 10 AS by_words FROM documents""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(n) for n, c in scalars.token_estimates(F.col("text")).items()])


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.absent.deep'), 'none') AS deep FROM events")
def json_get_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return load(spark, sf_dir, "events").select("event_id", scalars.json_default(p, "$.k", -1, "long").alias("k"), scalars.json_default(p, "$.absent.deep", "none").alias("deep"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') >= '1997-06-01T00:00:00Z'")
def date_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return load(spark, sf_dir, "orders").select("o_orderkey", stamp.alias("stamp")).where(F.col("stamp") >= scalars.cutoff_stamp("19970601"))


@query("SELECT doc_id, md5(CASE WHEN lang < 'source' THEN 'lang:' || lang || 'source:' || source END) AS key FROM documents")
def md5_content_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return load(spark, sf_dir, "documents").select("doc_id", scalars.content_key(files).alias("key"))


@query("""SELECT conv_id, md5('<issue>' || chr(10) || coalesce(first, '') || chr(10) || '</issue>' || chr(10) || '<code>' || chr(10) || files || chr(10) || '</code>') AS prompt_md5 FROM (
  SELECT conv_id, min_by(text, turn) AS first, string_agg('[start of ' || turn || ']' || chr(10) || text || chr(10) || '[end of ' || turn || ']', chr(10) ORDER BY turn::VARCHAR) AS files FROM (
    SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1) GROUP BY 1)""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.keep_first(load(spark, sf_dir, "conversations"), ["conv_id", "turn"], [F.col("role"), F.col("text")])
    held = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), F.col("text")))).alias("files"))
    return held.select("conv_id", F.md5(extract.prompt(F.coalesce("first", F.lit("")), F.col("files")).cast("binary")).alias("prompt_md5"))


@query("""
  SELECT event_id, CASE event_type WHEN 'view' THEN '+' || props WHEN 'click' THEN 'diff --git a/x b/x' || chr(10) || '+' || props ELSE '' END AS patch FROM events""")
def fence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("text\n```diff\n+"), "props", F.lit("\n```\nmore"))
    bare = F.concat(F.lit("diff --git a/x b/x\n+"), "props", F.lit("\n"))
    answer = F.when(F.col("event_type") == "view", fenced).when(F.col("event_type") == "click", bare).otherwise("only prose")
    return load(spark, sf_dir, "events").select("event_id", extract.fenced_patch(answer).alias("patch"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN user_id::VARCHAR || CASE WHEN event_id <> user_id THEN ',' || event_id ELSE '' END WHEN event_type = 'error' THEN '' ELSE event_id::VARCHAR END AS refs FROM events""")
def issue_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    both = F.concat(F.lit("Fixes #"), user, F.lit(" and closes #"), event, F.lit(", see #5 <!-- fixes #77 -->"))
    one = F.concat(F.lit("Resolved #"), event)
    text = F.when(F.col("event_type").isin("view", "click"), both).when(F.col("event_type") == "error", F.concat(F.lit("about #"), user)).otherwise(one)
    return load(spark, sf_dir, "events").select("event_id", F.array_join(extract.issue_refs(text), ",").alias("refs"))


@query("""SELECT p_partkey, ':m' || p_size || ':' || lower(substr(p_brand, 1, 5)) AS module, 'org.x' || p_size || '.C' || p_partkey AS class FROM part""")
def path_to_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.format_string("m%d/%s/src/test/java/org/x%d/C%d.java", F.col("p_size"), F.lower(F.substring("p_brand", 1, 5)), F.col("p_size"), F.col("p_partkey"))
    return load(spark, sf_dir, "part").select("p_partkey", extract.path_to_module(path).alias("module"), extract.path_to_class(path).alias("class"))


@query("""SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links FROM pages""")
def html_attr_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long")
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), links.alias("n_links"))


CONSOLE_STATUS_SQL = "CASE WHEN value < 25 THEN 'FAILED' WHEN value < 35 THEN 'SKIPPED' ELSE 'PASSED' END"


def event_logs(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """Events of each user as a text, a line each in the order of their ids."""
    return aggregates.collected(load(spark, sf_dir, "events"), ["user_id"], line, ["event_id"], "log", "\n")


@query(f"SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS pos, 'org.t.' || event_type AS class_name, 'case ' || event_id AS test_name, {CONSOLE_STATUS_SQL} AS status, CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END AS duration FROM events")
def console_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    status = F.when(v < 25, "FAILED").when(v < 35, "SKIPPED").otherwise("PASSED")
    timed = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" ("), v.cast("decimal(18,2)").cast("string"), F.lit(" s)"))).otherwise("")
    line = F.concat(F.lit("org.t."), "event_type", F.lit(" > case "), F.col("event_id").cast("string"), F.lit(" "), status, timed)
    return extract.console_tests(event_logs(spark, sf_dir, line), "log", ["user_id"])


@query(f"""SELECT user_id, event_type AS suite, 'case' || event_id AS test_name, {STATUS_SQL} AS status, event_type || '::case' || event_id AS identity FROM events""")
def suite_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    status = F.when(v < 25, "FAILED").when(v < 35, "ERROR").when(v < 45, "SKIPPED").otherwise("PASSED")
    line = F.concat(F.lit("Suite: "), "event_type", F.lit("\n  - case"), F.col("event_id").cast("string"), F.lit(" - "), status)
    return extract.report_suites(event_logs(spark, sf_dir, line), "log", ["user_id"]).drop("suite_no")


PATCH_PATH_SQL = "CASE WHEN event_type = 'error' THEN 'app/src/test/T' ELSE 'app/src/main/M' END || event_id || '.kt'"


def event_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each user: a file for each event, two hunks with wrong counts."""
    path = F.concat(F.when(F.col("event_type") == "error", "app/src/test/T").otherwise("app/src/main/M"), F.col("event_id").cast("string"), F.lit(".kt"))
    old = F.when(F.col("event_type") == "signup", "/dev/null").otherwise(F.concat(F.lit("a/"), path))
    hunk = "@@ -%d,9 +1,9 @@\n context\n-old\n+new\n"
    text = F.format_string(
        "diff --git a/%s b/%s\n--- %s\n+++ b/%s\n" + hunk + "+more\n" + hunk, path, path, old, path, F.lit(1), (F.col("event_id") % 50 + 10)
    )
    return aggregates.collected(load(spark, sf_dir, "events"), ["user_id"], text, ["event_id"], "patch", "")


@query(f"""SELECT user_id, count(*) FILTER (event_type = 'error') AS test_files, count(*) FILTER (event_type <> 'error') AS fix_files, count(*) FILTER (event_type = 'signup') AS new_files,
  string_agg({PATCH_PATH_SQL}, ',' ORDER BY event_id) AS files FROM events GROUP BY 1""")
def patch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = event_patches(spark, sf_dir).select("user_id", "patch", extract.split_patch(F.col("patch")).alias("s"))
    return parts.select(
        "user_id", F.size(extract.patch_files(F.col("s.test"))).cast("long").alias("test_files"), F.size(extract.patch_files(F.col("s.fix"))).cast("long").alias("fix_files"),
        F.size(extract.new_files(F.col("patch"))).cast("long").alias("new_files"), F.array_join(extract.changed_files(F.col("patch")), ",").alias("files"),
    )


@query(f"""SELECT user_id, {PATCH_PATH_SQL} AS path, 0 AS hunk_no, '@@ -1,2 +1,3 @@' AS header FROM events UNION ALL
  SELECT user_id, {PATCH_PATH_SQL}, 1, '@@ -' || (event_id % 50 + 10) || ',2 +' || (event_id % 50 + 11) || ',2 @@' FROM events""")
def patch_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.repair_headers(event_patches(spark, sf_dir), "patch", ["user_id"]).select("user_id", "path", "hunk_no", "header")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^STANDARD') THEN 'debug' WHEN regexp_matches(p_type, 'MO$') THEN 'release' WHEN regexp_matches(p_brand, '#1') THEN 'all' ELSE 'default' END AS variants FROM part""")
def rule_table_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("p_type", F.lit("|"), "p_brand")
    rules = [(r"^STANDARD", "debug"), (r"MO\|", "release"), (r"\|.*#1", "all")]
    return joins.rule_match(load(spark, sf_dir, "part").select("p_partkey", key.alias("key")), F.col("key"), rules, "variants", "default", regex=True).select("p_partkey", "variants")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'missing key' WHEN 2 THEN 'unexpected key' ELSE 'malformed' END AS reason FROM orders""")
def strict_reader_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.sources.readers import parse_jsonl
    from pyspark.sql.types import StructType

    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    good = F.to_json(F.struct(key.alias("id"), status.alias("status")))
    line = (
        F.when(key % 4 == 0, good).when(key % 4 == 1, F.to_json(F.struct(key.alias("id"))))
        .when(key % 4 == 2, F.to_json(F.struct(key.alias("id"), status.alias("status"), F.lit(1).alias("extra")))).otherwise(F.concat(F.lit("{bad "), good))
    )
    kept, rejected = parse_jsonl(load(spark, sf_dir, "orders").select("o_orderkey", line.alias("value")), StructType.fromDDL("id long, status string"))
    return kept.select("o_orderkey", F.lit("good").alias("reason")).unionByName(rejected.select("o_orderkey", "reason"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1")
def stream_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.streaming import state

    base = shared_path(spark, "stream")
    schema = load(spark, sf_dir, "events").schema
    folder, _, name = f"{sf_dir}/events.parquet".rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)
    state.run_to_end(state.running_stats(stream, ["event_type"], F.col("value")), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("total", F.round("total", 2))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0")
def resume_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.streaming import state

    path = shared_path(spark, "resume")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    state.resume_append(rows.where("o_orderkey % 2 = 0"), path, "o_orderkey", rows.schema)
    return state.resume_append(rows.where("o_orderkey % 2 = 0 or o_orderkey % 5 = 0"), path, "o_orderkey", rows.schema)


# --- further extraction: texts made from rows, so that the rows are the expected result

EVENT_STATUS_SQL = STATUS_SQL


def event_status() -> Column:
    v = F.col("value")
    return F.when(v < 25, "FAILED").when(v < 35, "ERROR").when(v < 45, "SKIPPED").otherwise("PASSED")


@query(f"SELECT user_id, 'C' || event_type AS class_name, 't' || event_id AS test_name, {STATUS_SQL} AS status FROM events")
def junit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = F.when(event_status() == "FAILED", "><failure>f</failure></testcase>").when(event_status() == "ERROR", "><error>e</error></testcase>")
    child = child.when(event_status() == "SKIPPED", "><skipped>s</skipped></testcase>").otherwise("/>")
    case = F.concat(F.lit('<testcase name="t'), F.col("event_id").cast("string"), F.lit('" classname="C'), "event_type", F.lit('"'), child)
    logs = event_logs(spark, sf_dir, case).withColumn("xml", F.concat(F.lit("<testsuite>"), "log", F.lit("<testcase/></testsuite>")))
    cases = logs.select("user_id", F.explode(extract.junit_embedded(F.col("xml"))).alias("c")).select("user_id", "c.*")
    return cases.where("test_name is not null")


@query(f"""SELECT user_id, event_type || '.xml' AS file, (SELECT 'body ' || min(f.event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_type = e.event_type) AS body FROM events e GROUP BY user_id, event_type""")
def log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("noise\n=== XML FILE: "), "event_type", F.lit(".xml ===\nbody "), F.col("event_id").cast("string"), F.lit("\n=== END"))
    return event_logs(spark, sf_dir, line).select("user_id", F.explode(extract.log_sections(F.col("log"))).alias("s")).select("user_id", "s.file", "s.body")


@query(f"SELECT user_id, 't' || event_id AS name, 'a.' || event_type AS class_name, {STATUS_SQL} AS status FROM events")
def report_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("  - t"), F.col("event_id").cast("string"), F.lit(" (a."), "event_type", F.lit(") - "), event_status())
    return event_logs(spark, sf_dir, line).select("user_id", F.explode(extract.report_lines(F.col("log"))).alias("r")).select("user_id", "r.*")


@query("SELECT user_id, string_agg(event_type || '; ' || event_id, chr(9) ORDER BY event_id) AS flat FROM events GROUP BY 1")
def flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("event_type", F.lit(", "), F.col("event_id").cast("string"))
    logs = event_logs(spark, sf_dir, line).withColumn("log", F.concat(F.lit("=====\n"), "log", F.lit("\nSummary: all\nTotal: 3")))
    return logs.select("user_id", extract.flat_report(F.col("log")).alias("flat"))


@query("""SELECT p_partkey, p_size || '.4' AS gradle, CASE WHEN p_size % 10 >= 8 THEN '17' WHEN p_size % 10 = 7 THEN '11' ELSE '8' END AS java, greatest(21, least(p_size, 34))::INTEGER AS sdk,
  '-Xmx' || p_size || 'm' AS jvm_args, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS ndk FROM part""")
def build_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    properties = F.concat(F.lit("distributionUrl=https\\://x/gradle-"), size, F.lit(".4-bin.zip\norg.gradle.jvmargs=-Xmx"), size, F.lit("m\n"))
    gradle = F.concat(F.lit("classpath 'com.android.tools.build:gradle:"), (F.col("p_size") % 10).cast("string"), F.lit(".1'\ncompileSdkVersion "), size, F.lit("\n"))
    gradle = F.concat(gradle, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ndkVersion = \""), size, F.lit("\"\n"))).otherwise(""))
    return load(spark, sf_dir, "part").select("p_partkey", extract.build_config(properties, gradle).alias("c")).select("p_partkey", "c.*")


@query("""SELECT p_partkey, ':app,:lib' || p_size || CASE WHEN p_size > 25 THEN ',:x:y' ELSE '' END AS modules, CASE p_size % 3 WHEN 0 THEN 'application' WHEN 1 THEN 'library' ELSE 'unknown' END AS kind FROM part""")
def settings_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = F.concat(F.lit("include ':app', ':lib"), F.col("p_size").cast("string"), F.lit("'\n// include ':no'\n"), F.when(F.col("p_size") > 25, 'include(":x:y")').otherwise(""))
    build = F.when(F.col("p_size") % 3 == 0, "id 'com.android.application'").when(F.col("p_size") % 3 == 1, "id 'com.android.library'").otherwise("nothing")
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.included_modules(settings), ",").alias("modules"), extract.module_type(build).alias("kind"))


@query("SELECT p_partkey, p_brand AS base, p_size::VARCHAR AS count FROM part")
def key_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("noise=1\nBASE_SHA="), "p_brand", F.lit("\nwords\nCOUNT="), F.col("p_size").cast("string"))
    m = extract.key_values(text)
    return load(spark, sf_dir, "part").select("p_partkey", F.try_element_at(m, F.lit("BASE_SHA")).alias("base"), F.try_element_at(m, F.lit("COUNT")).alias("count"))


@query("""SELECT event_id, event_type <> 'error' AS repo_cloned, event_type NOT IN ('error', 'view') AS container_created, event_type NOT IN ('error', 'view', 'click') AS prediction_patch_applied FROM events""")
def failure_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "error", "Failed to clone: x").when(kind == "view", "Failed to create container").when(kind == "click", "x Failed to apply prediction patch").otherwise("all good")
    s = load(spark, sf_dir, "events").select("event_id", extract.failure_stage(text).alias("s"))
    return s.select("event_id", "s.repo_cloned", "s.container_created", "s.prediction_patch_applied")


@query("""SELECT p_partkey, 2::BIGINT AS files, p_name || '2' || chr(10) AS content FROM part""")
def generated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def block(head: str, path: str, tail: str) -> Column:
        return F.concat(F.lit(f"{head}: {path}\n```kotlin\n"), "p_name", F.lit(f"{tail}\n```\n"))

    answer = F.concat(F.lit("Here:\n"), block("FILE", "a.kt", "1"), block("MODIFY", "b.kt", ""), block("FILE", "a.kt", "2"))
    m = extract.generated_files(answer)
    return load(spark, sf_dir, "part").select("p_partkey", F.size(m).cast("long").alias("files"), F.element_at(m, "a.kt")["content"].alias("content"))


@query("""SELECT event_id, 'src/M' || event_id || CASE event_type WHEN 'view' THEN '.kt' WHEN 'click' THEN '.java' ELSE '.py' END AS path, 'run' || user_id AS method FROM events WHERE event_type IN ('view', 'click', 'error')""")
def modified_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    path = F.concat(F.lit("src/M"), F.col("event_id").cast("string"), F.when(kind == "view", ".kt").when(kind == "click", ".java").otherwise(".py"))
    line = F.when(kind == "view", F.concat(F.lit("+    fun run"), user, F.lit("(a: Int) {"))).when(kind == "click", F.concat(F.lit("+    public static int run"), user, F.lit("(int a) {")))
    line = line.when(kind == "error", F.concat(F.lit("+def run"), user, F.lit("(a):"))).otherwise("+run = call(a)")
    patch = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1 +1 @@\n fun kept() {\n-fun gone() {\n+ if (x) {\n"), line, F.lit("\n"))
    rows = load(spark, sf_dir, "events").select("event_id", patch.alias("patch"))
    return extract.modified_methods(rows, "patch", ["event_id"])


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'freeDebug,paidDebug' ELSE 'free,release' END AS preferred, CASE WHEN p_size > 25 THEN 'Free,Paid' ELSE '' END AS flavors FROM part""")
def variant_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = F.col("p_size") > 25
    variants = F.when(many, F.array(F.lit("freeDebug"), F.lit("paidDebug"), F.lit("release"))).otherwise(F.array(F.lit("free"), F.lit("release")))
    tasks = F.when(many, F.array(F.lit("testPaidDebugUnitTest"), F.lit("testFreeDebugUnitTest"), F.lit("testFreeReleaseUnitTest"))).otherwise(F.array(F.lit("lint")))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.preferred_variants(variants), ",").alias("preferred"), F.array_join(aggregates.task_flavors(tasks), ",").alias("flavors"))


@query("""SELECT event_id, event_type = 'view' AS valid, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'no patch markers' WHEN 'error' THEN 'too short' ELSE 'empty' END AS reason FROM events""")
def patch_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    patch = F.when(kind == "view", "diff --git a/x b/x\n+1").when(kind == "click", "some\nwords").when(kind == "error", "@@ -1 +1 @@").otherwise(" \n")
    return load(spark, sf_dir, "events").select("event_id", predicates.patch_format(patch).alias("f")).select("event_id", "f.valid", "f.reason")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'diff --git a/x b/x' || chr(10) || '+' || event_id || chr(10) WHEN 'click' THEN 'diff --git a/x b/x' || chr(10) || '@@ -1 +1 @@' || chr(10) || '+' || event_id || chr(10)
  WHEN 'error' THEN 'diff --git a/y b/y' || chr(10) || '--- a/y' || chr(10) || '+++ b/y' || chr(10) || '+' || event_id || chr(10) || ' kept' || chr(10) ELSE '+line ' || event_id || chr(10) END AS patch FROM events""")
def best_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.functions import parsers

    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    fenced = F.concat(F.lit("so\n```diff\ndiff --git a/x b/x\n+"), number, F.lit("\n```\nthat is it"))
    bare = F.concat(F.lit("say\ndiff --git a/x b/x\n@@ -1 +1 @@\n+"), number, F.lit("\nbye\nbye\nbye\n+ not part"))
    headed = F.concat(F.lit("say\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n+"), number, F.lit("\n kept\none\ntwo\nthree\nfour"))
    answer = F.when(kind == "view", fenced).when(kind == "click", bare).when(kind == "error", headed).otherwise(F.concat(F.lit("I think\n+line "), number, F.lit("\nis the fix")))
    return load(spark, sf_dir, "events").select("event_id", parsers.best_patch(answer).alias("patch"))


@query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'License')))::BIGINT AS n, length(text)::INTEGER - 5 AS chars FROM documents""")
def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = extract.diff_size(F.lit("12345"), F.col("text"))
    hits = F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("License")))).cast("long")
    return load(spark, sf_dir, "documents").select("doc_id", hits.alias("n"), grown["chars"].alias("chars"))


@query("""SELECT conv_id, md5('<issue>' || chr(10) || coalesce(first, '') || chr(10) || '</issue>') AS brief_md5, md5(string_agg('1 ' || role, chr(10) ORDER BY turn::VARCHAR)) AS numbered_md5 FROM (
  SELECT *, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1)) GROUP BY conv_id, first""")
def prompt_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.keep_first(load(spark, sf_dir, "conversations"), ["conv_id", "turn"], [F.col("role"), F.col("text")])
    held = rows.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first"), F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), F.col("role")))).alias("files"))
    numbers = F.array_join(F.transform(F.array_sort(F.map_entries("files")), lambda e: extract.numbered(e["value"])), "\n")
    return held.select("conv_id", F.md5(extract.prompt_brief(F.coalesce("first", F.lit(""))).cast("binary")).alias("brief_md5"), F.md5(numbers.cast("binary")).alias("numbered_md5"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL) SELECT start, event_type, n, total FROM w""")
def windowed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.streaming import state

    out = state.windowed_stats(load(spark, sf_dir, "events"), "ts", ["event_type"], F.col("value"), "1 hour", "1 hour")
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS binary_files, count(*) FILTER (event_type <> 'view') AS text_files FROM events GROUP BY 1""")
def patch_binary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("f"), F.col("event_id").cast("string"))
    body = F.when(F.col("event_type") == "view", "Binary files a/x and b/x differ\n").otherwise("@@ -1 +1 @@\n-a\n+b\n")
    part = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"), body)
    patches = aggregates.collected(load(spark, sf_dir, "events"), ["user_id"], part, ["event_id"], "patch", "")
    s = patches.select("user_id", extract.split_binary(F.col("patch")).alias("s"))
    return s.select("user_id", *[F.size(extract.patch_files(F.col(f"s.{k}"))).cast("long").alias(f"{k}_files") for k in ("binary", "text")])


@query("""SELECT o.o_orderkey, (SELECT arg_min(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) FROM lineitem WHERE l_orderkey = o_orderkey) AS flag FROM orders o""")
def first_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("flag"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("pos"))
    return joins.first_detail(load(spark, sf_dir, "orders").select("o_orderkey"), details, "o_orderkey", "flag", "pos")


@query("""SELECT count(*) AS processed, count(*) FILTER (length(text) > 1000) AS extracted, count(*) FILTER (length(text) < 100) AS skipped, round(100.0 * count(*) FILTER (length(text) > 1000) / count(*), 6)::DOUBLE AS rate FROM documents""")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.progress_counts(load(spark, sf_dir, "documents"), F.length("text") > 1000, F.length("text") < 100)
    return out.withColumn("rate", F.round("rate", 6))


@query("""SELECT p_partkey, CASE WHEN p_size <= 15 THEN '10.0.0' WHEN p_size <= 30 THEN '20.0.0' ELSE '40.0.0' END AS version FROM part""")
def nearest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = sorting.nearest_version(F.concat(F.col("p_size").cast("string"), F.lit(".0.0")), [(10, 0, 0), (20, 0, 0), (40, 0, 0)])
    return load(spark, sf_dir, "part").select("p_partkey", version.alias("version"))


@query("""SELECT p_partkey, regexp_matches(name, '^(Util|Utils|Helper|Mock)|(Util|Utils|Helper|Mock)$|^I[A-Z]') AS utility FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Mock' || p_name WHEN 1 THEN p_name || 'Utils' WHEN 2 THEN 'IThing' WHEN 3 THEN 'Item' ELSE p_name END AS name FROM part)""")
def utility_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    name = F.when(k == 0, F.concat(F.lit("Mock"), "p_name")).when(k == 1, F.concat("p_name", F.lit("Utils"))).when(k == 2, "IThing").when(k == 3, "Item").otherwise(F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", extract.is_utility(name, ("Util", "Utils", "Helper", "Mock")).alias("utility"))


@query("""SELECT p_partkey, 'app' || p_size AS modules, 'm' || p_size || '.C' AS tests FROM part""")
def target_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = F.concat(F.lit("app"), F.col("p_size").cast("string"))
    targets = F.array(F.concat(module, F.lit(":testDebugUnitTest")), F.lit(":test"))
    tests = extract.inferred_tests(F.array(F.concat(F.lit("m"), F.col("p_size").cast("string"))), F.array(F.lit("C")))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.modules_of_targets(targets), ",").alias("modules"), F.array_join(tests, ",").alias("tests"))


from strandline import queries_files, queries_flags  # noqa: E402, F401  registers their queries
