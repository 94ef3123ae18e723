"""Queries of classifiers, flags and picks, over texts that are made from rows so that the rows are the expected result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.functions import extract, markers, parsers
from strandline.operators import joins, predicates, setops, sorting, windows
from strandline.registry import load, query


def listed(words: tuple[str, ...]) -> str:
    """Words as an SQL list."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def word_of(words: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (number % len(words) + 1).cast("int"))


def marked(words: tuple[str, ...], number: Column, upper: bool = False) -> Column:
    """A text with one of the words for three of four numbers."""
    word = word_of(words, number)
    return F.concat(F.lit("line one\nnow "), F.when(number % 4 == 0, "nothing").otherwise(F.upper(word) if upper else word), F.lit(" it says\nend"))


@query(f"SELECT p_partkey, p_partkey % 4 <> 0 OR contains('nothing', list_extract({listed(markers.COMPILE_ERRORS)}, (p_partkey % {len(markers.COMPILE_ERRORS)} + 1)::INTEGER)) AS broken FROM part")
def compile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = marked(markers.COMPILE_ERRORS, F.col("p_partkey"), upper=True)
    return load(spark, sf_dir, "part").select("p_partkey", predicates.compile_failed(log).alias("broken"))


@query(f"""WITH m AS (SELECT o_orderkey, o_custkey % 2 AS code, list_extract({listed(markers.RUN_FAILED + markers.RUN_EXECUTED)}, (o_orderkey % 17 + 1)::INTEGER) AS word, o_orderkey % 17 < 8 AS bad FROM orders)
  SELECT o_orderkey, CASE WHEN word = lower(word) THEN NOT bad ELSE lower(word) <> 'build failed' AND code = 0 END AS ran, CASE WHEN bad THEN false ELSE true END AS ran_folded FROM m""")
def test_run_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.concat(F.lit("start\n"), word_of(markers.RUN_FAILED + markers.RUN_EXECUTED, F.col("o_orderkey")), F.lit("\nend"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", log.alias("log"), (F.col("o_custkey") % 2).alias("code"))
    return rows.select("o_orderkey", predicates.tests_ran(F.col("log"), F.col("code")).alias("ran"), predicates.tests_ran(F.col("log"), F.col("code"), fold=True).alias("ran_folded"))


LOG_HEAD = "/src/A.java:3: error: cannot find symbol"
LOG_LINES = ("  detail", "Daemon #4 is gone", "", "more", "three", "four", "five", "six", "e: file:///x/B.kt:1:2 Unresolved reference: y", "next", "* FAILURE: Build failed with an exception.", "Using Java: 17", "* Try:", "last")


@query(f"""WITH l AS (SELECT event_id, event_type, repeat('z', 600) AS pad FROM events)
  SELECT event_id, md5(CASE event_type WHEN 'error' THEN '{LOG_HEAD} ' || event_id || chr(10) || array_to_string(['detail', 'more', 'three', 'four', 'five', 'e: file:///x/B.kt:1:2 Unresolved reference: y', 'next',
    '* FAILURE: Build failed with an exception.', '* Try:', 'last'], chr(10))
    WHEN 'view' THEN 'symbol: ' || event_id || pad WHEN 'click' THEN 'BUILD FAILED' || chr(10) || chr(10) || 'quiet' || chr(10) || 'BUILD FAILED' ELSE chr(10) || chr(10) || 'quiet ' || event_id END) AS log_md5,
    event_type = 'view' AS long FROM l WHERE event_type <> 'error' UNION ALL
  SELECT event_id, md5(f || chr(10) || chr(10) || '{LOG_HEAD} ' || event_id || chr(10) || array_to_string({listed(LOG_LINES)}, chr(10))), false FROM (SELECT event_id, '{LOG_HEAD} ' || event_id || chr(10) ||
    array_to_string(['detail', 'more', 'three', 'four', 'five', 'e: file:///x/B.kt:1:2 Unresolved reference: y', 'next', '* FAILURE: Build failed with an exception.', '* Try:', 'last'], chr(10)) AS f FROM l WHERE event_type = 'error')""")
def relevant_build_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    broken = F.concat(F.lit(LOG_HEAD + " "), number, F.lit("\n" + "\n".join(LOG_LINES)))
    log = F.when(kind == "error", broken).when(kind == "view", F.concat(F.lit("quiet\nsymbol: "), number, F.lit("z" * 600))).when(kind == "click", "quiet\nBUILD FAILED").otherwise(F.concat(F.lit("quiet "), number))
    found = load(spark, sf_dir, "events").select("event_id", kind.alias("event_type"), parsers.relevant_log_udf(log).alias("found"))
    return found.select("event_id", F.md5(F.col("found").cast("binary")).alias("log_md5"), ((F.length("found") > 500) & (F.col("event_type") == "view")).alias("long"))


@query(f"""SELECT p_partkey, p_partkey % 4 <> 3 AS utility, p_partkey % 4 = 3 AS runs FROM (SELECT p_partkey, list_extract({listed(markers.UTILITY_WORDS)}, (p_partkey % {len(markers.UTILITY_WORDS)} + 1)::INTEGER) AS word FROM part)""")
def utility_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, word = F.col("p_partkey"), word_of(markers.UTILITY_WORDS, F.col("p_partkey"))
    name = F.when(key % 4 == 0, F.concat(word, F.lit("Xyz.kt"))).when(key % 4 == 1, F.concat(F.lit("a/b/Xyz"), word, F.lit(".java"))).when(key % 4 == 2, "IXyzTest").otherwise(F.concat(F.lit("c/Xyz"), word, F.lit("Test.kt")))
    return load(spark, sf_dir, "part").select("p_partkey", extract.is_utility(name).alias("utility"), extract.is_test_class(name, F.lit("@Test fun a()")).alias("runs"))


@query(f"""SELECT p_partkey, sign OR p_partkey % 5 = 0 AS has_tests FROM (SELECT p_partkey, list_extract({listed(markers.TEST_METHOD_SIGNS)}, (p_partkey % 16 + 1)::INTEGER) = '@Test' AS sign FROM part)""")
def test_method_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    sign = word_of(markers.TEST_METHOD_SIGNS, key)
    only = F.when(sign.startswith("@Test") & (sign != "@Test"), "@RepeatedTest").when(sign == "public void test", "void test").otherwise(sign)
    source = F.when(key % 5 == 0, F.concat(F.lit("class A { "), only, F.lit(" describe( it( }"))).otherwise(F.concat(F.lit("class A { "), only, F.lit(" }")))
    return load(spark, sf_dir, "part").select("p_partkey", extract.has_test_methods(source).alias("has_tests"))


PATHS = ("app/src/test/A.kt", "app/src/commonTest/B.kt", "app/InstrumentedTest/C.kt", "x/test_d.py", "x/Latest.kt", "testing.md", "src/MyJUnit.txt", "a/UnitTest/x.md", "main/E.kt", "lib/fixture/F.kt", "m/src/androidTest/G.java")
PATH_FLAGS = {  # as is_test_file, the same by the build's signs, is_instrumented, is_test_name and the patch words have them
    "by_config": (1, 1, 0, 0, 1, 0, 0, 1, 0, 0, 1), "by_build": (1, 0, 1, 0, 1, 0, 0, 0, 0, 0, 1), "instrumented": (0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1),
    "by_name": (1, 0, 1, 1, 1, 1, 1, 1, 0, 0, 1), "by_patch": (1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1),
}


@query("SELECT p_partkey, " + ", ".join(f"list_extract({list(v)}, (p_partkey % {len(PATHS)} + 1)::INTEGER) = 1 AS {k}" for k, v in PATH_FLAGS.items()) + " FROM part")
def test_path_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = word_of(PATHS, F.col("p_partkey"))
    return load(spark, sf_dir, "part").select(
        "p_partkey", extract.is_test_file(path).alias("by_config"), extract.is_test_file(path, markers.TEST_FILE_SIGNS_BUILD).alias("by_build"),
        extract.is_instrumented(path).alias("instrumented"), extract.is_test_name(path).alias("by_name"), extract.is_test_file(path, markers.PATCH_TEST_WORDS).alias("by_patch"),
    )


RUN_WORDS, PATCH_WORDS = tuple(w for w, _ in markers.RUN_ERRORS), tuple(w for w, _ in markers.PATCH_ERRORS)


@query(f"""SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'Other Error' ELSE list_extract({listed(tuple(c for _, c in markers.RUN_ERRORS))}, (event_id % 9 + 1)::INTEGER) END AS run_error,
  CASE WHEN event_id % 6 = 5 THEN 'Other error' ELSE list_extract({listed(tuple(c for _, c in markers.PATCH_ERRORS))}, (event_id % 5 + 1)::INTEGER) END AS patch_error, event_type AS head FROM events""")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    run = F.concat(F.lit("Failed: "), F.when(key % 10 == 9, "unknown").otherwise(F.upper(word_of(RUN_WORDS, key))))
    patch = F.concat(F.lit("git: "), F.when(key % 6 == 5, "unknown").otherwise(F.initcap(word_of(PATCH_WORDS, key))))
    head = F.when(key % 2 == 0, F.concat("event_type", F.lit(": more: words"))).otherwise(F.col("event_type"))
    return load(spark, sf_dir, "events").select(
        "event_id", extract.error_category(run, list(markers.RUN_ERRORS), "Other Error").alias("run_error"),
        extract.error_category(patch, list(markers.PATCH_ERRORS), "Other error").alias("patch_error"), extract.error_head(head).alias("head"),
    )


@query("""WITH f AS (SELECT 'C' || p_size AS name, ':m' || (p_partkey % 7) AS module FROM part WHERE p_partkey % 3 <> 0)
  SELECT 'org.x.C' || k AS class_name, coalesce((SELECT string_agg(DISTINCT module, ',' ORDER BY module) FROM f WHERE f.name = 'C' || k AND module IN (':m1', ':m2', ':m3')), '') AS modules FROM range(1, 60) r(k)""")
def class_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    root = word_of(extract.TEST_ROOTS, key)
    path = F.concat(F.lit("m"), (key % 7).cast("string"), F.lit("/"), F.when(key % 3 == 0, "src/main/java").otherwise(root), F.when(key % 2 == 0, "/deep/er").otherwise(""), F.lit("/C"), F.col("p_size").cast("string"), F.lit(".kt"))
    classes = spark.range(1, 60).select(F.concat(F.lit("org.x.C"), F.col("id").cast("string")).alias("class_name"))
    modules = spark.createDataFrame([(":m1",), (":m2",), (":m3",)], "module string")
    found = extract.classes_in_modules(classes, load(spark, sf_dir, "part").select(path.alias("path")), modules)
    return found.select("class_name", F.array_join("modules", ",").alias("modules"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS both FROM orders")
def both_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    return load(spark, sf_dir, "orders").select("o_orderkey", predicates.both_applied(test, F.col("o_orderkey") % 2 == 0).alias("both"))


@query("""SELECT event_id, event_type = 'view' OR user_id % 3 > 0 AS ran, event_type IN ('view', 'click') AS said, event_type IN ('view', 'click') OR (event_type <> 'error' AND user_id % 2 = 0) AS built FROM events""")
def success_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    log = F.when(kind.isin("view", "click"), "x\nBUILD SUCCESSFUL in 3s").when(kind == "error", "BUILD FAILED").otherwise("quiet")
    return load(spark, sf_dir, "events").select(
        "event_id", predicates.run_succeeded(F.when(kind != "click", kind == "view"), user % 3).alias("ran"), predicates.build_succeeded(log).alias("said"),
        predicates.build_succeeded(log, user % 2).alias("built"),
    )


@query("SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_returnflag").alias("status")))).alias("tests"))
    kept = F.transform(predicates.with_status(F.col("tests"), "R"), lambda t: t["l_linenumber"].cast("string"))
    return held.select("l_orderkey", F.nullif(F.array_join(kept, ","), F.lit("")).alias("returned"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'https://x/' || s_name ELSE 'https://github.com/' || s_name || '.git' END AS url FROM supplier")
def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("https://x/"), "s_name")).otherwise(F.col("s_name"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", predicates.repository_url(repo).alias("url"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) THEN 'special' ELSE 'general' END AS kind, count(*) FILTER (o_orderstatus = 'P') > 0 AS runs FROM orders GROUP BY 1""")
def project_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("paths"), F.collect_list(F.when(F.col("o_orderstatus") == "P", "t")).alias("tests"))
    patch = F.when(F.size("tests") > 0, "diff --git a/x b/x").otherwise("diff --git a/main/x b/main/x")
    return held.select("o_custkey", predicates.project_kind(F.col("paths"), ("URGENT", "HIGH"), "special", "general").alias("kind"), predicates.runs_tests(patch, F.col("tests")).alias("runs"))


@query("SELECT p_partkey, contains(p_name, 'ring') OR contains(p_name, 'bolt') OR contains(p_name, 'gear') AS any_word FROM part")
def any_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", joins.any_word(F.col("p_name"), ("ring", "bolt", "gear")).alias("any_word"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY 1")
def first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_value(load(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "first_type")


@query("(SELECT 'ten' AS part, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL SELECT 'all', o_orderkey FROM orders")
def limit_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, order = load(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")]
    return sorting.limited(orders, order, 10).select(F.lit("ten").alias("part"), "o_orderkey").unionByName(sorting.limited(orders, order, 0).select(F.lit("all").alias("part"), "o_orderkey"))


@query("SELECT c_custkey AS key, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return setops.union_all(customers, suppliers)


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY n) AS roles FROM (SELECT conv_id, role, min(n) AS n FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) GROUP BY 1, 2) GROUP BY 1""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return held.select("conv_id", F.array_join(setops.ordered_distinct(F.transform("t", lambda t: t["role"])), ",").alias("roles"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'tagged ' || event_id WHEN 'click' THEN 'fenced ' || event_id || chr(10) WHEN 'error' THEN 'other ' || event_id || chr(10) ELSE 'before ' || event_id END AS patch FROM events""")
def tagged_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    answer = (
        F.when(kind == "view", F.concat(F.lit("say <patch>tagged "), number, F.lit("</patch> ```diff\nno\n```"))).when(kind == "click", F.concat(F.lit("```kotlin\nno\n```\n```diff\nfenced "), number, F.lit("\n```")))
        .when(kind == "error", F.concat(F.lit("```kotlin\nother "), number, F.lit("\n```"))).otherwise(F.concat(F.lit("before "), number, F.lit("</s>after")))
    )
    return load(spark, sf_dir, "events").select("event_id", extract.tagged_patch(answer).alias("patch"))


@query("SELECT user_id, string_agg('src/F' || event_id || '.kt', ',' ORDER BY event_id) AS files FROM events WHERE event_type <> 'signup' GROUP BY 1")
def oracle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/F"), F.col("event_id").cast("string"), F.lit(".kt"))
    old = F.when(F.col("event_type") == "signup", "--- /dev/null").otherwise(F.concat(F.lit("--- a/"), path))
    part = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"), old, F.lit("\n+++ b/"), path, F.lit("\n"))
    patches = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", part.alias("p")))), lambda x: x["p"]), "").alias("patch"))
    return patches.select("user_id", F.array_join(extract.source_files(F.col("patch")), ",").alias("files")).where("files <> ''")


@query("SELECT p_partkey, ':m' || p_size AS module, 'Debug' AS variant, 'org.C' || p_partkey AS class_name, ':m' || p_size || ':testDebugUnitTest --tests org.C' || p_partkey AS task FROM part")
def test_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = extract.test_task(F.concat(F.lit(":m"), F.col("p_size").cast("string")), F.lit("Debug"), F.concat(F.lit("org.C"), F.col("p_partkey").cast("string")))
    return load(spark, sf_dir, "part").select("p_partkey", task.alias("task")).select("p_partkey", "task", extract.parse_test_task(F.col("task")).alias("t")).select("p_partkey", "task", "t.*")


@query("SELECT p_partkey, ':app,:m' || p_size AS projects, '8.' || p_size AS gradle, CASE WHEN p_size > 25 THEN 'n' || p_size END AS ndk FROM part")
def project_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    listing = F.concat(F.lit("Root project 'x'\n+--- Project ':app' - y\n\\--- Project ':m"), size, F.lit("'\n+--- Project ':app'"))
    ndk = F.when(F.col("p_size") > 25, F.concat(F.lit('ndkVersion "n'), size, F.lit('"'))).otherwise("")
    env = extract.environment(extract.build_config(F.concat(F.lit("x/gradle-8."), size, F.lit("-bin")), ndk))
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(extract.project_names(listing), ",").alias("projects"), F.try_element_at(env, F.lit("GRADLE_VERSION")).alias("gradle"), F.try_element_at(env, F.lit("NDK_VERSION")).alias("ndk")
    )


@query("SELECT p_partkey, '  fun f' || p_size || '() {' || chr(10) || '    one' || chr(10) || chr(10) || '    two' AS block FROM part")
def indented_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("class A {\n  val x = 1\n  fun f"), F.col("p_size").cast("string"), F.lit("() {\n    one\n\n    two\n  }\n  fun g() {}\n}"))
    return load(spark, sf_dir, "part").select("p_partkey", extract.indented_block(text, r"^\s*fun ").alias("block"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'R-' || c_custkey WHEN c_custkey % 3 = 1 THEN 'Q-' || c_custkey END AS instance_id FROM customer WHERE c_custkey % 3 < 2")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    rows = load(spark, sf_dir, "customer")
    known = rows.select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "R-").otherwise("Q-"), key).alias("instance_id"))
    ids = rows.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("R-"), key)).when(F.col("c_custkey") % 3 == 1, key).otherwise("none").alias("listed"))
    return extract.candidate_ids(ids, known.select("instance_id")).join(known, "instance_id").select("c_custkey", "instance_id")


@query("SELECT n_regionkey, count(*) AS pulls, min(n_nationkey) AS first FROM nation GROUP BY 1")
def pull_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of pull requests counted by repository."""
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("pulls"), F.min("n_nationkey").alias("first"))


VARIANT_CASES = (  # instance, module, what is available, tasks, pick
    ("k9__x-1", ":app-k9mail", "testFullDebugUnitTest,testFossDebugUnitTest", "testFossDebugUnitTest,testFullDebugUnitTest,testFossReleaseUnitTest,testFullReleaseUnitTest", "testFossDebugUnitTest"),
    ("Thunderbird__t-2", ":backend:imap", "test,testDebugUnitTest", "test", "test"), ("AntennaPod__a-3", ":model", "testReleaseUnitTest", "testDebugUnitTest,testReleaseUnitTest", "testDebugUnitTest"),
    ("AntennaPod__a-4", ":app", "testPlayDebugUnitTest,detektFreeDebugUnitTest", "testFreeDebugUnitTest,testPlayDebugUnitTest", "testPlayDebugUnitTest"), ("x-5", ":feature:login", "testDebugUnitTest", "testDebugUnitTest,testReleaseUnitTest", "testDebugUnitTest"),
    ("Tusky-6", ":app", "testGreenDebugUnitTest,testBlueDebugUnitTest,testFullDebugUnitTest", "testBlueDebugUnitTest,testGreenDebugUnitTest,testBlueReleaseUnitTest,testGreenReleaseUnitTest", "testBlueDebugUnitTest"),
    ("NeoStumbler-7", ":lib", "lint", "testFullDebugUnitTest", "testDebugUnitTest"), ("y-8", ":lib", "detektXDebugUnitTest,detektFossDebugUnitTest", "testDebugUnitTest", "detektFossDebugUnitTest"),
    ("z-9", ":WordPress", "testJetpackDebugUnitTest,testWordpressVanillaDebugUnitTest", "testWordpressVanillaDebugUnitTest", "testWordpressVanillaDebugUnitTest"),
)


def case_of(column: int) -> str:
    return f"list_extract({listed(tuple(c[column] for c in VARIANT_CASES))}, (p_partkey % {len(VARIANT_CASES)} + 1)::INTEGER)"


@query(f"SELECT p_partkey, {case_of(3)} AS tasks, {case_of(4)} AS pick FROM part")
def variant_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    instance, module, available = (word_of(tuple(c[i] for c in VARIANT_CASES), F.col("p_partkey")) for i in range(3))
    tasks, pick = extract.variant_tasks(instance, module), extract.variant_pick(instance, module, F.split(available, ","))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(tasks, ",").alias("tasks"), pick.alias("pick"))


@query("""SELECT p_partkey, 'field:count:int count:1;method:run' || p_size || ':public void run' || p_size || '(int a):3;constant:MAX:KEY_MAX:2' AS elements FROM part""")
def class_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    source = F.concat(
        F.lit("public class C"), key, F.lit(" {\n  private int count = 0; // note\n  public static final int MAX = 3;\n  public void run"), size,
        F.lit("(int a) {\n    private int local = 1;\n    if (a) {\n    }\n  }\n  int unseen;\n}\nclass D {}"),
    )
    found = load(spark, sf_dir, "part").select("p_partkey", parsers.class_elements_udf(source).alias("e"))
    shown = F.transform("e", lambda e: F.concat_ws(":", e["kind"], e["name"], e["signature"], e["first"].cast("string")))
    return found.select("p_partkey", F.array_join(shown, ";").alias("elements"))


@query("""SELECT p_partkey, 'val id: Long|var m: Map<String, List<Int>>|val x' || p_size || ': Int' AS params,
  'data class A(' || chr(10) || '  val id: Long,' || chr(10) || '  val name: String' || ',' || chr(10) || '    var m: Map<String, List<Int>>,' || chr(10) || '    val x' || p_size || ': Int,' || chr(10) || ')' || ' { }' AS merged FROM part""")
def data_class_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stub = F.concat(F.lit("data class A(val id: Long, var m: Map<String, List<Int>>, val x"), F.col("p_size").cast("string"), F.lit(": Int)"))
    existing = F.lit("data class A(\n  val id: Long,\n  val name: String) { }")
    merged = extract.merge_data_class(existing, stub)
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.data_class_params(stub), "|").alias("params"), merged.alias("merged"))
