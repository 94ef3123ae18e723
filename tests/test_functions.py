import pytest
from pyspark.sql import functions as F
from strandline.functions import extract, parsers, scalars


def value(spark, f, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]


PATCH = """diff --git a/app/src/main/java/org/x/A.java b/app/src/main/java/org/x/A.java
--- a/app/src/main/java/org/x/A.java
+++ b/app/src/main/java/org/x/A.java
@@ -1,9 +1,9 @@
 class A {
+    public int size(int a) {
+    }
-    old
@@ -20,1 +20,1 @@
-gone
diff --git a/app/src/test/java/org/x/ATest.java b/app/src/test/java/org/x/ATest.java
--- /dev/null
+++ b/app/src/test/java/org/x/ATest.java
@@ -0,0 +1,1 @@
+new
"""


@pytest.mark.parametrize("answer,want", [
    ("text\n```diff\n--- a\n+++ b\n```\n", "--- a\n+++ b"), ("diff --git a/x b/x\n+1\n", "diff --git a/x b/x\n+1"), ("prose only", ""), (None, ""),
    ("```\n+a\n```\nand\n```diff\n+b\n```", "+a"),
])
def test_fenced_patch(spark, answer, want):
    assert value(spark, extract.fenced_patch, answer) == want


def test_tagged_patch_order(spark):
    assert value(spark, extract.tagged_patch, "<patch>\nA</patch> ```diff\nB\n```") == "\nA"
    assert value(spark, extract.tagged_patch, "```java\nJ\n``` ```diff\nB\n```") == "B\n"
    assert value(spark, extract.tagged_patch, "text</s>rest") == "text"


def test_patch_parts(spark):
    assert value(spark, extract.changed_files, PATCH) == ["app/src/main/java/org/x/A.java", "app/src/test/java/org/x/ATest.java"]
    assert value(spark, extract.source_files, PATCH) == ["app/src/main/java/org/x/A.java"]
    assert value(spark, extract.new_files, PATCH) == ["app/src/test/java/org/x/ATest.java"]
    s = value(spark, extract.split_patch, PATCH)
    assert s["test"].startswith("diff --git a/app/src/test") and s["fix"] + s["test"] == PATCH


def test_repair_is_idempotent_and_counts_lines(spark):
    df = spark.createDataFrame([(1, PATCH)], "id int, patch string")
    out = extract.repair_headers(df, "patch", ["id"]).orderBy("file_no", "hunk_no").collect()
    assert [r["header"] for r in out] == ["@@ -1,2 +1,3 @@", "@@ -20,1 +21,0 @@", "@@ -0,0 +0,1 @@"]


def test_methods(spark):
    df = spark.createDataFrame([(1, PATCH)], "id int, patch string")
    assert [(r["path"][-6:], r["method"]) for r in extract.modified_methods(df, "patch", ["id"]).collect()] == [("A.java", "size")]


@pytest.mark.parametrize("text,want", [
    ("Fixes #1, closes #2 and see #3", ["1", "2"]), ("<!-- fixes #9 --> resolved #4", ["4"]), (None, []), ("FIXED #5 fixes #5", ["5"]), ("prefix #6", []),
])
def test_issue_refs(spark, text, want):
    assert value(spark, extract.issue_refs, text) == want


def test_paths(spark):
    p = "features/login/src/main/kotlin/org/x/javascript/B.kt"
    assert value(spark, extract.path_to_module, p) == ":features:login" and value(spark, extract.path_to_module, "a/b.kt") == ""
    assert value(spark, extract.path_to_class, p) == "org.x.javascript.B"
    assert value(spark, extract.is_test_path, "app/src/androidTest/C.kt") is True and value(spark, extract.is_test_path, "app/src/main/Latest.md") is False
    assert value(spark, extract.is_test_path, "x/FooTest.kt") is True
    t = value(spark, lambda c: extract.parse_test_task(extract.test_task(F.lit(":app"), F.lit("Debug"), c)), "org.x.ATest")
    assert (t["module"], t["variant"], t["class_name"]) == (":app", "Debug", "org.x.ATest")


def test_ids(spark):
    df = spark.createDataFrame([("12",), ("o__r-3",)], "listed string")
    prefixes = [("alpha", "o__alpha"), ("beta", "o__beta")]
    assert sorted(r[0] for r in extract.normal_ids(df, prefixes, "data/Beta.jsonl").collect()) == ["o__beta-12", "o__r-3"]
    assert extract.normal_ids(df, prefixes).count() == 3
    assert value(spark, extract.trailing_number, "o__r-77") == 77 and value(spark, extract.trailing_number, "none") is None


def test_console_counts_a_timed_test_once(spark):
    df = spark.createDataFrame([(1, "a.B > one PASSED\na.B > two words FAILED (1.5 s)\nnoise\na.B > three SKIPPED\n")], "id int, log string")
    found = [(r["test_name"], r["status"], r["duration"]) for r in extract.console_tests(df, "log", ["id"]).collect()]
    assert found == [("one", "PASSED", 0.0), ("two words", "FAILED", 1.5), ("three", "SKIPPED", 0.0)]


def test_reports(spark):
    df = spark.createDataFrame([(1, "Suite: S\n - a - PASSED\n - b - FAILED\nSuite: T\n - c - PASSED")], "id int, r string")
    assert [(r["identity"], r["status"]) for r in extract.report_suites(df, "r", ["id"]).collect()] == [("S::a", "PASSED"), ("S::b", "FAILED"), ("T::c", "PASSED")]
    log = "=== XML FILE: a.xml ===\n<x/>\n=== END\n=== XML FILE: a.xml ===\n<y/>\n=== END"
    assert [(s["file"], s["body"]) for s in value(spark, extract.log_sections, log)] == [("a.xml", "<x/>")]
    lines = value(spark, extract.report_lines, "- t (a.B) - PASSED\n- u (a.C) - ERROR")
    assert [(x["name"], x["class_name"], x["status"]) for x in lines] == [("t", "a.B", "PASSED"), ("u", "a.C", "ERROR")]
    assert value(spark, extract.flat_report, "====\nA, b\nSummary: 3\nc") == "A; b\tc"


def test_junit_self_closing_case_does_not_inherit_a_failure(spark):
    xml = '<testsuite><testcase name="a" classname="C"/><testcase name="b" classname="C"><failure>f</failure></testcase><testcase name="c" classname="C"><skipped>s</skipped></testcase></testsuite>'
    assert [(t["test_name"], t["status"]) for t in value(spark, extract.junit_embedded, xml)] == [("a", "PASSED"), ("b", "FAILED"), ("c", "SKIPPED")]


def test_build_config_clamps_what_is_stated_only(spark):
    props = "distributionUrl=https://x/gradle-8.4-bin.zip\norg.gradle.jvmargs=-Xmx4g\n"
    c = value(spark, extract.build_config, props, "com.android.tools.build:gradle:7.1\ncompileSdk = 35\nndkVersion '25'")
    assert tuple(c) == ("8.4", "11", 34, "-Xmx4g", "25")
    assert tuple(value(spark, extract.build_config, "", "")) == ("8.0", "17", 35, "-Xmx2g", None)
    assert value(spark, lambda a, b: extract.environment(extract.build_config(a, b)), "", "")["COMPILE_SDK"] == "35"


def test_settings(spark):
    assert value(spark, extract.included_modules, "include ':app', ':lib'\n// include ':no'\ninclude(\":x:y\")") == [":app", ":lib", ":x:y"]
    assert value(spark, extract.project_names, "+--- Project ':app'\n\\--- Project ':lib:a'") == [":app", ":lib:a"]
    assert value(spark, extract.module_type, "id 'com.android.library'") == "library"
    assert value(spark, extract.key_values, "A_B=1\nnoise\nC=x=y")["A_B"] == "1"


def test_failure_stage(spark):
    s = value(spark, extract.failure_stage, "Failed to apply test patch: x")
    assert (s["repo_cloned"], s["container_created"], s["test_patch_applied"], s["prediction_patch_applied"]) == (True, True, False, False)


def test_generated_files_last_wins(spark):
    got = value(spark, extract.generated_files, "FILE: a.kt\n```kotlin\none\n```\nMODIFY: b.kt\n```\ntwo\n```\nFILE: a.kt\n```kotlin\nthree\n```")
    assert got["a.kt"]["content"] == "three\n" and got["b.kt"]["kind"] == "MODIFY" and len(got) == 2


def test_prompt_sorts_files(spark):
    df = spark.createDataFrame([("s", {"b": "2", "a": "1\nx"})], "s string, f map<string,string>")
    text = df.select(extract.prompt(F.col("s"), F.col("f"), with_numbers=True)).first()[0]
    assert text.index("[start of a]\n1 1\n2 x\n[end of a]") < text.index("[start of b]")


def test_patch_state_machine():
    text = "prose\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\nstray\n c\none\ntwo\nthree\n+not part"
    got = parsers.patch_by_state(text)
    assert got.endswith("-a\n+b\nstray\n c") and "prose" not in got and "not part" not in got
    assert parsers.patch_by_state(None) == ""


def test_relevant_log_keeps_lines_behind_a_file_error():
    log = ["> Task :a", "e: file:///A.kt:3:5 Unresolved", "  detail", "", "Daemon #3 is", "  more", "> Task :b", "fine", "x1", "x2", "symbol: z", "BUILD FAILED"]
    assert parsers.relevant_log("\n".join(log), least=0).split("\n") == ["e: file:///A.kt:3:5 Unresolved", "detail", "more", "> Task :b", "fine", "x1", "symbol: z", "BUILD FAILED"]
    twice = ["e: file:///A.kt:3:5 a", "one", "e: file:///B.kt:4:5 b", "two"]
    assert parsers.relevant_log("\n".join(twice), least=0).split("\n") == ["e: file:///A.kt:3:5 a", "one", "e: file:///B.kt:4:5 b", "e: file:///B.kt:4:5 b", "two"]
    summary = ["* FAILURE: Build failed with", "", "Using Java: 17", "* Try:", "no"]
    assert parsers.relevant_log("\n".join(summary), least=0).split("\n") == ["* FAILURE: Build failed with", "Using Java: 17", "* Try:"]
    assert parsers.relevant_log("short") == "\n\nshort" and parsers.relevant_log(None) == "\n\n"
    long = "BUILD FAILED " + "y" * 600
    assert parsers.relevant_log(long + "\nrest") == long


@pytest.mark.parametrize("name,utility", [("MockSmtpServer", True), ("LoginTest.kt", False), ("a/b/TestUtils.java", True), ("IThing", True), ("Item", False), ("ITest", True), ("BaseCase", True), ("x/ParserTest.java", True), ("AccountTest", False)])
def test_utility_names(spark, name, utility):
    assert value(spark, extract.is_utility, name) is (utility if name != "x/ParserTest.java" else True)


def test_test_methods(spark):
    sources = ["@Test fun a()", "fun testIt(", "void test", "describe( it(", "should(", "fun `does it`()", "class A {}", None]
    assert [value(spark, lambda c: extract.has_test_methods(c.cast("string")), x) for x in sources] == [True, True, False, True, False, True, False, True]


def test_test_paths(spark):
    paths = ["app/src/test/A.kt", "app/src/commonTest/B.kt", "app/InstrumentedTest/C.kt", "x/test_d.py", "x/Latest.kt", "testing.md", "src/MyJUnit.txt", "a/UnitTest/x.md", "main/E.kt"]
    by = {f: [value(spark, lambda c: f(c), p) for p in paths] for f in (extract.is_test_file, extract.is_test_name, extract.is_instrumented)}
    assert by[extract.is_test_file] == [True, True, False, False, True, False, False, True, False]
    assert by[extract.is_test_name] == [True, False, True, True, True, True, True, True, False]
    assert by[extract.is_instrumented] == [False, False, True, False, False, False, False, False, False]


def test_classes_in_modules(spark):
    files = [("app/src/test/java/org/x/ATest.java",), ("lib/core/src/androidTest/kotlin/ATest.kt",), ("src/test/java/BTest.java",), ("other/src/test/java/q/ATest.java",), ("app/src/main/java/CTest.java",)]
    df = spark.createDataFrame(files, "path string")
    classes = spark.createDataFrame([("org.x.ATest",), ("BTest",), ("org.CTest",)], "class_name string")
    modules = spark.createDataFrame([(":app",), (":lib:core",), (":",)], "module string")
    found = {r["class_name"]: r["modules"] for r in extract.classes_in_modules(classes, df, modules).collect()}
    assert found == {"org.x.ATest": [":app", ":lib:core"], "BTest": [":"], "org.CTest": []}


def test_indented_block(spark):
    text = "class A {\n  fun a() {\n    one\n\n    two\n  }\n  fun b() {}\n}"
    assert value(spark, lambda c: extract.indented_block(c, "fun a"), text) == "  fun a() {\n    one\n\n    two"
    assert value(spark, lambda c: extract.indented_block(c, "^class"), text) == text[:-2]
    assert value(spark, lambda c: extract.indented_block(c, "absent"), text) is None


def test_best_patch(spark):
    assert value(spark, parsers.best_patch, "a ```diff\ndiff --git a/x b/x\n+1\n``` b") == "diff --git a/x b/x\n+1\n"
    assert value(spark, parsers.best_patch, "say\ndiff --git a/x b/x\n@@ -1 +1 @@\n+1\nbye\nbye\nbye") == "diff --git a/x b/x\n@@ -1 +1 @@\n+1\n"
    assert value(spark, parsers.best_patch, None) == ""


def test_scalars(spark):
    assert value(spark, scalars.to_bool, " YES ") is True and value(spark, scalars.to_bool, "0") is False and value(spark, scalars.to_bool, "maybe") is None
    assert value(spark, scalars.to_int, "12x") == 0 and value(spark, scalars.to_int, "12") == 12
    assert value(spark, scalars.stem, "a/b.c/Foo.kt") == "Foo" and value(spark, scalars.capitalised, "debug x") == "Debug x"
    assert value(spark, lambda c: scalars.json_default(c, "$.a.b", 7, "int"), '{"a": {"b": "x"}}') == 7


def test_class_elements():
    source = "package a;\npublic class A {\n  private int[] xs;\n  public static final int MAX = 3;\n  // private int no = 1;\n  public void run(int a) {\n    private int local = 1;\n  }\n  public A(int b) {\n  }\n  int unseen;\n}\nclass B {\n  private int other;\n}"
    got = [(e["kind"], e["name"], e["signature"], e["first"], e["last"]) for e in parsers.class_elements(source)]
    assert got == [("field", "xs", "int[] xs", 2, 2), ("method", "run", "public void run(int a)", 5, 7), ("constant", "MAX", "KEY_MAX", 3, 3)]
    assert parsers.class_elements(None) == [] and parsers.class_bounds("data class P(\n  val a: Int,\n)\nx".split("\n")) == (0, 2)
    assert parsers.class_bounds("class P {\n  x".split("\n")) == (0, 1)


def test_data_class(spark):
    existing = "package p\n\ndata class A(val id: Long,\n  val f: (Int) -> Unit = {}"
    assert value(spark, extract.data_class_params, "data class A ( val a: Map<String, List<Int>> , var b: Int, )") == ["val a: Map<String, List<Int>>", "var b: Int"]
    merged = value(spark, extract.merge_data_class, "x\ndata class A(\n  val id: Long,\n) { y }", "data class A(val id: Int, val more: Int)")
    assert merged == "x\ndata class A(\n  val id: Long,\n\n    val more: Int,\n) { y }"
    assert value(spark, lambda a, b: extract.merge_data_class(a, b, whole=False), "x\ndata class A() { y }", "data class A(val n: Int)") == "data class A(\n    val n: Int,\n)"
    assert value(spark, extract.merge_data_class, existing, "class B") == existing
