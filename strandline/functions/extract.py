"""Structure out of text, as columns of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions import markers

#: Words that close an issue, marks of test paths, and words of a method's syntax that are no method.
CLOSING = ("close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved")
TEST_PATHS = ("/test/", "/tests/", "/androidtest/", "/e2e/", "/testing/", "/testfixtures/", "/sharedtest/")
NOT_METHODS = ("if", "for", "while", "switch", "catch", "return", "new")
SOURCE_ROOTS = r"^.*?src/[^/]+/(?:java|kotlin)/"
NONE = "cast(array() as array<string>)"


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# --- patches in answers


def fenced_patch(answer: Column) -> Column:
    """The first fenced block, plain or of a diff; else the whole text if it begins as a patch; else empty. Trimmed."""
    text = F.coalesce(answer, F.lit(""))
    fence = F.regexp_extract(text, r"(?s)```(?:diff)?[ \t]*\n(.*?)```", 1)
    bare = F.trim(text)
    return F.when(fence != "", F.btrim(fence, F.lit(" \n\t\r"))).when(bare.startswith("diff --git") | bare.startswith("---"), F.btrim(text, F.lit(" \n\t\r"))).otherwise("")


def tagged_patch(answer: Column) -> Column:
    """Text between paired tags; else the first fence that is labelled diff or patch; else another fence; else the text before an end mark."""
    tag = _empty_to_null(F.regexp_extract(answer, r"(?s)<([a-z_]*(?:diff|patch)[a-z_]*)>(.*?)</\1>", 2))
    labelled = _empty_to_null(F.regexp_extract(answer, r"(?s)```(?:diff|patch)[ \t]*\n(.*?)```", 1))
    other = _empty_to_null(F.regexp_extract(answer, r"(?s)```\w*[ \t]*\n(.*?)```", 1))
    return F.coalesce(tag, labelled, other, F.substring_index(answer, "</s>", 1))


def diff_lines(text: Column) -> Column:
    """The lines that look like a diff's."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^(?:diff --git |index |--- |\+\+\+ |@@ |[-+ ])")), "\n")


def clean_patch(patch: Column) -> Column:
    """Without blank lines around it, with one line end; empty if it has neither a header nor a changed line."""
    body = F.btrim(patch, F.lit("\n\r"))
    good = body.rlike(r"(?m)^(?:diff --git |--- |\+\+\+ |@@ |[-+])")
    return F.when(F.coalesce(good, F.lit(False)), F.concat(body, F.lit("\n"))).otherwise("")


# --- patches


def patch_files(patch: Column) -> Column:
    """The parts of a patch, one for each file, in order."""
    return F.filter(F.split(patch, r"(?m)(?=^diff --git )"), lambda p: p.startswith("diff --git "))


def part_path(part: Column) -> Column:
    """The path of a file's part, behind b/."""
    return F.regexp_extract(part, r"(?m)^diff --git a/\S+ b/(\S+)", 1)


def changed_files(patch: Column) -> Column:
    """Paths behind "+++ b/" and in "diff --git" headers, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/(\S+)"), 1), F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), 1)))


def source_files(patch: Column) -> Column:
    """Paths behind "--- a/"."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^--- a/(\S+)"), 1))


def new_files(patch: Column) -> Column:
    """Paths whose old side is /dev/null."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^--- /dev/null\n\+\+\+ b/(\S+)"), 1))


def is_test_path(path: Column) -> Column:
    """By folder, or by a file name such as FooTest.kt or test_foo.py."""
    low = F.lower(F.concat(F.lit("/"), path))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in TEST_PATHS]) | low.rlike(r"/(?:test_[^/]*|[^/]*(?:tests?|spec)\.(?:java|kt|py|groovy))$")


def is_instrumented(path: Column) -> Column:
    return is_test_file(path, markers.INSTRUMENTED_SIGNS)


def split_patch(patch: Column) -> Column:
    """struct(test, fix): the parts for test files and the others, each joined in order."""
    parts = patch_files(patch)
    tests = F.array_join(F.filter(parts, lambda p: is_test_path(part_path(p))), "")
    fixes = F.array_join(F.filter(parts, lambda p: ~is_test_path(part_path(p))), "")
    return F.struct(tests.alias("test"), fixes.alias("fix"))


def hunks(df: DataFrame, patch: str, keep: list[str]) -> DataFrame:
    """A row for each hunk: path, file_no, hunk_no, old_start, old_lines, added, removed, context, as counted from its lines."""
    files = df.select(*keep, F.posexplode(patch_files(F.col(patch))).alias("file_no", "part_"))
    parts = F.split("part_", r"(?m)(?=^@@ )")
    each = files.select(*keep, "file_no", part_path(F.col("part_")).alias("path"), F.posexplode(F.slice(parts, 2, 1 << 20)).alias("hunk_no", "hunk_"))
    lines = F.filter(F.slice(F.split("hunk_", "\n"), 2, 1 << 20), lambda x: x != "")
    def number(i: int) -> Column:
        return F.regexp_extract("hunk_", r"^@@ -(\d+)(?:,\d+)? \+(\d+)", i).try_cast("long")

    return each.select(
        *keep, "path", "file_no", "hunk_no", number(1).alias("old_start"), number(2).alias("new_start"),
        F.size(F.filter(lines, lambda x: x.startswith("+"))).alias("added"), F.size(F.filter(lines, lambda x: x.startswith("-"))).alias("removed"),
        F.size(F.filter(lines, lambda x: x.startswith(" "))).alias("context"), F.array_join(lines, "\n").alias("body"),
    )


def repair_headers(df: DataFrame, patch: str, keep: list[str]) -> DataFrame:
    """hunks() with headers derived anew: line counts from the lines, the new start from the lines added before it."""
    from strandline.operators.windows import running_offset

    each = hunks(df, patch, keep)
    moved = running_offset(each, [*keep, "file_no"], [F.col("hunk_no")], F.col("added") - F.col("removed"), "moved")
    old, new = F.col("context") + F.col("removed"), F.col("context") + F.col("added")
    header = F.format_string("@@ -%d,%d +%d,%d @@", F.col("old_start"), old.cast("long"), (F.col("old_start") + F.col("moved")).cast("long"), new.cast("long"))
    return moved.withColumn("header", header).drop("moved")


def simplified_patch(patch: Column) -> Column:
    """Without context lines, and hunk headers cut to "@@"."""
    lines = F.filter(F.split(patch, "\n"), lambda x: ~x.startswith(" "))
    return F.array_join(F.transform(lines, lambda x: F.when(x.startswith("@@"), "@@").otherwise(x)), "\n")


def added_methods(part: Column) -> Column:
    """Names of methods in a file's added lines, by the file's language, each once."""
    added = F.array_join(F.filter(F.split(part, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++")), "\n")
    path = part_path(part)
    kotlin = F.regexp_extract_all(added, F.lit(r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\("), 1)
    java = F.regexp_extract_all(added, F.lit(r"(?m)^\+\s*(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\("), 1)
    python = F.regexp_extract_all(added, F.lit(r"(?m)^\+\s*(?:async\s+)?def\s+(\w+)\s*\("), 1)
    found = F.when(path.endswith(".kt"), kotlin).when(path.endswith(".java"), java).when(path.endswith(".py"), python).otherwise(F.expr(NONE))
    return F.array_distinct(F.filter(found, lambda m: ~m.isin(*NOT_METHODS)))


def modified_methods(df: DataFrame, patch: str, keep: list[str]) -> DataFrame:
    parts = df.select(*keep, F.explode(patch_files(F.col(patch))).alias("part_"))
    return parts.select(*keep, part_path(F.col("part_")).alias("path"), F.explode(added_methods(F.col("part_"))).alias("method"))


def inferred_tests(classes: Column, methods: Column) -> Column:
    """Each class with each method; bare methods without classes."""
    pairs = F.flatten(F.transform(classes, lambda c: F.transform(methods, lambda m: F.concat(c, F.lit("."), m))))
    return F.when(F.size(classes) > 0, pairs).otherwise(methods)


def diff_size(before: Column, after: Column) -> Column:
    """struct(lines, chars): by how much a file has grown."""
    return F.struct((F.size(F.split(after, "\n")) - F.size(F.split(before, "\n"))).alias("lines"), (F.length(after) - F.length(before)).alias("chars"))


# --- issues and paths


def issue_refs(text: Column) -> Column:
    """Numbers behind "#" that follow a closing word, outside HTML comments, each once."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", "")
    pairs = F.regexp_extract_all(plain, F.lit(r"([A-Za-z]+) #(?:[0-9]+)"), 1)
    numbers = F.regexp_extract_all(plain, F.lit(r"(?:[A-Za-z]+) #([0-9]+)"), 1)
    kept = F.filter(F.arrays_zip(pairs.alias("w"), numbers.alias("n")), lambda p: F.lower(p["w"]).isin(*CLOSING))
    return F.array_distinct(F.transform(kept, lambda p: p["n"]))


def path_to_module(path: Column) -> Column:
    """Folders before the first src as :a:b; empty without a src."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "src").cast("int")
    return F.when(at > 1, F.concat(F.lit(":"), F.array_join(F.slice(parts, F.lit(1), at - 1), ":"))).otherwise("")


def path_to_class(path: Column) -> Column:
    """The path below its source root with dots, without the ending .java or .kt."""
    below = F.regexp_replace(path, SOURCE_ROOTS, "")
    return F.replace(F.regexp_replace(below, r"\.(?:java|kt)$", ""), F.lit("/"), F.lit("."))


def class_of_file(name: Column) -> Column:
    """A file's name without its folders, .java and .kt."""
    return F.replace(F.replace(F.substring_index(name, "/", -1), F.lit(".java"), F.lit("")), F.lit(".kt"), F.lit(""))


def is_utility(name: Column, words: tuple[str, ...] = markers.UTILITY_WORDS, known: tuple[str, ...] = markers.UTILITY_NAMES) -> Column:
    """Whether a class or its file isn't a test itself: its name begins or ends with one of the words, is known, or is an interface's such as IThing."""
    own = class_of_file(name)
    return reduce(lambda a, b: a | b, [own.startswith(w) | own.endswith(w) for w in words]) | own.isin(*known) | own.rlike(r"^I\p{Lu}")


def has_test_methods(source: Column) -> Column:
    """Whether a class's source has tests: @Test, two signs, or a test's name. A source that isn't there is taken to have some."""
    signs = sum((F.contains(source, F.lit(w)).cast("int") for w in markers.TEST_METHOD_SIGNS), F.lit(0))
    return F.coalesce((signs >= 2) | F.contains(source, F.lit("@Test")) | source.rlike("|".join(markers.TEST_METHOD_PATTERNS)), F.lit(True))


def is_test_class(path: Column, source: Column) -> Column:
    return ~is_utility(path) & has_test_methods(source)


def is_test_file(path: Column, signs: tuple[str, ...] = markers.TEST_FILE_SIGNS) -> Column:
    """By parts of the path in lower case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(path), F.lit(w)) for w in signs])


def is_test_name(path: Column) -> Column:
    """By folder, by a word between separators, by the name's pattern, or by a test library's name."""
    low = F.lower(path)
    parts = [F.contains(low, F.lit(w)) for w in (*markers.TEST_FOLDERS, *markers.TEST_LIBRARIES)]
    words = F.arrays_overlap(F.split(low, r"[ _/.]"), F.array(*[F.lit(w) for w in markers.TEST_WORDS]))
    return reduce(lambda a, b: a | b, parts) | words | low.rlike("|".join(f"^(?:{p})" for p in markers.TEST_NAMES))


def test_task(module: Column, variant: Column, class_name: Column) -> Column:
    return F.concat(module, F.lit(":test"), variant, F.lit("UnitTest --tests "), class_name)


def parse_test_task(task: Column) -> Column:
    """struct(module, variant, class_name) of what test_task() makes."""
    pattern = r"^(.*):test(\w*)UnitTest --tests (\S+)$"
    return F.struct(*[F.regexp_extract(task, pattern, i + 1).alias(n) for i, n in enumerate(("module", "variant", "class_name"))])


def trailing_number(instance_id: Column) -> Column:
    """The number behind the last "-", or null."""
    return F.substring_index(instance_id, "-", -1).try_cast("long")


def normal_ids(ids: DataFrame, prefixes: list[tuple[str, str]], context: str | None = None, name: str = "listed") -> DataFrame:
    """Bare numbers become ids: with the prefix whose name is in the context, else with every prefix. Other ids stay."""
    fitting = [p for app, p in prefixes if context and app.lower() in context.lower()] or [p for _, p in prefixes]
    numbers = F.array(*[F.concat(F.lit(p), F.lit("-"), F.col(name)) for p in fitting])
    return ids.select(F.explode(F.when(F.col(name).rlike("^[0-9]+$"), numbers).otherwise(F.array(name))).alias(name)).distinct()


def modules_of_targets(targets: Column) -> Column:
    """Text before each target's first colon; targets that begin with one have none."""
    return F.filter(F.transform(targets, lambda t: F.substring_index(t, ":", 1)), lambda m: m != "")


# --- logs and reports


def console_tests(df: DataFrame, log: str, keep: list[str]) -> DataFrame:
    """A row for each "Class > test STATUS", with or without seconds: pos, class_name, test_name, status, duration."""
    pattern = r"(?m)^\s*([\w.$]+) > (.+?) (PASSED|FAILED|SKIPPED)(?: \(([0-9.]+) ?s\))?\s*$"
    def group(i: int) -> Column:
        return F.regexp_extract_all(F.col(log), F.lit(pattern), i)

    zipped = F.arrays_zip(group(1).alias("class_name"), group(2).alias("test_name"), group(3).alias("status"), group(4).alias("seconds"))
    rows = df.select(*keep, F.posexplode(zipped).alias("pos", "t"))
    return rows.select(*keep, "pos", "t.class_name", "t.test_name", "t.status", F.coalesce(F.col("t.seconds").try_cast("double"), F.lit(0.0)).alias("duration"))


def report_suites(df: DataFrame, report: str, keep: list[str]) -> DataFrame:
    """A row for each case of a suite report, "Suite: name" above "- test - STATUS" lines: suite, test_name, status, identity class::test."""
    suites = F.filter(F.split(report, r"(?m)(?=^Suite: )"), lambda s: s.startswith("Suite: "))
    each = df.select(*keep, F.posexplode(suites).alias("suite_no", "s_")).withColumn("suite", F.regexp_extract("s_", r"(?m)^Suite: (.*)$", 1))
    def group(i: int) -> Column:
        return F.regexp_extract_all(F.col("s_"), F.lit(r"(?m)^\s*- (.+?) - (PASSED|FAILED|SKIPPED|ERROR)\s*$"), i)

    cases = each.select(*keep, "suite_no", "suite", F.explode(F.arrays_zip(group(1).alias("name"), group(2).alias("status"))).alias("c"))
    return cases.select(*keep, "suite_no", "suite", F.col("c.name").alias("test_name"), F.col("c.status").alias("status"), F.concat_ws("::", "suite", F.col("c.name")).alias("identity"))


def report_lines(report: Column) -> Column:
    """Array of struct(name, class_name, status) from "- name (class) - STATUS" lines."""
    pattern = F.lit(r"(?m)^\s*- (.+?) \(([^)]*)\) - (PASSED|FAILED|SKIPPED|ERROR)\s*$")
    return F.arrays_zip(*[F.regexp_extract_all(report, pattern, i + 1).alias(n) for i, n in enumerate(("name", "class_name", "status"))])


def log_sections(log: Column) -> Column:
    """Array of struct(file, body) between "=== XML FILE: name ===" and "=== END", the first of a file's."""
    pattern = F.lit(r"(?s)=== XML FILE: (.*?) ===\n(.*?)\n?=== END")
    pairs = F.arrays_zip(F.regexp_extract_all(log, pattern, 1).alias("file"), F.regexp_extract_all(log, pattern, 2).alias("body"))
    names = F.regexp_extract_all(log, pattern, 1)
    return F.filter(pairs, lambda p, i: F.array_position(names, p["file"]) == i + 1)


def junit_embedded(xml: Column) -> Column:
    """Cases of JUnit XML in a text column, as an array of struct(class_name, test_name, status)."""
    schema = "testcase array<struct<_name: string, _classname: string, failure: string, error: string, skipped: string>>"
    cases = F.from_xml(xml, schema)["testcase"]
    return F.transform(
        F.coalesce(cases, F.expr("cast(array() as array<struct<_name: string, _classname: string, failure: string, error: string, skipped: string>>)")),
        lambda c: F.struct(
            c["_classname"].alias("class_name"), c["_name"].alias("test_name"),
            F.when(c["failure"].isNotNull(), "FAILED").when(c["error"].isNotNull(), "ERROR").when(c["skipped"].isNotNull(), "SKIPPED").otherwise("PASSED").alias("status"),
        ),
    )


def flat_report(text: Column) -> Column:
    """Without banner and summary lines, commas as semicolons, lines joined by tabs."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^(?:=+|Summary.*|Total.*)$"))
    return F.array_join(F.transform(lines, lambda x: F.replace(x, F.lit(","), F.lit(";"))), "\t")


def key_values(text: Column) -> Column:
    """A map of KEY=value lines."""
    return F.str_to_map(F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike("^[A-Z_]+=")), "\n"), F.lit("\n"), F.lit("="))


def error_category(error: Column, chain: list[tuple[str, str]], other: str = "other") -> Column:
    """The first category of the chain whose keyword is in the error, in lower case."""
    out = None
    for word, category in chain:
        hit = F.contains(F.lower(error), F.lit(word))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(other)


def error_head(error: Column) -> Column:
    return F.substring_index(error, ":", 1)


def failure_stage(output: Column) -> Column:
    """struct of flags that hold up to the stage at which a run's output says that it failed."""
    text = F.lower(F.coalesce(output, F.lit("")))
    stages = ["repo_cloned", "config_parsed", "container_created", "test_patch_applied", "prediction_patch_applied"]
    marks = ["failed to clone", "failed to parse", "failed to create container", "failed to apply test patch", "failed to apply prediction patch"]
    at = F.lit(len(stages))
    for i in range(len(stages) - 1, -1, -1):
        at = F.when(F.contains(text, F.lit(marks[i])), i).otherwise(at)
    return F.struct(*[(at > i).alias(s) for i, s in enumerate(stages)])


def project_names(listing: Column) -> Column:
    """Quoted names of a build's project listing."""
    return F.array_distinct(F.regexp_extract_all(listing, F.lit(r"Project '(:[^']+)'"), 1))


def included_modules(settings: Column) -> Column:
    """Modules of include statements, with one or several names."""
    lines = F.filter(F.split(settings, "\n"), lambda x: x.rlike(r"^\s*include\b"))
    return F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit("[\"'](:[^\"']+)[\"']"), 1))))


def module_type(build: Column) -> Column:
    return (
        F.when(F.contains(build, F.lit("com.android.application")), "application").when(F.contains(build, F.lit("com.android.library")), "library")
        .when(build.rlike("kotlin|java-library|'java'"), "jvm").otherwise("unknown")
    )


def build_config(properties: Column, gradle: Column, default_sdk: int = 35, lowest: int = 21, highest: int = 34) -> Column:
    """struct of what a build's files state, with defaults; a stated SDK is clamped to those supported, the default isn't."""
    version = _empty_to_null(F.regexp_extract(properties, r"gradle-([0-9.]+)-", 1))
    plugin = _empty_to_null(F.regexp_extract(gradle, r"com\.android\.tools\.build:gradle:([0-9]+)", 1)).try_cast("int")
    java = F.when(plugin >= 8, "17").when(plugin >= 7, "11").when(plugin.isNotNull(), "8").otherwise("17")
    stated = _empty_to_null(F.regexp_extract(gradle, r"compileSdk(?:Version)?\s*=?\s*([0-9]+)", 1)).try_cast("int")
    sdk = F.coalesce(F.greatest(F.lit(lowest), F.least(stated, F.lit(highest))), F.lit(default_sdk))
    sdk = F.when(stated.isNull(), F.lit(default_sdk)).otherwise(sdk)
    args = _empty_to_null(F.regexp_extract(properties, r"(?m)^org\.gradle\.jvmargs=(.*)$", 1))
    ndk = _empty_to_null(F.regexp_extract(gradle, "ndkVersion\\s*=?\\s*[\"']([^\"']+)", 1))
    return F.struct(F.coalesce(version, F.lit("8.0")).alias("gradle"), java.alias("java"), sdk.alias("sdk"), F.coalesce(args, F.lit("-Xmx2g")).alias("jvm_args"), ndk.alias("ndk"))


def environment(config: Column) -> Column:
    """The configuration as variables; the NDK's only if it has one."""
    base = F.create_map(F.lit("GRADLE_VERSION"), config["gradle"], F.lit("JAVA_VERSION"), config["java"], F.lit("COMPILE_SDK"), config["sdk"].cast("string"))
    return F.when(config["ndk"].isNotNull(), F.map_concat(base, F.create_map(F.lit("NDK_VERSION"), config["ndk"]))).otherwise(base)


def preferred_variants(variants: Column) -> Column:
    """Debug variants if there are any, else all."""
    debug = F.filter(variants, lambda v: F.contains(F.lower(v), F.lit("debug")))
    return F.when(F.size(debug) > 0, debug).otherwise(variants)


def generated_files(answer: Column) -> Column:
    """A map from path to content of "FILE: path" and "MODIFY: path" headings with a fenced block each."""
    def group(i: int) -> Column:
        return F.regexp_extract_all(answer, F.lit(r"(?s)(FILE|MODIFY): (\S+)\s*\n```\w*\n(.*?)```"), i)

    entries = F.zip_with(group(2), F.arrays_zip(group(1).alias("kind"), group(3).alias("content")), lambda p, v: F.struct(p.alias("key"), v.alias("value")))
    last = F.filter(entries, lambda e, i: F.array_position(F.reverse(F.transform(entries, lambda x: x["key"])), e["key"]) == F.size(entries) - i)
    return F.map_from_entries(last)


# --- prompts and scores


def numbered(text: Column) -> Column:
    """Lines with their numbers, from 1."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x)), "\n")


def file_section(path: Column, text: Column) -> Column:
    return F.concat(F.lit("[start of "), path, F.lit("]\n"), text, F.lit("\n[end of "), path, F.lit("]"))


def prompt(statement: Column, files: Column, with_numbers: bool = False) -> Column:
    """The statement and the files of a map in the order of their paths, each between marks."""
    sections = F.transform(F.array_sort(F.map_entries(files)), lambda e: file_section(e["key"], numbered(e["value"]) if with_numbers else e["value"]))
    return F.concat_ws("\n", F.lit("<issue>"), statement, F.lit("</issue>"), F.lit("<code>"), F.array_join(sections, "\n"), F.lit("</code>"))


def relevance(path: Column, issue: Column, weights: list[tuple[str, float]], keywords: tuple[str, ...]) -> Column:
    """The heaviest pattern's weight, doubled if the file's stem is in the issue, and half more if a keyword is in both."""
    from strandline.functions.scalars import stem
    from strandline.operators.joins import heaviest_pattern, shared_word

    named = F.when(F.contains(F.lower(issue), F.lower(stem(path))), 2.0).otherwise(1.0)
    shared = F.when(shared_word(F.lower(issue), F.lower(path), keywords), 1.5).otherwise(1.0)
    return heaviest_pattern(path, weights) * named * shared


def prompt_brief(statement: Column) -> Column:
    """The statement alone."""
    return F.concat_ws("\n", F.lit("<issue>"), statement, F.lit("</issue>"))


def prompt_with_example(statement: Column, files: Column, example: str) -> Column:
    """prompt() with an example of an answer behind it."""
    return F.concat_ws("\n", prompt(statement, files), F.lit("<patch>"), F.lit(example), F.lit("</patch>"))


def prompt_edits_only(statement: Column, path: Column, text: Column, start: Column, length: Column, before: int = 15) -> Column:
    """The statement and of one file the lines around a change."""
    from strandline.operators.windows import lines_around

    return F.concat_ws("\n", prompt_brief(statement), file_section(path, F.array_join(lines_around(text, start, length, before), "\n")))


def candidate_ids(ids: DataFrame, known: DataFrame, name: str = "listed", key: str = "instance_id") -> DataFrame:
    """Known ids that a listed text names: equal, or the listed one's trailing number is theirs."""
    by_number = known.select(key, trailing_number(F.col(key)).alias("number_"))
    exact = ids.join(known, F.col(name) == F.col(key)).select(key)
    numbered = ids.select(trailing_number(F.col(name)).alias("number_")).where("number_ is not null").join(by_number, "number_").select(key)
    return exact.unionByName(numbered).distinct()


#: Folders of a module below which its tests are.
TEST_ROOTS = ("src/test/java", "src/test/kotlin", "src/androidTest/java", "src/androidTest/kotlin", "src/main/test")


def classes_in_modules(classes: DataFrame, files: DataFrame, modules: DataFrame, name: str = "class_name", path: str = "path", module: str = "module") -> DataFrame:
    """Each class with the modules that have a file of its simple name below a test folder: equi-joins on that name and on the module's folder."""
    root = "|".join(TEST_ROOTS)
    pattern = rf"^(?:(.*?)/)?(?:{root})/(?:.*/)?([^/]+)\.(?:java|kt)$"
    listed = files.where(F.col(path).rlike(pattern)).select(F.regexp_extract(path, pattern, 2).alias("simple_"), F.regexp_extract(path, pattern, 1).alias("folder_")).distinct()
    known = modules.select(module, F.replace(F.regexp_replace(module, "^:", ""), F.lit(":"), F.lit("/")).alias("folder_")).distinct()
    simple = F.element_at(F.split(name, r"\."), -1)
    found = classes.select(name, simple.alias("simple_")).distinct().join(listed.join(known, "folder_"), "simple_", "left")
    return found.groupBy(name).agg(F.array_sort(F.collect_set(module)).alias("modules"))


def indented_block(text: Column, start: str) -> Column:
    """The first line that matches `start`, and those behind it that are blank or more indented; null if there is none."""
    lines = F.split(text, "\n")
    begin = F.array_position(F.transform(lines, lambda x: x.rlike(start)), True)

    def indent(x: Column) -> Column:
        return F.length(F.regexp_extract(x, r"^\s*", 0))

    own = F.slice(lines, begin.cast("int"), F.size(lines))
    rest = F.slice(own, 2, F.size(lines))
    ends = F.transform(rest, lambda x: (F.trim(x) != "") & (indent(x) <= indent(F.element_at(own, 1))))
    last = F.array_position(ends, True).cast("int")
    return F.when(begin > 0, F.array_join(F.when(last > 0, F.slice(own, 1, last)).otherwise(own), "\n"))


def split_binary(patch: Column) -> Column:
    """struct(text, binary): a patch's parts for text files and those for binary ones, each joined in order."""
    parts = patch_files(patch)
    mark = r"(?m)^(?:GIT binary patch|Binary files .* differ)$"
    text, binary = F.filter(parts, lambda p: ~p.rlike(mark)), F.filter(parts, lambda p: p.rlike(mark))
    return F.struct(F.array_join(text, "").alias("text"), F.array_join(binary, "").alias("binary"))


def _rule(instance_id: Column, module: Column, value: Callable[[tuple], Column], default: Column) -> Column:
    """The value of the first variant rule that fits."""
    out = None
    for part, pattern, tasks, wanted in markers.VARIANT_RULES:
        fits = F.contains(F.lower(instance_id), F.lit(part)) & module.rlike(pattern)
        out = F.when(fits, value((tasks, wanted))) if out is None else out.when(fits, value((tasks, wanted)))
    return out.otherwise(default)


def variant_tasks(instance_id: Column, module: Column) -> Column:
    """The test tasks that a module has by the rules."""
    return _rule(instance_id, module, lambda r: F.array(*[F.lit(t) for t in r[0]]), F.array(F.lit(markers.VARIANT_DEFAULT)))


def variant_pick(instance_id: Column, module: Column, available: Column) -> Column:
    """The task that the rules want if it is available; else of debug unit tests the best, those that begin as tests first; else the default."""
    wanted = _rule(instance_id, module, lambda r: F.lit(r[1]), F.lit(markers.VARIANT_DEFAULT))
    debug = F.filter(available, lambda v: F.contains(F.lower(v), F.lit("unittest")) & F.contains(F.lower(v), F.lit("debug")))
    plain = F.filter(debug, lambda v: F.lower(v).startswith("test") & ~F.contains(F.lower(v), F.lit("detekt")))

    def place(v: Column) -> Column:
        low = F.lower(v)
        has = [F.contains(low, F.lit(w)) for w in ("wordpressvanilla", "foss", "free", "full")]
        rank = F.when(has[0], 0).when(has[1], 1).when(has[2], 2).when(~has[3], 3).otherwise(4)  # all are debug variants
        return F.struct(rank.alias("rank"), F.length(v).alias("length"), v.alias("v"))

    best = [F.array_min(F.transform(x, place))["v"] for x in (plain, debug)]
    return F.coalesce(F.when(F.array_contains(available, wanted), wanted), *best, F.lit(markers.VARIANT_DEFAULT))


def data_class_params(source: Column) -> Column:
    """The constructor's parameters of the first data class, trimmed; commas inside angle brackets or parentheses don't part them."""
    inside = F.regexp_extract(source, r"(?s)data class \w+\s*\((.*?)\)", 1)
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("marked"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c.isin("(", "<"), 1).when(c.isin(")", ">"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.concat(acc["marked"], F.when((c == ",") & (acc["depth"] == 0), "\0").otherwise(c)).alias("marked"))

    marked = F.aggregate(F.filter(F.split(inside, ""), lambda c: c != ""), zero, step, lambda a: a["marked"])
    return F.filter(F.transform(F.split(marked, "\0"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def _param_name(param: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.substring_index(param, ":", 1), r"^\s+|\s+$", ""), "val |var ", "")


def merge_data_class(existing: Column, stub: Column, whole: bool = True) -> Column:
    """existing with the stub's data class parameters whose names it hasn't, put behind its own; if not whole, only the changed declaration."""
    own = F.transform(data_class_params(existing), _param_name)
    new = F.filter(data_class_params(stub), lambda p: ~F.array_contains(own, _param_name(p)))
    pattern = r"(?s)^(.*?)(data class \w+\s*\([^)]*)(\).*)$"
    before, head, behind = (F.regexp_extract(existing, pattern, i) for i in (1, 2, 3))
    bare = F.regexp_replace(head, r"\s+$", "")
    lead = F.when(bare.endswith("(") | bare.endswith(","), "\n    ").otherwise(",\n    ")
    grown = F.concat(head, lead, F.array_join(new, ",\n    "), F.lit(",\n"))
    out = F.concat(before, grown, behind) if whole else F.concat(grown, F.lit(")"))
    return F.when((F.size(new) == 0) | (head == ""), existing).otherwise(out)
