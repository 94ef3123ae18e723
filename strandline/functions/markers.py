"""Words, markers and patterns that classifiers compare with. They must stay as they are for the right results."""

from __future__ import annotations

#: A build's output that has one of these, in lower case, has compilation errors.
COMPILE_ERRORS = (
    "cannot find symbol", "package does not exist", "class not found", "method not found", "variable not found", "compilation failed",
    "could not compile", "error: cannot access", "error: package", "error: class", "error: method", "error: variable",
    "unresolved reference", "unresolved import", "undefined symbol", "no suitable method found", "incompatible types",
    "method does not override", "abstract method", "missing return statement",
)

#: Signs in a test run's output that it didn't get to its tests, and that it did.
RUN_FAILED = (
    "compilation failed", "could not compile", "cannot find symbol", "package does not exist", "BUILD FAILED", "build failed",
    "compilation error", "Execution failed for task",
)
RUN_EXECUTED = (
    "test results", "tests completed", "BUILD SUCCESSFUL", "TEST-*.xml", "test summary", "tests ran", "> Task :test", "XML RESULT:",
    "test execution summary",
)

#: What names of classes begin or end with that aren't tests themselves, and known names of such.
UTILITY_WORDS = (
    "Mock", "Fake", "Stub", "Dummy", "Helper", "Util", "Utils", "Factory", "Builder", "Fixture", "Base", "Abstract", "Support", "Common",
    "Shared", "TestData", "Constants", "Config", "Setup", "Harness", "Framework", "Rule", "Extension", "Listener", "Runner", "Suite",
    "Category", "Tag", "Matcher", "Assertion", "Verifier", "Provider", "Generator", "Creator", "Server", "Client", "Service", "Repository",
    "Database", "Schema", "Migration", "Container", "Context", "Environment", "Interceptor", "Adapter", "Wrapper", "Proxy", "Handler",
    "Processor", "Validator", "Converter", "Transformer", "Serializer", "Deserializer", "Parser", "Formatter", "Calculator", "Engine",
    "Manager", "Controller", "Component",
)
UTILITY_NAMES = (
    "MockPop3Server", "MockSmtpServer", "MockImapServer", "TestUtils", "TestHelper", "TestBase", "BaseTestCase", "AbstractTestCase",
    "TestConstants", "TestData", "TestConfig",
)

#: Signs of tests in a class's source, of which two are enough, and patterns of which one is.
TEST_METHOD_SIGNS = (
    "@Test", "@ParameterizedTest", "@RepeatedTest", "@TestMethodOrder", "@TestInstance", "fun test", "fun `", "void test",
    "public void test", "testSuite(", "describe(", "it(", "should(", "when(", "given(", "then(",
)
TEST_METHOD_PATTERNS = (r"fun test\w+\(", r"fun `.*`\(", r"void test\w+\(", r"public void test\w+\(")

#: Signs of a test file in its path, in lower case: parts of paths and names, as two tools have them.
TEST_FILE_SIGNS = ("/test/", "/androidtest/", "/commontest/", "/unittest/", "test.java", "test.kt", "tests.java", "tests.kt")
TEST_FILE_SIGNS_BUILD = ("/test/", "/androidtest/", "/instrumentedtest/", "test.java", "test.kt", "tests.java", "tests.kt")
INSTRUMENTED_SIGNS = ("/androidtest/", "/instrumentedtest/", "androidtest.java", "androidtest.kt")

#: Folders, words, names and libraries that make a path a test's, in lower case.
TEST_FOLDERS = ("/test/", "/androidtest/", "/instrumentedtest/", "/src/test/", "/src/androidtest/", "/src/instrumentedtest/")
TEST_WORDS = ("test", "tests", "testing", "androidtest", "instrumentedtest", "espresso", "unittest", "integrationtest", "uitest")
TEST_NAMES = (
    r".*test\.java$", r".*test\.kt$", r".*tests\.java$", r".*tests\.kt$", r"test.*\.java$", r"test.*\.kt$", r".*spec\.java$",
    r".*spec\.kt$", r".*testcase\.java$", r".*testcase\.kt$",
)
TEST_LIBRARIES = ("instrumentation", "espresso", "androidjunit", "robolectric", "mockito", "junit")

#: Parts of a path, in lower case, for which a patch's file counts as a test's.
PATCH_TEST_WORDS = (
    "test", "tests", "androidTest", "androidtest", "unitTest", "unittest", "integrationTest", "integrationtest", "src/test",
    "src/androidTest", "src/testDebug", "src/testRelease", "testing", "testutils", "testUtil", "test-utils", "testdata", "test-data",
    "testassets", "test-assets", "espresso", "robolectric", "mockito", "junit", "uitest", "ui-test", "e2e", "e2etest", "functional",
    "functionaltest", "smoke", "smoketest", "regression", "regressiontest", "mock", "stub", "fake", "testdouble", "fixture", "testfixture",
)

#: Categories of errors by the first words found, in order.
RUN_ERRORS = (
    ("clone", "Repository Clone Error"), ("repository", "Repository Clone Error"), ("docker", "Container Error"),
    ("container", "Container Error"), ("patch", "Patch Application Error"), ("build", "Build Error"), ("gradle", "Build Error"),
    ("test", "Test Execution Error"), ("timeout", "Timeout Error"),
)
PATCH_ERRORS = (
    ("corrupt patch", "Corrupt patch format"), ("patch does not apply", "Context mismatch"), ("no such file", "Missing file"),
    ("patch fragment without header", "Missing patch header"), ("empty patch content", "No patch extracted"),
)

#: Patterns of a build log's lines that tell of errors, that place them in files, and that are never of interest.
LOG_ERRORS = (
    r"error: cannot find symbol", r"error: package .+ does not exist", r"error: .+ cannot be resolved", r"error: The method .+ is undefined",
    r"Compilation failed", r"BUILD FAILED", r"Execution failed for task", r"Too many arguments", r"Argument type mismatch:",
    r"No value passed for parameter", r"No parameter with name", r"overrides nothing", r"constructor.*: .* cannot be applied to",
    r"method.*cannot be applied to", r"incompatible types", r"cannot find symbol.*parameter", r"cannot find symbol.*method",
    r"cannot find symbol.*variable", r"Unresolved reference",
)
LOG_FILE_ERRORS = (r"^/.+\.java:\d+: error:", r"^/.+\.kt:\d+: error:", r"e: file:///.+\.kt:\d+:\d+", r"w: file:///.+\.kt:\d+:\d+")
LOG_NOISE = (
    r"Caching disabled", r"Task .+ is not up-to-date", r"No history is available", r"Simple merging task", r"AAPT2 aapt2.*shutdown",
    r"Resolve mutations for", r".*\.gradle/caches/", r"AndroidManifest\.xml", r"transformed/.*\.xml", r"at org\.gradle\.", r"Daemon #\d+",
    r"Working directory:", r"Using Java:",
)

#: Which test tasks modules have, by a part of the instance's id and a pattern of the module, in order, and which of them is wanted.
VARIANT_RULES = (
    ("", r"^:app-thunderbird$|^:app-k9mail$", ("testFossDebugUnitTest", "testFullDebugUnitTest", "testFossReleaseUnitTest", "testFullReleaseUnitTest"), "testFossDebugUnitTest"),
    ("", r"^:AnkiDroid$", ("testPlayDebugUnitTest",), "testPlayDebugUnitTest"),
    ("", r"^:WordPress$", ("testWordpressVanillaDebugUnitTest",), "testWordpressVanillaDebugUnitTest"),
    ("thunderbird", r"^:mail:protocols:(?:imap|smtp)$|^:feature:autodiscovery:(?:service|autoconfig)$|^:app:html-cleaner$|^:backend:imap$", ("test",), "test"),
    (
        "antennapod",
        r"^:(?:model|event|storage:preferences|playback:base)$|^:ui:(?:episodes|common|app-start-intent|i18n|notifications)$|^:parser:(?:feed|media|transcript)$|^:net:sync:(?:service-interface|gpoddernet)$",
        ("testDebugUnitTest", "testReleaseUnitTest"), "testDebugUnitTest",
    ),
    ("antennapod", "", ("testFreeDebugUnitTest", "testPlayDebugUnitTest"), "testFreeDebugUnitTest"),
    ("", r"^:feature:|^:legacy:core$", ("testDebugUnitTest", "testReleaseUnitTest"), "testDebugUnitTest"),
    ("tusky", "", ("testBlueDebugUnitTest", "testGreenDebugUnitTest", "testBlueReleaseUnitTest", "testGreenReleaseUnitTest"), "test"),
    ("neostumbler", "", ("testFullDebugUnitTest",), "testFullDebugUnitTest"),
)
VARIANT_DEFAULT = "testDebugUnitTest"

#: How a class begins, with its body's brace or, the last ones, with its parameters, and how its members do. Lines are trimmed.
CLASS_BODIES = tuple(rf"^(?:(?:public|private|protected|internal)\s+)?{k}\s+\w+.*\{{" for k in ("class", "interface", r"data\s+class", "object", r"abstract\s+class"))
CLASS_PARAMETERS = tuple(rf"^(?:(?:public|private|protected|internal)\s+)?{k}\s+\w+\s*\(" for k in (r"data\s+class", "class"))
FIELD = r"^(?:private|protected|public)?\s+\w+(?:\[\])?\s+(\w+)\s*[=;]"
METHOD = r"^(?:private|protected|public)?\s+(?:static\s+)?(?:\w+\s+)*(\w+)\s*\("
CONSTANT = r"^public\s+static\s+final\s+\w+\s+(\w+)\s*="
