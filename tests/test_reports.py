"""Parsers on hand-written outputs; the round trips of plans cover the rest."""

import json
import time

from pyspark.sql import functions as F

from runlens.operators import console as C
from runlens.operators import diagnostics as D
from runlens.operators import reports as R


def runs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "run_id long, text string")


def test_junit_shapes(spark):
    bare = '<testsuite time="1.5"><testcase classname="c" name="a"/><testcase classname="c" name="b"><error message="">E   ValueError: x</error></testcase><testcase/></testsuite>'
    nested = '<testsuites><testsuite time="2"><testsuite time="1"><testcase name="a" classname="k"><skipped/></testcase></testsuite></testsuite></testsuites>'
    got = {r.run_id: r for r in R.junit(runs(spark, bare, nested, "<testsuites/>", "not xml", None)).collect()}
    assert set(got) == {0, 1}
    assert (got[0].total, got[0].passed, got[0].failed, got[0].duration_s) == (2, 1, 1, 1.5)
    assert [(f.id, f.msg) for f in got[0].failures] == [("c.b", "ValueError: x")]
    assert (got[1].skipped, got[1].duration_s) == (1, 3.0)
    assert R.junit(runs(spark, nested), "phpunit").first().duration_s == 2.0


def test_traces(spark):
    text = 'Traceback (most recent call last):\n  File "/x/site-packages/a.py", line 1\n    lib()\n  File "me.py", line 2\n    mine()\n    ^^^^\nE   ValueError: x\n'
    one = spark.createDataFrame([(text,)], "raw string").select(R.trim_trace(F.col("raw")).alias("t"), R.budget_trace(R.trim_trace(F.col("raw")), 2).alias("b")).first()
    assert one.t == ['File "me.py", line 2', "mine()", "E   ValueError: x"]
    assert one.b == ["… +2 lines omitted (see raw_log)", "E   ValueError: x"]


def test_go_build_failure(spark):
    text = (
        '{"ImportPath":"p [p.test]","Action":"build-output","Output":"./a.go:3:1: undefined: x\\n"}\n{"Action":"start","Package":"p"}\n'
        '{"Action":"output","Package":"p","Output":"FAIL\\tp [build failed]\\n"}\n{"Action":"fail","Package":"p","Elapsed":0.5,"FailedBuild":"p [p.test]"}\n'
    )
    r = R.parse_reports(runs(spark, text), "go-test").first()
    assert (r.total, r.failed, r.duration_s) == (1, 1, 0.5)
    assert (r.failures[0].id, r.failures[0].loc, r.failures[0].msg) == ("p", "", "./a.go:3:1: undefined: x")


def test_jest_suite_failure(spark):
    text = '{"numTotalTests":0,"numPassedTests":0,"numFailedTests":0,"numPendingTests":0,"numTodoTests":1,"numRuntimeErrorTestSuites":2,"success":false,"startTime":0,"testResults":[{"name":"a.js","endTime":5,"status":"failed","message":"● t\\n\\nSyntaxError: x","assertionResults":[]}]}'
    r = R.jest(runs(spark, text)).first()
    assert (r.failed, r.skipped) == (2, 1)
    assert [(f.id, f.msg) for f in r.failures] == [("a.js", "SyntaxError: x"), ("(suites)", "1 test suite(s) failed to run (see raw_log)")]


def test_text_parsers(spark):
    assert R.parse_unittest("nothing") is None
    nextest = "        FAIL [   0.1s] crate::t a::b\n--- STDERR: crate::t a::b ---\nthread 'a::b' panicked at src/l.rs:4:5:\nboom\n------\nSummary [   1.2s] 3 tests run: 2 passed, 1 failed, 1 skipped\n"
    r = R.parse_cargo_test(nextest)
    assert (r["total"], r["failed"], r["skipped"]) == (4, 1, 1) and r["failures"][0]["loc"] == "src/l.rs:4:5"
    R.register_parser("count", lambda t: R._report("count", len(t), len(t), 0, 0, 0.0, []))
    assert R.parse_reports(runs(spark, "abc"), "count").first().total == 3


def test_merge_and_items(spark):
    got = R.junit(runs(spark, '<testsuite><testcase name="a" classname="c"><failure message="m"/></testcase></testsuite>'))
    twice = got.unionByName(got.withColumn("run_id", F.lit(7).cast("long"))).withColumn("g", F.lit(1))
    whole = R.merge(twice, ["g"], "run_id").first()
    assert whole.total == 2 and len(whole.failures) == 2
    assert [(r.id, r.msg) for r in R.items(got).collect()] == [("c.a", "m")]


def test_malformed_json_gives_no_rows(spark):
    bad = runs(spark, "[{]", "", None, "warming up\n[]")
    for parse in (D.ruff, D.eslint, D.swiftlint, D.mypy, D.golangci, D.cargo):
        assert parse(bad).count() == 0
    assert sorted(r.run_id for r in D.malformed(bad).collect()) == [0, 1, 2]
    severe = runs(spark, '[{"file":"a","line":1,"character":2,"reason":"r","rule_id":"x","severity":"Odd"}]', '[{"file":"b","line":1,"character":2,"reason":"r","rule_id":"x","severity":"Error"}]')
    assert [r.run_id for r in D.swiftlint(severe).collect()] == [1] and [r.run_id for r in D.unknown_severities(severe).collect()] == [0]


def test_rendering(spark):
    from runlens.operators import render

    text = '<testsuite time="1.5"><testcase classname="c" name="a"/><testcase classname="c" name="b"><failure message="m, n">x: y</failure></testcase></testsuite>'
    got = render.render_reports(R.junit(runs(spark, text))).first().text
    assert got == 'runner: pytest\nsummary:\n total: 2\n passed: 1\n failed: 1\n skipped: 0\n duration_s: 1.5\nfailures[1]{id,loc,msg}:\n c.b,"","m, n"\ntraces:\n c.b[1]:\n  - "x: y"'
    found = D.clang(runs(spark, "a.c:1:2: error: bad\n", "fine\n"))
    out = {r.run_id: r.text for r in render.render_diagnostics(found, D.summarise(found, runs(spark, "a", "b"), "clang")).collect()}
    assert out[1] == "runner: clang\nsummary:\n errors: 0\n warnings: 0"
    assert out[0].endswith('diagnostics[1]{loc,severity,rule,msg}:\n "a.c:1:2",error,"",bad')


def test_fill_from_log(spark):
    from runlens.operators import render

    failures = spark.createDataFrame([(1, "App.Suite.test", "", ""), (1, "Other.t", "k.c:1", "own")], "run_id long, id string, loc string, msg string")
    log = spark.createDataFrame([(1, 5, "Suite/test", "a.swift:9", "late"), (1, 2, "Suite.test", "a.swift:7", "no")], "run_id long, pos long, id string, loc string, msg string")
    assert sorted((r.id, r.loc, r.msg) for r in render.fill_from_log(failures, log).collect()) == [("App.Suite.test", "a.swift:7", "no"), ("Other.t", "k.c:1", "own")]


def test_go_panic(spark):
    said = ["panic: boom [recovered]", "", "goroutine 6 [running]:", "testing.tRunner.func1()", "\t/usr/lib/go/src/testing/testing.go:1 +0x1", "x/p.TestA(0x1)", "\t/home/u/p/a_test.go:9 +0x2c", "created by testing", "\t/usr/lib/go/src/testing/testing.go:2 +0x1"]
    events = [{"Action": "run", "Package": "x/p", "Test": "TestA"}, *({"Action": "output", "Package": "x/p", "Test": "TestA", "Output": l + "\n"} for l in said), {"Action": "fail", "Package": "x/p", "Test": "TestA"}, {"Action": "fail", "Package": "x/p", "Elapsed": 0.1}]
    r = R.parse_reports(runs(spark, "\n".join(map(json.dumps, events))), "go-test").first()
    f = r.failures[0]
    assert (r.failed, f.id, f.loc, f.msg) == (1, "p.TestA", "a_test.go:9", "panic: boom")
    assert f.trace == ["panic: boom [recovered]", "goroutine 6 [running]:", "x/p.TestA(0x1)", "/home/u/p/a_test.go:9 +0x2c"]


def test_jvm_frames(spark):
    trace = "java.lang.IllegalStateException: boom\n\tat app//demo.AppTest.fails(AppTest.java:21)\n\tat app//demo.Lib.call(Lib.java:4)\n\tat java.base/java.lang.reflect.Method.invoke(Method.java:58)\n"
    text = f'<testsuite><testcase classname="demo.AppTest" name="fails"><failure message="boom">{trace}</failure></testcase></testsuite>'
    f = R.junit(runs(spark, text), "maven").first().failures[0]
    assert (f.loc, f.msg, f.trace) == ("AppTest.java:21", "java.lang.IllegalStateException: boom", ["at app//demo.Lib.call(Lib.java:4)"])


def test_trace_keys(spark):
    from runlens.operators import render

    names = [("a", "x:1"), ("a", ""), ("a", ""), ("b", "y:2"), ("a", "x:1"), ("c", "")]
    frame = spark.createDataFrame([([(i, l, "", []) for i, l in names],)], f"f array<{R.FAILURE}>")
    assert frame.select(render.trace_keys(F.col("f")).alias("k")).first().k == ["a@x:1", "a", "a#2", "b", "a@x:1#2", "c"]


def test_json_starts_later(spark):
    cases = {"log\n[not json\n{\"a\": 1}\n": '{"a": 1}', "x\n[1]\ntrailer": None, "[1, 2]": "[1, 2]", "{\n\"a\": [\n1]}\n": '{\n"a": [\n1]}', "": None, "5": None, "[x\n" * 20 + "[1]": None, "[x\n" * 19 + "[1]": "[1]"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", D.json_part("t").alias("j"))
    assert {r.t: r.j for r in rows.collect()} == cases


def reports_of(spark, failures, failed=None, runner="vitest"):
    frame = spark.createDataFrame([(0, runner, 9, 5, len(failures) if failed is None else failed, 0, 0.0, failures)], f"run_id long, runner string, total long, passed long, failed long, skipped long, duration_s double, failures array<{R.FAILURE}>")
    return frame


def test_pytest_console(spark):
    text = "ok\n!!!!!!! Interrupted: 1 error during collection !!!!!!!\n!!! _pytest.outcomes.Exit: enough !!!\nFAIL Required test coverage of 90% not reached\n"
    for failures, want in (([], ["Interrupted: 1 error during collection", "_pytest.outcomes.Exit: enough"]), ([("t", "", "m", [])], ["m", "_pytest.outcomes.Exit: enough"])):
        r = C.pytest_session(reports_of(spark, failures, runner="pytest"), runs(spark, text)).first()
        assert [f.msg for f in r.failures] == [*want, "FAIL Required test coverage of 90% not reached"] and r.failed == len(r.failures)
        assert [f.id for f in r.failures][-2:] == ["(session)", "(coverage)"]
    body = "--- Captured Out ---\n" + "".join(f"line {i}\n" for i in range(12))
    xml = f'<testsuite><testcase classname="c" name="a"><failure message="m">E x</failure><system-out>{body}</system-out><system-err>--- Captured Log ---\nwarned</system-err></testcase></testsuite>'
    trace = R.junit(runs(spark, xml)).first().failures[0].trace
    assert trace == ["E x", "… +3 captured lines omitted (see raw_log)", *(f"[stdout] line {i}" for i in range(3, 12)), "[log] warned"]


def test_jvm_consoles(spark):
    gradle = "/p/A.java:3: error: bad\ne: file:///p/B.kt:4:5 worse\ne: /p/C.kts: (6, 7): worst\n/p/A.java:3: error: bad\n* What went wrong:\nExecution failed for task ':x'.\n  noise\n> Compilation failed\n> more\n\n* What went wrong:\nthere\n> There were failing tests\n* Try:\n* What went wrong:\n\n"
    r = C.add_build_failures(reports_of(spark, [], runner="gradle"), C.gradle_failures(runs(spark, gradle))).first()
    assert [(f.id, f.loc, f.msg) for f in r.failures] == [("(build)", "/p/A.java:3", "bad"), ("(build)", "/p/B.kt:4:5", "worse"), ("(build)", "/p/C.kts:6:7", "worst"), ("(build)", "", "Execution failed for task ':x'. Compilation failed")]
    assert r.failed == 0
    maven = "[ERROR] /p/A.java:[3,11] no symbol\n[INFO] x\n[ERROR] Failed to execute goal a:b: There are test failures.\n[ERROR] Failed to execute goal c:d (x): boom\n[ERROR] /p/A.java:[3,11] no symbol\n"
    r = C.add_build_failures(reports_of(spark, [], runner="maven"), C.maven_failures(runs(spark, maven))).first()
    assert [(f.loc, f.msg) for f in r.failures] == [("/p/A.java:3:11", "no symbol"), ("", "Failed to execute goal c:d (x): boom")]


def test_vitest_console(spark):
    rule = "⎯" * 5
    err = f"{rule} Unhandled Errors {rule}\n\nVitest caught 2 errors\n\n{rule} Uncaught Exception {rule}\nError: boom\n ❯ a.ts:1:2\n ❯ node:internal/x\nnoise\nThis error originated in b.ts\n\n{rule} Unhandled Rejection {rule}\nError: two\n{rule}{rule}\n{rule} Later {rule}\nError: not in it\n"
    found = C.vitest_unhandled(runs(spark, err))
    r = C.add_unhandled(reports_of(spark, [("t", "", "m", []), ("(run)", "", "success: false", [])]), found).first()
    assert [(f.id, f.msg, f.trace) for f in r.failures] == [("t", "m", []), ("(unhandled error)", "Error: boom", ["Uncaught Exception", "❯ a.ts:1:2", "This error originated in b.ts"]), ("(unhandled error)", "Error: two", ["Unhandled Rejection"])]
    assert r.failed == 3
    out = "stdout | src/a.test.js > suite > one\nhello\n  there\n\nstray\nstderr | src/b.test.js > suite > one\nother file\n\nstdout | src/a.test.js\nno test\n"
    printed = C.vitest_console(runs(spark, out))
    r = C.add_console(reports_of(spark, [("suite one", "/w/src/a.test.js:3", "m", ["t"]), ("z", "", "", [])]), printed).first()
    assert [f.trace for f in r.failures] == [["t", "console: hello", "console: there"], []]
    many = "stdout | a.js > k\n" + "".join(f"l{i}\n" for i in range(13))
    r = C.add_console(reports_of(spark, [("k", "a.js", "m", [])]), C.vitest_console(runs(spark, many))).first()
    assert len(r.failures[0].trace) == 11 and r.failures[0].trace[-1] == "… +3 console lines omitted (see raw_log)"
    r = C.explain_run(reports_of(spark, [("(run)", "", "success: false", [])]), runs(spark, "x\n  ERROR: no config\nERROR: later\n"), "ERROR: ").first()
    assert r.failures[0].msg == "ERROR: no config"


def test_hooks(spark):
    text = "intro\nruff.....................Failed\n- hook id: ruff\n- exit code: 1\n\na.py:1 bad\nmore\nxml......(no files to check)Skipped\nfmt......Failed\n- hook id: fmt\n- files were modified by this hook\nquiet....Failed\n- exit code: 3\nok.......Passed\nlong.....Failed\n- hook id: l\n" + "".join(f"v{i}\n" for i in range(25))
    r = C.pre_commit(runs(spark, text, "none")).collect()
    assert len(r) == 1 and (r[0].total, r[0].passed, r[0].failed, r[0].skipped) == (6, 1, 4, 1)
    assert [(f.id, f.loc, f.msg, f.trace) for f in r[0].failures] == [("ruff", "ruff", "a.py:1 bad", ["more"]), ("fmt", "fmt", "files were modified by this hook", []), ("quiet", "", "exit code 3", []), ("long", "l", "v0", ["25 lines of hook output: full output follows the report"])]
    assert r[0].passthrough.startswith("--- long (l): full output ---\nv0\n") and r[0].passthrough.endswith("v24\n")


def test_build_fallback(spark):
    rows = spark.createDataFrame([(0, "/p/a.swift:1:2: error: bad\n", 1), (1, "/p/a.swift:1:2: error: bad\n", 0), (2, "nothing\n", 1), (3, "/p/a.swift:1:2: error: bad\n", 1)], "run_id long, text string, exit int")
    got = C.build_fallback(rows, spark.createDataFrame([(3,)], "run_id long"))
    assert [(r.run_id, r.msg) for r in got.collect()] == [(0, "bad")]
    cases = {"warning: x": True, "error[E1]: y": True, "error: test failed, to rerun pass": False, "error: 2 targets failed:": False, "my-error: z": False}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", C.has_real_diagnostic("t").alias("d"))
    assert {r.t: r.d for r in rows.collect()} == cases


def test_locate_sources(spark):
    r = reports_of(spark, [("demo.AppTest.fails", "AppTest.java:21", "m", ["t"]), ("demo.AppTest.other", "Other.java:3", "", []), ("x.T.y", "dir/T.kt:1", "", [])])
    sources = spark.createDataFrame([(0, "app/src/test/java/demo/AppTest.java"), (0, "app/src/test/java/else/Other.java"), (1, "app/src/test/java/demo/Other.java")], "run_id long, path string")
    assert [(f.loc, f.trace) for f in C.locate_sources(r, sources).first().failures] == [("app/src/test/java/demo/AppTest.java:21", ["t"]), ("Other.java:3", []), ("dir/T.kt:1", [])]


def test_trace_keys_of_many_failures(spark):
    """The work grows with the number of failures, not with its square."""
    from runlens.operators import render

    f = F.transform(F.sequence(F.lit(0), F.lit(1499)), lambda i: F.struct(F.concat(F.lit("t"), (i % 9).cast("string")).alias("id"), F.concat(F.lit("a:"), (i % 50).cast("string")).alias("loc")))
    start = time.monotonic()
    keys = spark.range(1).select(f.alias("f")).select(render.trace_keys(F.col("f")).alias("k")).first().k
    assert time.monotonic() - start < 30
    assert len(set(keys)) == 1500 and keys[0] == "t0@a:0" and keys[450] == "t0@a:0#2"
