"""Queries of the output parsers: tables rendered as tool output, parsed back.

The SQL computes the expected rows straight from the columns, so it shares
nothing with the rendering or the parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import console as C
from ..operators import diagnostics as D
from ..operators import ladder
from ..operators import reports as R
from . import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def as_json(rows: DataFrame, item, key: str = "doc_id") -> DataFrame:
    """(run_id, text): one JSON array per run, in order of pos."""
    parts = F.array_sort(F.collect_list(F.struct("pos", item.alias("v"))))
    return rows.groupBy(F.col(key).alias("run_id")).agg(F.concat(F.lit("noise\n"), F.to_json(F.transform(parts, lambda x: x["v"]))).alias("text"))


def as_lines(rows: DataFrame, line, key: str = "doc_id", first: str = "", last: str = "") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", line.alias("v"))))
    body = F.array_join(F.transform(parts, lambda x: F.concat(x["v"], F.lit("\n"))), "")
    return rows.groupBy(F.col(key).alias("run_id")).agg(F.concat(F.lit(first), body, F.lit(last)).alias("text"))


def text(c):
    return F.col(c).cast("string")


def bare(found: DataFrame) -> DataFrame:
    """Without positions: line numbers repeat within some orders."""
    return found.drop("pos")


ROW = "doc_id AS run_id"
LOC = """file || ':' || "row" || ':' || "column" AS loc"""


@query(f"WITH {V.DIAGNOSTICS_SQL} SELECT {ROW}, {LOC}, 'error' AS severity, rule, msg FROM diag")
def ruff(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("rule").alias("code"), F.concat("msg", F.lit("\nmore")).alias("message"), F.col("file").alias("filename"), F.struct("row", "column").alias("location"))
    return bare(D.ruff(as_json(V.diagnostics(spark, sf_dir), item)))


def eslint_runs(spark, sf_dir):
    d = V.diagnostics(spark, sf_dir)
    message = F.struct(F.col("rule").alias("ruleId"), F.when(F.col("severity") == "error", 2).otherwise(1).alias("severity"), F.col("msg").alias("message"), F.col("row").alias("line"), "column")
    n = lambda s: F.count_if(F.col("severity") == s)
    files = d.groupBy("doc_id", "file").agg(F.min("pos").alias("pos"), n("error").alias("errorCount"), n("warning").alias("warningCount"), F.transform(F.array_sort(F.collect_list(F.struct("pos", message.alias("m")))), lambda x: x["m"]).alias("messages"))
    return as_json(files, F.struct(F.col("file").alias("filePath"), "errorCount", "warningCount", "messages"))


@query(f"""WITH {V.DIAGNOSTICS_SQL}, f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, file) AS at_file FROM diag)
SELECT {ROW}, {LOC}, severity, rule, msg FROM f""")
def eslint(spark, sf_dir):
    return bare(D.eslint(eslint_runs(spark, sf_dir)))


@query(f"WITH {V.DIAGNOSTICS_SQL} SELECT doc_id AS run_id, 'eslint' AS runner, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(DISTINCT file) AS files FROM diag GROUP BY doc_id")
def eslint_summary(spark, sf_dir):
    return D.eslint_summary(eslint_runs(spark, sf_dir))


@query(f"WITH {V.DIAGNOSTICS_SQL} SELECT {ROW}, file || ':' || \"row\" || CASE WHEN \"column\" % 2 = 0 THEN '' ELSE ':' || \"column\" END AS loc, severity, rule, msg FROM diag")
def swiftlint(spark, sf_dir):
    item = F.struct(F.when(F.col("column") % 2 == 1, F.col("column")).alias("character"), "file", F.col("row").alias("line"), F.col("msg").alias("reason"), F.col("rule").alias("rule_id"), F.initcap("severity").alias("severity"))
    return bare(D.swiftlint(as_json(V.diagnostics(spark, sf_dir), item)))


@query(f"WITH {V.DIAGNOSTICS_SQL} SELECT {ROW}, CASE WHEN \"column\" = 1 THEN file ELSE file || ':' || \"row\" || ':' || \"column\" END AS loc, severity, rule, msg || CASE WHEN \"column\" = 2 THEN ' (try it)' ELSE '' END AS msg FROM diag")
def mypy(spark, sf_dir):
    column = F.when(F.col("column") == 1, -1).otherwise(F.col("column") - 1)
    line = F.to_json(F.struct("file", F.col("row").alias("line"), column.alias("column"), F.col("msg").alias("message"), F.when(F.col("column") == 2, "try it\nnow").alias("hint"), F.col("rule").alias("code"), "severity"))
    return bare(D.mypy(as_lines(V.diagnostics(spark, sf_dir), line, first="checking\n", last="Found 3 errors\n")))


@query(f"WITH {V.DIAGNOSTICS_SQL} SELECT {ROW}, file || CASE WHEN \"column\" = 1 THEN '' WHEN \"column\" = 2 THEN ':' || \"row\" ELSE ':' || \"row\" || ':' || \"column\" END AS loc, CASE WHEN \"column\" = 4 THEN 'info' ELSE severity END AS severity, rule, msg FROM diag")
def golangci(spark, sf_dir):
    d = V.diagnostics(spark, sf_dir)
    pos = F.struct(F.col("file").alias("Filename"), F.when(F.col("column") != 1, F.col("row")).alias("Line"), F.when(F.col("column") > 2, F.col("column")).alias("Column"))
    issue = F.struct(F.col("rule").alias("FromLinter"), F.col("msg").alias("Text"), F.when(F.col("column") == 4, "Hint").when(F.col("severity") == "error", "").otherwise("Warn").alias("Severity"), pos.alias("Pos"))
    parts = F.array_sort(F.collect_list(F.struct("pos", issue.alias("v"))))
    runs = d.groupBy(F.col("doc_id").alias("run_id")).agg(F.concat(F.to_json(F.struct(F.transform(parts, lambda x: x["v"]).alias("Issues"))), F.lit("\n3 issues: {x}\n")).alias("text"))
    return bare(D.golangci(runs))


@query(f"""WITH {V.DIAGNOSTICS_SQL}, u AS (SELECT doc_id, file, rule, min(pos) AS pos, arg_min(severity, pos) AS severity, msg FROM diag GROUP BY doc_id, file, rule, msg)
SELECT {ROW}, file || ':7:1' AS loc, severity, rule, msg || CASE WHEN severity = 'error' THEN ' (here); help: do this: `x`' ELSE '' END AS msg FROM u""")
def cargo_build_dedup(spark, sf_dir):
    span = F.struct(F.col("file").alias("file_name"), F.lit(True).alias("is_primary"), F.lit(7).alias("line_start"), F.lit(1).alias("column_start"), F.lit("here").alias("label"))
    child = F.struct(F.lit("do this\nor that").alias("message"), F.lit("help").alias("level"), F.array(F.struct(F.lit("x").alias("suggested_replacement"))).alias("spans"))
    message = F.struct(F.col("msg").alias("message"), F.col("severity").alias("level"), F.struct(F.col("rule").alias("code")).alias("code"), F.array(span).alias("spans"), F.array(child).alias("children"))
    line = F.to_json(F.struct(F.lit("compiler-message").alias("reason"), message.alias("message")))
    both = F.concat(line, F.lit("\n{\"reason\":\"build-finished\"}\n"), line)
    return bare(D.cargo(as_lines(V.diagnostics(spark, sf_dir), both, first="Compiling\n")))


@query(f"WITH {V.DIAGNOSTICS_SQL} SELECT {ROW}, CASE WHEN \"column\" = 1 THEN '' ELSE {LOC.removesuffix(' AS loc')} END AS loc, severity, 'TS' || \"row\" AS rule, msg || CASE WHEN \"column\" = 2 THEN ' and more' ELSE '' END AS msg FROM diag")
def tsc_diagnostics(spark, sf_dir):
    at = F.when(F.col("column") == 1, "").otherwise(F.concat("file", F.lit("("), text("row"), F.lit(","), text("column"), F.lit("): ")))
    line = F.concat(at, "severity", F.lit(" TS"), text("row"), F.lit(": "), "msg", F.when(F.col("column") == 2, "\n  and more").otherwise(""))
    return bare(D.tsc(as_lines(V.diagnostics(spark, sf_dir), line, first="> tsc\n", last="Found 2 errors.\n")))


def gcc_line():
    return F.concat("file", F.lit(":"), text("row"), F.lit(":"), text("column"), F.lit(": "), "severity", F.lit(": "), "msg")


@query(f"WITH {V.DIAGNOSTICS_SQL} SELECT {ROW}, {LOC}, severity, '' AS rule, msg FROM diag")
def clang_diagnostics(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[1m"), gcc_line(), F.lit("\x1b[0m"))
    return bare(D.clang(as_lines(V.diagnostics(spark, sf_dir), coloured, first="note: x\nIn file included from a.c:3:\n")))


@query(f"WITH {V.DIAGNOSTICS_SQL} SELECT doc_id, pos, {LOC}, severity, msg FROM diag")
def gcc_diagnostics(spark, sf_dir):
    d = V.diagnostics(spark, sf_dir)
    return ladder.gcc_diagnostics(d.select("doc_id", "pos", gcc_line().alias("line"), F.lit("\n").alias("term")))


@query(f"WITH {V.DIAGNOSTICS_SQL} SELECT doc_id AS run_id, 'clang' AS runner, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM diag GROUP BY doc_id")
def diagnostics_summary(spark, sf_dir):
    runs = as_lines(V.diagnostics(spark, sf_dir), gcc_line())
    return D.summarise(D.clang(runs), runs, "clang")


@query(f"WITH {V.DIAGNOSTICS_SQL} SELECT {ROW}, {LOC}, 'error' AS severity, 'CS' || \"row\" AS rule, 'CS' || \"row\" || ': ' || msg AS msg FROM diag WHERE severity = 'error'")
def msbuild_errors(spark, sf_dir):
    line = F.concat("file", F.lit("("), text("row"), F.lit(","), text("column"), F.lit("): "), "severity", F.lit(" CS"), text("row"), F.lit(": "), "msg", F.lit(" [a.csproj]"))
    return bare(D.msbuild(as_lines(V.diagnostics(spark, sf_dir), line)))


@query(f"""WITH {V.DIAGNOSTICS_SQL}, e AS (SELECT DISTINCT doc_id FROM diag WHERE severity = 'error')
SELECT {ROW}, {LOC}, severity, '' AS rule, msg FROM diag
UNION ALL SELECT doc_id, '', 'error', '', 'ld: cannot link' FROM (SELECT DISTINCT doc_id FROM diag WHERE doc_id NOT IN (SELECT doc_id FROM e))""")
def build_report(spark, sf_dir):
    """Every build failed; where no compiler error says why, the linker does."""
    runs = as_lines(V.diagnostics(spark, sf_dir), gcc_line(), last="ld: warning: x\nld: cannot link\nld: cannot link\n").withColumn("exit", F.lit(1))
    found = D.build_report(runs)
    return bare(found)


# --- test reports: parts as tests, brands as runs, types as suites ---


def tests(spark, sf_dir) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    outcome = F.when(F.col("p_size") % 5 == 0, "fail").when(F.col("p_size") % 7 == 0, "skip").otherwise("pass")
    return p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 3).alias("suite"), F.concat(F.lit("t"), text("p_partkey")).alias("name"), F.col("p_size").cast("long").alias("line"), outcome.alias("outcome"))


TESTS = """
  tests AS (SELECT p_brand AS run_id, p_partkey AS pos, p_partkey % 3 AS suite, 't' || p_partkey AS name, p_size::BIGINT AS line,
                   CASE WHEN p_size % 5 = 0 THEN 'fail' WHEN p_size % 7 = 0 THEN 'skip' ELSE 'pass' END AS outcome FROM part)"""
COUNTS = "count(*) AS total, count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome = 'fail') AS failed, count(*) FILTER (outcome = 'skip') AS skipped"


def listed(failure: str, order: str = "pos") -> str:
    return f"coalesce(string_agg({failure}, ';' ORDER BY {order}) FILTER (outcome = 'fail'), '') AS failures"


def shown(reports: DataFrame, *fields: str) -> DataFrame:
    """Failures as one text, for comparison."""
    one = lambda f: F.concat_ws("|", *(F.concat_ws("/", f[x]) if x == "trace" else f[x] for x in fields))
    return reports.withColumn("failures", F.array_join(F.transform("failures", one), ";"))


def junit_runs(spark, sf_dir, key=("doc_id",)) -> DataFrame:
    body = F.when(F.col("outcome") == "fail", F.concat(F.lit('<failure message="bad '), "name", F.lit('&#10;more">E   x</failure>'))).when(F.col("outcome") == "skip", F.lit("<skipped/>")).otherwise("")
    case = F.concat(F.lit('<testcase classname="C" file="a.py" name="'), "name", F.lit('" line="'), text("line"), F.lit('">'), body, F.lit("</testcase>"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", case.alias("v")))), lambda x: x["v"]), "")
    suites = tests(spark, sf_dir).groupBy("doc_id", "suite").agg(F.concat(F.lit('<testsuite time="0.5">'), parts, F.lit("</testsuite>")).alias("s"))
    if "suite" in key:
        return suites.select(F.concat_ws("/", "doc_id", text("suite")).alias("run_id"), "doc_id", F.col("suite").alias("part"), F.col("s").alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("suite", "s"))), lambda x: x["s"]), "")
    return suites.groupBy(F.col("doc_id").alias("run_id")).agg(F.concat(F.lit('<?xml version="1.0"?><testsuites>'), whole, F.lit("</testsuites>")).alias("text"))


@query(f"WITH {TESTS} SELECT run_id, 'pytest' AS runner, {COUNTS}, count(DISTINCT suite) * 0.5::DOUBLE AS duration_s, {listed(chr(39) + 'a.py::' + chr(39) + ' || name || ' + chr(39) + '|a.py:' + chr(39) + ' || (line + 1) || ' + chr(39) + '|bad ' + chr(39) + ' || name', 'suite, pos')} FROM tests GROUP BY run_id")
def junit_report(spark, sf_dir):
    return shown(R.junit(junit_runs(spark, sf_dir)), "id", "loc", "msg")


@query(f"WITH {TESTS} SELECT run_id AS doc_id, 'phpunit' AS runner, {COUNTS}, count(DISTINCT suite) * 0.5::DOUBLE AS duration_s, {listed(chr(39) + 'a.py::' + chr(39) + ' || name', 'suite, pos')} FROM tests GROUP BY run_id")
def junit_merge(spark, sf_dir):
    """A file per suite, merged per run."""
    runs = junit_runs(spark, sf_dir, ("doc_id", "suite"))
    reports = R.junit(runs, "phpunit").join(runs.select("run_id", "doc_id", "part"), "run_id")
    return shown(R.merge(reports, ["doc_id"], "part"), "id")


@query(f"WITH {TESTS} SELECT run_id, 'dotnet' AS runner, {COUNTS}, round(sum(60 + line * 0.25), 3)::DOUBLE AS duration_s, {listed('name || ' + chr(39) + '|A.cs:' + chr(39) + ' || line || ' + chr(39) + '|broke' + chr(39))} FROM tests GROUP BY run_id")
def trx_report(spark, sf_dir):
    outcome = F.when(F.col("outcome") == "fail", "Failed").when(F.col("outcome") == "skip", "NotExecuted").otherwise("Passed")
    seconds = F.format_string("00:01:%05.2f", F.col("line") * 0.25)
    info = F.when(F.col("outcome") == "fail", F.concat(F.lit("<Output><ErrorInfo><Message>broke\nmore</Message><StackTrace>   at System.X()\n   at T() in A.cs:line "), text("line"), F.lit("\n</StackTrace></ErrorInfo></Output>"))).otherwise("")
    one = F.concat(F.lit('<UnitTestResult testName="'), "name", F.lit('" outcome="'), outcome, F.lit('" duration="'), seconds, F.lit('">'), info, F.lit("</UnitTestResult>"))
    runs = as_lines(tests(spark, sf_dir), one, first="<TestRun><Results>", last='</Results><ResultSummary outcome="Failed"/></TestRun>')
    return shown(R.trx(runs), "id", "loc", "msg")


@query(f"WITH {TESTS} SELECT run_id, 'jest' AS runner, {COUNTS}, 1.5::DOUBLE AS duration_s, {listed('name || ' + chr(39) + '|f.js:' + chr(39) + ' || line || ' + chr(39) + '|oops|at t (f.js)' + chr(39))} FROM tests GROUP BY run_id")
def jest_report(spark, sf_dir):
    status = F.when(F.col("outcome") == "fail", "failed").when(F.col("outcome") == "skip", "pending").otherwise("passed")
    messages = F.when(F.col("outcome") == "fail", F.array(F.lit("\x1b[31moops\x1b[0m\n    at t (f.js)\n    at run (node_modules/x.js)"))).otherwise(F.array().cast("array<string>"))
    assertion = F.struct(F.col("name").alias("fullName"), status.alias("status"), messages.alias("failureMessages"), F.struct("line").alias("location"))
    n = lambda s: F.count_if(F.col("outcome") == s)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", assertion.alias("v")))), lambda x: x["v"])
    runs = tests(spark, sf_dir).groupBy(F.col("doc_id").alias("run_id")).agg(F.count(F.lit(1)).alias("numTotalTests"), n("pass").alias("numPassedTests"), n("fail").alias("numFailedTests"), n("skip").alias("numPendingTests"), parts.alias("a"))
    file = F.struct(F.lit("f.js").alias("name"), F.lit(2500.0).alias("endTime"), F.when(F.col("numFailedTests") > 0, "failed").otherwise("passed").alias("status"), F.lit("").alias("message"), F.col("a").alias("assertionResults"))
    doc = F.struct("numTotalTests", "numPassedTests", "numFailedTests", "numPendingTests", F.lit(0).alias("numTodoTests"), F.lit(0).alias("numRuntimeErrorTestSuites"), (F.col("numFailedTests") == 0).alias("success"), F.lit(1000.0).alias("startTime"), F.array(file).alias("testResults"))
    return shown(R.jest(runs.select("run_id", F.concat(F.lit("> jest\n"), F.to_json(doc)).alias("text"))), "id", "loc", "msg", "trace")


@query(f"WITH {TESTS} SELECT run_id, 'rspec' AS runner, {COUNTS}, 2.0::DOUBLE AS duration_s, {listed('name || ' + chr(39) + '|a_spec.rb:' + chr(39) + ' || line || ' + chr(39) + '|E: one' + chr(39))} FROM tests GROUP BY run_id")
def rspec_report(spark, sf_dir):
    exc = F.when(F.col("outcome") == "fail", F.struct(F.lit("E").alias("class"), F.lit("\n one\ntwo").alias("message"), F.array(F.lit("/gems/x")).alias("backtrace")))
    example = F.struct(F.col("name").alias("full_description"), F.when(F.col("outcome") == "fail", "failed").otherwise("passed").alias("status"), F.lit("./a_spec.rb").alias("file_path"), F.col("line").alias("line_number"), exc.alias("exception"))
    n = lambda s: F.count_if(F.col("outcome") == s)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", example.alias("v")))), lambda x: x["v"])
    runs = tests(spark, sf_dir).groupBy(F.col("doc_id").alias("run_id")).agg(parts.alias("examples"), F.struct(F.lit(2.0).alias("duration"), F.count(F.lit(1)).alias("example_count"), n("fail").alias("failure_count"), n("skip").alias("pending_count"), F.lit(0).alias("errors_outside_of_examples_count")).alias("summary"))
    return shown(R.rspec(runs.select("run_id", F.to_json(F.struct("examples", "summary")).alias("text"))), "id", "loc", "msg")


@query(f"WITH {TESTS} SELECT run_id, 'xcodebuild-test' AS runner, {COUNTS}, 3.5::DOUBLE AS duration_s, {listed(chr(39) + 'T.' + chr(39) + ' || name')} FROM tests GROUP BY run_id")
def xcresult_report(spark, sf_dir):
    n = lambda s: F.count_if(F.col("outcome") == s)
    bad = F.when(F.col("outcome") == "fail", F.struct("pos", F.struct(F.lit("x").alias("failureText"), F.lit("T").alias("targetName"), F.col("name").alias("testIdentifierString")).alias("v")))
    runs = tests(spark, sf_dir).groupBy(F.col("doc_id").alias("run_id")).agg(F.count(F.lit(1)).alias("totalTestCount"), n("pass").alias("passedTests"), n("fail").alias("failedTests"), n("skip").alias("skippedTests"), F.transform(F.array_sort(F.collect_list(bad)), lambda x: x["v"]).alias("testFailures"))
    doc = F.to_json(F.struct("totalTestCount", "passedTests", "failedTests", "skippedTests", F.lit(1.0).alias("startTime"), F.lit(4.5).alias("finishTime"), "testFailures"))
    return shown(R.xcresult(runs.select("run_id", doc.alias("text"))), "id")


@query("""
WITH t AS (SELECT o_custkey % 100 AS run_id, 'p' || o_custkey AS pkg, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'P' THEN 'run' ELSE 'pass' END AS action FROM orders),
p AS (SELECT run_id, pkg, max((action = 'fail')::INT) = 1 AS bad, count(*) AS n, count(*) FILTER (action = 'pass') AS passed, count(*) FILTER (action = 'fail' OR action = 'run' AND pkg_bad) AS failed FROM (SELECT *, max((action = 'fail')::INT) OVER (PARTITION BY pkg) = 1 AS pkg_bad FROM t) GROUP BY ALL)
SELECT run_id, 'go-test' AS runner, sum(greatest(passed + failed, 1))::BIGINT AS total, sum(passed + (passed + failed = 0)::INT)::BIGINT AS passed, sum(failed)::BIGINT AS failed, 0::BIGINT AS skipped, 0.25::DOUBLE AS duration_s, sum(failed)::BIGINT AS n_failures FROM p GROUP BY run_id""")
def go_test_report(spark, sf_dir):
    """A test per order under a parent that is no leaf; orders in 'P' never end."""
    o = V.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("run_id"), F.concat(F.lit("p"), text("o_custkey")).alias("Package"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("T/o"), text("o_orderkey")).alias("Test"), "o_orderstatus")
    ends = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass")
    none = lambda kind: F.lit(None).cast(kind)
    event = lambda d, action, test, output=None, at=0: d.select("run_id", (F.col("pos") * 8 + at).alias("pos"), action.alias("Action"), "Package", test.alias("Test"), F.lit(0.25).alias("Elapsed"), (output if output is not None else none("string")).alias("Output"))
    done = event(o, ends, F.col("Test"), at=2).where("Action is not null")
    said = event(o.where("o_orderstatus = 'F'"), F.lit("output"), F.col("Test"), F.lit("    a_test.go:7: bad\n"), 1)
    packages = o.groupBy("run_id", "Package").agg(F.max("pos").alias("pos"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("bad"))
    parent = event(packages, F.when(F.col("bad") == 1, "fail").otherwise("pass"), F.lit("T"), at=3)
    ended = event(packages, F.when(F.col("bad") == 1, "fail").otherwise("pass"), none("string"), at=4)
    events = event(o, F.lit("run"), F.col("Test")).unionByName(said).unionByName(done).unionByName(parent).unionByName(ended)
    line = F.to_json(F.struct("Action", "Package", "Test", "Elapsed", "Output"))
    runs = as_lines(events, line, key="run_id", first="go: downloading x\n")
    return R.go_test(R.go_events(runs)).select("run_id", "runner", "total", "passed", "failed", "skipped", "duration_s", F.size("failures").cast("long").alias("n_failures"))


@query(f"WITH {TESTS} SELECT run_id, 'unittest' AS runner, {COUNTS}, 0.125::DOUBLE AS duration_s, {listed('name || ' + chr(39) + '|/a.py:' + chr(39) + ' || line || ' + chr(39) + '|AssertionError: bad' + chr(39))} FROM tests GROUP BY run_id")
def unittest_report(spark, sf_dir):
    block = F.when(F.col("outcome") == "fail", F.concat(F.lit("=" * 70 + "\nFAIL: t ("), "name", F.lit(')\n' + "-" * 70 + '\nTraceback (most recent call last):\n  File "/a.py", line '), text("line"), F.lit(", in t\n    x\nAssertionError: bad\n\n"))).otherwise(F.lit("."))
    n = lambda s: F.count_if(F.col("outcome") == s)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("v")))), lambda x: x["v"])
    runs = tests(spark, sf_dir).groupBy(F.col("doc_id").alias("run_id")).agg(F.array_join(parts, "").alias("b"), F.count(F.lit(1)).alias("n"), n("fail").alias("f"), n("skip").alias("s"))
    return shown(R.parse_text(runs.select("run_id", F.concat("b", F.format_string("\nRan %d tests in 0.125s\n\nFAILED (failures=%d, skipped=%d)\n", "n", "f", "s")).alias("text")), "unittest"), "id", "loc", "msg")


@query(f"WITH {TESTS} SELECT run_id, 'cargo-test' AS runner, {COUNTS}, 1.5::DOUBLE AS duration_s, {listed('name || ' + chr(39) + '|src/a.rs:' + chr(39) + ' || line || ' + chr(39) + ':5|boom' + chr(39))} FROM tests GROUP BY run_id")
def cargo_test_report(spark, sf_dir):
    bad = F.col("outcome") == "fail"
    block = F.when(bad, F.concat(F.lit("---- "), "name", F.lit(" stdout ----\nthread '"), "name", F.lit("' panicked at src/a.rs:"), text("line"), F.lit(":5:\nboom\nnote: run with RUST_BACKTRACE=1\n\n")))
    name = F.when(bad, F.concat(F.lit("    "), "name", F.lit("\n")))
    n = lambda s: F.count_if(F.col("outcome") == s)
    both = F.array_sort(F.collect_list(F.struct("pos", block.alias("b"), name.alias("n"))))
    runs = tests(spark, sf_dir).groupBy(F.col("doc_id").alias("run_id")).agg(both.alias("l"), n("pass").alias("p"), n("fail").alias("f"), n("skip").alias("s"))
    part = lambda k: F.array_join(F.transform("l", lambda x: F.coalesce(x[k], F.lit(""))), "")
    end = F.format_string("\ntest result: FAILED. %d passed; %d failed; %d ignored; 0 measured; 0 filtered out; finished in 1.5s\n", "p", "f", "s")
    return shown(R.parse_text(runs.select("run_id", F.concat(F.lit("failures:\n\n"), part("b"), F.lit("\nfailures:\n"), part("n"), end).alias("text")), "cargo-test"), "id", "loc", "msg")


@query(f"WITH {TESTS} SELECT run_id, 'pre-commit' AS runner, {COUNTS}, 0.0::DOUBLE AS duration_s, {listed('name || ' + chr(39) + '|hook said no' + chr(39))} FROM tests GROUP BY run_id")
def pre_commit_report(spark, sf_dir):
    status = F.when(F.col("outcome") == "fail", "Failed\n- hook id: x\nhook said no").when(F.col("outcome") == "skip", "Skipped").otherwise("Passed")
    return shown(R.parse_reports(as_lines(tests(spark, sf_dir), F.concat("name", F.lit("......."), status)), "pre-commit"), "id", "msg")


@query(f"WITH {TESTS} SELECT run_id, 'xctest' AS runner, {COUNTS}, 0.5::DOUBLE AS duration_s, {listed(chr(39) + 'S.' + chr(39) + ' || name || ' + chr(39) + '|/a/B.swift:' + chr(39) + ' || line || ' + chr(39) + '|no' + chr(39))} FROM tests GROUP BY run_id")
def xctest_report(spark, sf_dir):
    line = F.when(F.col("outcome") == "fail", F.concat(F.lit("/a/B.swift:"), text("line"), F.lit(": error: -[S "), "name", F.lit("] : no\n"))).otherwise("")
    n = lambda s: F.count_if(F.col("outcome") == s)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("v")))), lambda x: x["v"])
    runs = tests(spark, sf_dir).groupBy(F.col("doc_id").alias("run_id")).agg(F.array_join(parts, "").alias("b"), F.count(F.lit(1)).alias("n"), n("fail").alias("f"), n("skip").alias("s"))
    end = F.format_string("Executed %d tests, with %d tests skipped and %d failures (0 unexpected) in 0.5 (0.6) seconds\n", "n", "s", "f")
    return shown(R.parse_text(runs.select("run_id", F.concat("b", end).alias("text")), "xctest"), "id", "loc", "msg")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'xctest' WHEN 'view' THEN 'junit' WHEN 'click' THEN 'xcodebuild' WHEN 'signup' THEN 'json' END AS kind FROM events""")
def sniff(spark, sf_dir):
    e = F.col("event_type")
    shown_ = F.when(e == "error", "x\nExecuted 3 tests, with 1 failure").when(e == "view", '<?xml version="1.0"?>\n<testsuites/>').when(e == "click", "a\n** BUILD FAILED **\n").when(e == "signup", F.col("props")).otherwise("plain [text]")
    return V.table(spark, sf_dir, "events").select("event_id", R.sniff(shown_).alias("kind"))


CONSOLE_SQL = """
  e AS (SELECT user_id AS run_id, event_id AS pos, event_type AS kind FROM events),
  found AS (SELECT run_id, 0 AS k, pos, '/p/A' || (pos % 30) || '.java:' || (pos % 10) AS loc, 'bad ' || (pos % 3) AS msg FROM e WHERE kind = 'error'
            UNION ALL SELECT run_id, 1, pos, '', 'Task ' || (pos % 4) || ' broke reason ' || (pos % 2) FROM e WHERE kind = 'signup'),
  firsts AS (SELECT run_id, loc, msg, min({'k': k, 'pos': pos}) AS first FROM found GROUP BY ALL)"""


@query("WITH" + CONSOLE_SQL + """
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY first) AS n, '(build)' AS id, loc, msg, 0::BIGINT AS failed FROM firsts""")
def gradle_console(spark, sf_dir):
    """Errors and causes of broken builds, each once, behind a report without failures."""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), "event_type")
    n = lambda k: (F.col("pos") % k).cast("string")
    error = F.concat(F.lit("/p/A"), n(30), F.lit(".java:"), n(10), F.lit(": error: bad "), n(3))
    cause = F.concat(F.lit("* What went wrong:\nTask "), n(4), F.lit(" broke\n  noise\n> reason "), n(2), F.lit("\n> more\n"))
    line = F.when(F.col("event_type") == "error", error).when(F.col("event_type") == "signup", cause).otherwise("> Task :ok\n* What went wrong:\nTests\n> There were failing tests\n* Try:")
    consoles = as_lines(e, line, key="run_id")
    got = C.add_build_failures(bare_reports(consoles, "gradle"), C.gradle_failures(consoles))
    return got.select("run_id", F.posexplode("failures").alias("n", "f"), "failed").select("run_id", (F.col("n") + 1).cast("long").alias("n"), "f.id", "f.loc", "f.msg", "failed")


def bare_reports(consoles: DataFrame, runner: str) -> DataFrame:
    """A report without tests for each console."""
    zero = F.lit(0).cast("long")
    return consoles.select("run_id", F.lit(runner).alias("runner"), *(zero.alias(c) for c in ("total", "passed", "failed", "skipped")), F.lit(0.0).alias("duration_s"), F.array().cast(f"array<{R.FAILURE}>").alias("failures"))


@query("""
WITH e AS (SELECT user_id AS run_id, event_id AS pos, event_type AS kind FROM events),
f AS (SELECT run_id, pos, '(session)' AS id, 'stop ' || pos AS msg FROM e WHERE kind = 'error' UNION ALL SELECT run_id, pos, '(coverage)', 'FAIL Required test coverage of ' || (pos % 100) || '% not reached' FROM e WHERE kind = 'signup')
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS n, id, msg, count(*) OVER (PARTITION BY run_id) AS failed FROM f""")
def pytest_console(spark, sf_dir):
    """What stopped a session and unmet coverage, as failures that count."""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), "event_type")
    n = F.col("pos").cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("!!!!! stop "), n, F.lit(" !!!!!"))).when(F.col("event_type") == "signup", F.concat(F.lit("FAIL Required test coverage of "), (F.col("pos") % 100).cast("string"), F.lit("% not reached"))).otherwise("!!!!!")
    consoles = as_lines(e, line, key="run_id")
    got = C.pytest_session(bare_reports(consoles, "pytest"), consoles)
    return got.select("run_id", F.posexplode("failures").alias("n", "f"), "failed").select("run_id", (F.col("n") + 1).cast("long").alias("n"), "f.id", "f.msg", "failed")


@query("""
WITH e AS (SELECT user_id AS run_id, event_id AS pos, event_type AS kind, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS n FROM events)
SELECT run_id, n, 'suite test ' || pos AS id, 'hello ' || pos || ',again' AS printed FROM e WHERE bad""")
def vitest_console(spark, sf_dir):
    """What failed tests printed, joined to them by name and file."""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), "event_type")
    n = F.col("pos").cast("string")
    block = F.concat(F.lit("stdout | src/a.test.js > suite > test "), n, F.lit("\nhello "), n, F.lit("\n  again\n\nstray\nstderr | src/b.test.js > suite > test "), n, F.lit("\nother file\n"))
    consoles = as_lines(e, block, key="run_id")
    failed = R.failure(F.concat(F.lit("suite test "), n), F.concat(F.lit("/w/src/a.test.js:"), n), F.lit("m"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == "error", F.struct("pos", failed.alias("f"))))), lambda x: x["f"])
    reports = e.groupBy("run_id").agg(parts.cast(f"array<{R.FAILURE}>").alias("failures")).join(bare_reports(consoles, "vitest").drop("failures"), "run_id").select(*R.COLUMNS)
    got = C.add_console(reports, C.vitest_console(consoles)).select("run_id", F.posexplode("failures").alias("n", "f"))
    return got.select("run_id", (F.col("n") + 1).cast("long").alias("n"), "f.id", F.array_join(F.transform("f.trace", lambda x: F.replace(x, F.lit("console: "), F.lit(""))), ",").alias("printed"))
