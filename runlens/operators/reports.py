"""Test outputs as reports: one row per run with counts and failures.

Columns: run_id, runner, total, passed, failed, skipped, duration_s, failures
(array of id, loc, msg, trace). XML and JSON are read by expressions, event
streams by joins and aggregates, free text by small Python parsers.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .diagnostics import first_line, json_part, place
from .ladder import strip_escapes
from .lines import to_lines

FAILURE = "struct<id:string,loc:string,msg:string,trace:array<string>>"
REPORT = f"struct<runner:string,total:bigint,passed:bigint,failed:bigint,skipped:bigint,duration_s:double,failures:array<{FAILURE}>>"
COLUMNS = ["run_id", "runner", "total", "passed", "failed", "skipped", "duration_s", "failures"]

# Fields that the tools write, and frames that say nothing.
JEST = (
    "struct<numTotalTests:bigint,numPassedTests:bigint,numFailedTests:bigint,numPendingTests:bigint,numTodoTests:bigint,numRuntimeErrorTestSuites:bigint,success:boolean,startTime:double,"
    "testResults:array<struct<name:string,endTime:double,status:string,message:string,assertionResults:array<struct<fullName:string,status:string,failureMessages:array<string>,location:struct<line:bigint>>>>>>"
)
RSPEC = (
    "struct<examples:array<struct<full_description:string,status:string,file_path:string,line_number:bigint,exception:struct<class:string,message:string,backtrace:array<string>>>>,"
    "summary:struct<duration:double,example_count:bigint,failure_count:bigint,pending_count:bigint,errors_outside_of_examples_count:bigint>,messages:array<string>>"
)
XCRESULT = (
    "struct<totalTestCount:bigint,passedTests:bigint,failedTests:bigint,skippedTests:bigint,startTime:double,finishTime:double,result:string,"
    "testFailures:array<struct<failureText:string,targetName:string,testIdentifierString:string,testName:string>>>"
)
GO = "struct<Action:string,Package:string,Test:string,Elapsed:double,Output:string,ImportPath:string,FailedBuild:string>"
CASE = "struct<_name:string,_classname:string,_file:string,_line:string,failure:array<struct<_message:string,_VALUE:string>>,error:array<struct<_message:string,_VALUE:string>>,skipped:array<struct<_message:string,_VALUE:string>>,`system-out`:array<string>,`system-err`:array<string>>"
SUITE = f"_time:string,testcase:array<{CASE}>"
NESTED = f"{SUITE},testsuite:array<struct<{SUITE}>>"
JUNIT = f"{NESTED}".replace("testsuite:array<struct<", "testsuite:array<struct<testsuite:array<struct<" + SUITE + ">>,")
TRX = (
    "Results struct<UnitTestResult:array<struct<_testName:string,_outcome:string,_duration:string,Output:struct<ErrorInfo:struct<Message:string,StackTrace:string>>>>>, "
    "ResultSummary struct<_outcome:string,RunInfos:struct<RunInfo:array<struct<_outcome:string,Text:string>>>>"
)
NOISE = r"site-packages|/_pytest/|/unittest/case\.py|/importlib/|node_modules|/jest-|node:internal|<frozen |\(<anonymous>\)"
FRAME = r"^(?:File \"|at |[^:]+:\s*\d+\s*:\s*in )"
KEY_LINE = r"^(?:E |>|Expected|Received)|panicked at|^[A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception|Failure|Exit)\b"
DOTNET_NOISE = r"^(?:at System\.|at Xunit\.|at NUnit\.|at Microsoft\.VisualStudio\.|at Microsoft\.TestPlatform\.|at InvokeStub_)"
JVM_NOISE = r"^at .*(?:org\.junit\.|org\.opentest4j\.|junit\.framework\.|org\.testng\.internal\.|org\.gradle\.|org\.apache\.maven\.surefire\.|java\.base/|java\.lang\.reflect\.|java\.util\.|jdk\.internal\.|jdk\.proxy|sun\.reflect\.|kotlin\.coroutines\.)"
JVM_FRAME = r"^at (?:[\w.$-]+(?:@[\w.-]+)?/+)?([\w$.]+)\.[\w$<>-]+\(([\w$-]+\.(?:java|kt|groovy|scala)):(\d+)\)"
GO_PLACE = r"^(\S+\.go):(\d+):\s?(.*)$"
GO_FRAME = r"^\t(\S+\.go):(\d+)(?: \+0x[0-9a-f]+)?$"
CAPTURED = {"Captured Out": "stdout", "Captured Err": "stderr", "Captured Log": "log"}
CAPTURED_LINES = 10
BUILD_MARKS = r"\[build failed\]|\[setup failed\]"


def report(df: DataFrame, runner: str | Column, total: Column, passed: Column, failed: Column, skipped: Column, seconds: Column, failures: Column) -> DataFrame:
    zero = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    name = F.lit(runner) if isinstance(runner, str) else runner
    return df.select("run_id", name.alias("runner"), zero(total).alias("total"), zero(passed).alias("passed"), zero(failed).alias("failed"), zero(skipped).alias("skipped"), T.round_duration(F.coalesce(seconds.cast("double"), F.lit(0.0))).alias("duration_s"), failures.cast(f"array<{FAILURE}>").alias("failures"))


def failure(id_: Column, loc: Column, msg: Column, trace: Column | None = None) -> Column:
    return F.struct(id_.alias("id"), loc.alias("loc"), msg.alias("msg"), (trace if trace is not None else F.array().cast("array<string>")).alias("trace"))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim_trace(text: Column) -> Column:
    """Lines of a trace without blanks, carets and frames of frameworks.

    A frame runs from its header to the next; ``E`` lines always stay.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), strip)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))

    def step(state: Column, line: Column) -> Column:
        skip = F.when(line.rlike(FRAME), line.rlike(NOISE)).otherwise(state["skip"])
        empty = line.isin("", "Traceback (most recent call last):", "???") | line.rlike(r"^[\^~ ]+$")
        keeps = ~empty & (~skip | line.startswith("E "))
        return F.struct(F.when(keeps, F.concat(state["kept"], F.array(line))).otherwise(state["kept"]).alias("kept"), skip.alias("skip"))

    return F.aggregate(lines, start, step, lambda s: s["kept"])


def budget_trace(trace: Column, most: int) -> Column:
    """At most ``most`` lines: key lines first, then from the end; one marker."""
    t = F.transform(trace, lambda l, i: F.struct(i.alias("i"), l.alias("l"), l.rlike(KEY_LINE).alias("key")))
    room = max(1, most - 1)
    keys = F.slice(F.filter(t, lambda x: x["key"]), 1, room)
    rest = F.filter(t, lambda x: ~F.array_contains(F.transform(keys, lambda k: k["i"]), x["i"]))
    left = F.greatest(F.lit(0), F.lit(room) - F.size(keys))
    tail = F.slice(rest, F.greatest(F.lit(1), F.size(rest) - left + 1), left)
    kept = F.array_sort(F.concat(keys, tail))
    gap = F.array_min(F.array_except(F.transform(t, lambda x: x["i"]), F.transform(kept, lambda x: x["i"])))
    marker = F.concat(F.lit("… +"), (F.size(t) - F.size(kept)).cast("string"), F.lit(" lines omitted (see raw_log)"))
    shown = F.concat(F.transform(F.filter(kept, lambda x: x["i"] < gap), lambda x: x["l"]), F.array(marker), F.transform(F.filter(kept, lambda x: x["i"] > gap), lambda x: x["l"]))
    return F.when(F.size(trace) <= most, trace).when(F.lit(most) == 0, F.array().cast("array<string>")).otherwise(shown)


def captured_output(out: Column, err: Column) -> Column:
    """The last lines that a failed test printed, each with its stream; headers
    of captured parts name the stream of the lines below them."""

    def labelled(text: Column, label: str) -> Column:
        lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x.rlike(r"(?U)\S"))
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(label).alias("label"))
        title = lambda x: F.regexp_replace(strip(x), r"^[-]+(?U)\s*|(?U)\s*-+$", "")

        def step(state: Column, line: Column) -> Column:
            head = F.coalesce(*(F.when(title(line) == t, F.lit(name)) for t, name in CAPTURED.items()))
            kept = F.concat(state["out"], F.array(F.concat(F.lit("["), state["label"], F.lit("] "), line)))
            return F.struct(F.when(head.isNull(), kept).otherwise(state["out"]).alias("out"), F.coalesce(head, state["label"]).alias("label"))

        return F.aggregate(lines, start, step, lambda s: s["out"])

    both = F.concat(labelled(out, "stdout"), labelled(err, "stderr"))
    more = F.size(both) - CAPTURED_LINES
    marker = F.concat(F.lit("… +"), more.cast("string"), F.lit(" captured lines omitted (see raw_log)"))
    return F.when(more > 0, F.concat(F.array(marker), F.slice(both, -CAPTURED_LINES, CAPTURED_LINES))).otherwise(both)


def merge(reports: DataFrame, by: list[str], order: str) -> DataFrame:
    """One report per group: sums of counts and time, failures in order, first runner."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("failures").alias("f"))))
    sums = [F.sum(c).alias(c) for c in ("total", "passed", "failed", "skipped", "duration_s")]
    return reports.groupBy(*by).agg(F.min_by("runner", order).alias("runner"), *sums, F.flatten(F.transform(parts, lambda p: p["f"])).alias("failures"))


def junit(runs: DataFrame, runner: str = "pytest") -> DataFrame:
    """JUnit XML, suites nested up to three deep; a run without cases gives no row.

    Time sums over all suites, inner ones again, except for phpunit: outer only.
    """
    offset = 1 if runner == "pytest" else 0
    # a root of suites and a root suite read alike: the root is one more level
    root = F.from_xml(F.col("text"), f"_time string, testcase array<{CASE}>, testsuite array<struct<{JUNIT}>>", {"mode": "PERMISSIVE"})
    d = runs.withColumn("root", root).withColumn("bare", F.col("text").rlike(r"^(?:﻿)?\s*(?:<\?[^>]*>\s*)?<testsuite[\s>]"))
    empty = F.array().cast(f"array<{CASE}>")
    # all levels as (time, cases, level)
    flat = lambda s, level: F.struct(F.coalesce(s["_time"].try_cast("double"), F.lit(0.0)).alias("t"), F.coalesce(s["testcase"], empty).alias("c"), F.lit(level).alias("level"))
    none = F.array().cast(f"array<struct<t:double,c:array<{CASE}>,level:int>>")
    kids = lambda s: F.coalesce(s["testsuite"], F.array())
    third = lambda s: F.concat(F.array(flat(s, 2)), F.transform(kids(s), lambda x: flat(x, 3)))
    second = lambda s: F.concat(F.array(flat(s, 1)), F.flatten(F.transform(kids(s), third)))
    top = F.when(F.col("bare"), F.array(flat(F.col("root"), 0))).otherwise(none)
    suites = F.concat(top, F.coalesce(F.flatten(F.transform(F.col("root.testsuite"), second)), none))
    d = d.withColumn("suites", suites)
    cases = F.filter(F.flatten(F.transform("suites", lambda s: s["c"])), lambda c: c["_name"].isNotNull())
    outer = F.filter("suites", lambda s: s["level"] == F.when(F.col("bare"), 0).otherwise(1)) if runner == "phpunit" else F.col("suites")
    d = d.withColumn("cases", cases).withColumn("seconds", F.aggregate(outer, F.lit(0.0), lambda a, s: a + s["t"]))
    wrong = lambda c: F.coalesce(F.try_element_at(c["failure"], F.lit(1)), F.try_element_at(c["error"], F.lit(1)))
    failed = F.filter("cases", lambda c: wrong(c).isNotNull())
    skipped = F.filter("cases", lambda c: wrong(c).isNull() & c["skipped"].isNotNull())

    def one(c: Column) -> Column:
        file = F.coalesce(c["_file"], F.lit(""))
        id_ = F.when(file == "", F.concat(F.coalesce(c["_classname"], F.lit("")), F.lit("."), c["_name"])).otherwise(F.concat(file, F.lit("::"), c["_name"]))
        line = c["_line"].try_cast("bigint") + offset
        loc = F.when(line.isNotNull() & (file != ""), place(file, line)).otherwise(file)
        trace = trim_trace(wrong(c)["_VALUE"])
        said = first_line(wrong(c)["_message"])
        marked = F.transform(F.filter(trace, lambda l: l.startswith("E ")), lambda l: F.ltrim(F.substring(l, 2, 1 << 20)))
        raised = F.filter(marked, lambda l: l.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*(Error|Exception|Failure|Exit|Interrupt)\b"))
        said = F.when(said.isin("", "collection failure"), F.coalesce(F.try_element_at(raised, F.lit(1)), F.try_element_at(marked, F.lit(1)), said)).otherwise(said)
        other = F.filter(trace, lambda l: ~l.endswith(F.concat(F.lit("::"), c["_name"])))
        text = lambda name: F.array_join(F.coalesce(c[name], F.array().cast("array<string>")), "\n")
        printed = captured_output(text("system-out"), text("system-err"))
        return failure(id_, loc, F.when(said == "", F.coalesce(F.try_element_at(other, F.lit(1)), F.lit(""))).otherwise(said), F.concat(trace, printed))

    def tidy(f: Column) -> Column:
        """The place from the first frame of the test's own class; no framework frames; a typed first line as message."""
        own = F.filter(f["trace"], lambda l: l.rlike(JVM_FRAME) & f["id"].startswith(F.substring_index(F.regexp_extract(l, JVM_FRAME, 1), "$", 1)))
        at = F.when(f["loc"] == "", F.try_element_at(own, F.lit(1)))
        loc = F.coalesce(F.concat(F.regexp_extract(at, JVM_FRAME, 2), F.lit(":"), F.regexp_extract(at, JVM_FRAME, 3)), f["loc"])
        where = F.coalesce(F.array_position(f["trace"], at), F.lit(0))
        rest = F.filter(F.transform(f["trace"], lambda l, i: F.when((i + 1 != where) & ~l.rlike(JVM_NOISE), l)), lambda l: l.isNotNull())
        first = F.try_element_at(rest, F.lit(1))
        typed = F.coalesce((first == f["msg"]) | first.endswith(F.concat(F.lit(": "), f["msg"])), F.lit(False))
        return failure(f["id"], loc, F.when(typed, first).otherwise(f["msg"]), F.when(typed, F.slice(rest, 2, 1 << 20)).otherwise(rest))

    d = d.where(F.size("cases") > 0)
    if runner in ("gradle", "maven"):
        return report(d, runner, F.size("cases"), F.size("cases") - F.size(failed) - F.size(skipped), F.size(failed), F.size(skipped), F.col("seconds"), F.transform(F.transform(failed, one), tidy))
    return report(d, runner, F.size("cases"), F.size("cases") - F.size(failed) - F.size(skipped), F.size(failed), F.size(skipped), F.col("seconds"), F.transform(failed, one))


def trx(runs: DataFrame) -> DataFrame:
    root = F.from_xml(F.regexp_replace("text", "^﻿", ""), TRX, {"rowTag": "TestRun"})
    d = runs.withColumn("root", root)
    tests = F.coalesce(F.col("root.Results.UnitTestResult"), F.array())
    d = d.withColumn("tests", tests)
    passed = F.filter("tests", lambda r: r["_outcome"].isin("Passed", "PassedButRunAborted"))
    failed = F.filter("tests", lambda r: r["_outcome"].isin("Failed", "Error", "Timeout", "Aborted"))

    def one(r: Column) -> Column:
        message, stack = r["Output"]["ErrorInfo"]["Message"], r["Output"]["ErrorInfo"]["StackTrace"]
        more = F.filter(F.slice(F.split(F.coalesce(message, F.lit("")), r"\r?\n"), 2, 1 << 20), lambda l: F.trim(l) != "")
        frames = F.filter(F.transform(F.split(F.coalesce(stack, F.lit("")), r"\r?\n"), strip), lambda l: (l != "") & ~l.rlike(DOTNET_NOISE))
        at = F.try_element_at(F.filter(frames, lambda l: l.rlike(r" in .*:line \d+\s*$")), F.lit(1))
        loc = F.coalesce(F.regexp_replace(F.regexp_extract(at, r".* in (.*:line \d+)\s*$", 1), ":line ", ":"), F.lit(""))
        return failure(F.coalesce(r["_testName"], F.lit("")), loc, F.trim(first_line(message)), F.concat(F.transform(more, lambda l: F.rtrim(l)), F.filter(frames, lambda l: at.isNull() | (l != at))))

    bad = F.col("root.ResultSummary._outcome").isin("Failed", "Error", "Aborted", "Timeout") & (F.size(failed) == 0)
    infos = F.filter(F.coalesce(F.col("root.ResultSummary.RunInfos.RunInfo"), F.array()), lambda i: i["_outcome"] == "Error")
    infos = F.when(bad, F.transform(infos, lambda i: failure(F.lit("(run)"), F.lit(""), F.trim(first_line(i["Text"]))))).otherwise(F.array().cast(f"array<{FAILURE}>"))
    failures = F.concat(F.transform(failed, one).cast(f"array<{FAILURE}>"), infos.cast(f"array<{FAILURE}>"))
    seconds = F.aggregate("tests", F.lit(0.0), lambda a, r: a + F.coalesce(T.clock_seconds(r["_duration"]), F.lit(0.0)))
    return report(d, "dotnet", F.size("tests"), F.size(passed), F.size(failures), F.size("tests") - F.size(passed) - F.size(failed), seconds, failures)


def jest(runs: DataFrame, runner: str = "jest") -> DataFrame:
    d = runs.withColumn("r", F.from_json(json_part("text"), JEST)).where("r is not null")

    def one(file: Column, a: Column) -> Column:
        text = strip_escapes(F.array_join(a["failureMessages"], "\n"))
        loc = F.when(a["location"]["line"].isNull(), file["name"]).otherwise(place(file["name"], a["location"]["line"]))
        trace = trim_trace(text)
        trace = F.when(F.try_element_at(trace, F.lit(1)) == first_line(text), F.slice(trace, 2, 1 << 20)).otherwise(trace)
        return failure(a["fullName"], loc, first_line(text), trace)

    failed_in = lambda f: F.filter(F.coalesce(f["assertionResults"], F.array()), lambda a: a["status"] == "failed")

    def suite(f: Column) -> Column:
        text = F.filter(F.transform(F.split(strip_escapes(F.coalesce(f["message"], F.lit(""))), r"\r?\n"), lambda l: F.trim(l)), lambda l: (l != "") & ~l.startswith("●"))
        return failure(f["name"], f["name"], F.coalesce(F.try_element_at(text, F.lit(1)), F.lit("test suite failed to run")), F.slice(text, 2, 1 << 20))

    def in_file(f: Column) -> Column:
        tests = F.transform(failed_in(f), lambda a: one(f, a)).cast(f"array<{FAILURE}>")
        return F.when((f["status"] == "failed") & (F.size(failed_in(f)) == 0), F.array(suite(f)).cast(f"array<{FAILURE}>")).otherwise(tests)

    files = F.coalesce(F.col("r.testResults"), F.array())
    suites = F.size(F.filter(files, lambda f: (f["status"] == "failed") & (F.size(failed_in(f)) == 0)))
    found = F.flatten(F.transform(files, in_file))
    missing = F.greatest(F.lit(0), F.coalesce(F.col("r.numRuntimeErrorTestSuites"), F.lit(0)) - suites)
    lost = F.when(missing > 0, F.array(failure(F.lit("(suites)"), F.lit(""), F.concat(missing.cast("string"), F.lit(" test suite(s) failed to run (see raw_log)")))).cast(f"array<{FAILURE}>")).otherwise(F.array().cast(f"array<{FAILURE}>"))
    known = F.concat(found, lost)
    silent = (F.col("r.success") == F.lit(False)) & (F.size(known) == 0)
    run = F.array(failure(F.lit("(run)"), F.lit(""), F.lit(f"{runner} reported success: false with no failed test (see raw_log)"))).cast(f"array<{FAILURE}>")
    failed = F.col("r.numFailedTests") + suites + missing + F.coalesce(silent, F.lit(False)).cast("int")
    end = F.aggregate(files, F.lit(0.0), lambda a, f: F.greatest(a, F.coalesce(f["endTime"], F.lit(0.0))))
    return report(d, runner, F.col("r.numTotalTests"), F.col("r.numPassedTests"), failed, F.col("r.numPendingTests") + F.coalesce("r.numTodoTests", F.lit(0)), F.greatest(F.lit(0.0), (end - F.col("r.startTime")) / 1000), F.when(silent, run).otherwise(known))


def rspec(runs: DataFrame) -> DataFrame:
    d = runs.withColumn("r", F.from_json(json_part("text"), RSPEC)).where("r.summary is not null")
    s = F.col("r.summary")

    def one(e: Column) -> Column:
        loc = place(F.regexp_replace(e["file_path"], r"^\./", ""), e["line_number"])
        lines = F.filter(F.transform(F.split(F.coalesce(e["exception"]["message"], F.lit("")), r"\r?\n"), lambda l: F.trim(l)), lambda l: l != "")
        msg = F.when(e["exception"].isNull(), "").otherwise(F.concat(e["exception"]["class"], F.lit(": "), F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))))
        trace = F.filter(F.coalesce(e["exception"]["backtrace"], F.array().cast("array<string>")), lambda l: ~l.rlike("/gems/|/rspec-core/|bin/rspec"))
        return failure(e["full_description"], loc, msg, F.transform(trace, lambda l: F.trim(l)))

    def outside(m: Column, i: Column) -> Column:
        lines = F.filter(F.transform(F.split(m, r"\r?\n"), lambda l: F.trim(l)), lambda l: l != "")
        name = F.when(F.size("r.messages") > 1, F.concat(F.lit("errors outside of examples #"), (i + 1).cast("string"))).otherwise("errors outside of examples")
        return failure(name, F.lit(""), F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), F.slice(lines, 2, 1 << 20))

    tests = F.transform(F.filter(F.col("r.examples"), lambda e: e["status"] == "failed"), one).cast(f"array<{FAILURE}>")
    more = F.coalesce(F.transform(F.col("r.messages"), outside).cast(f"array<{FAILURE}>"), F.array().cast(f"array<{FAILURE}>"))
    passed = F.greatest(F.lit(0), s["example_count"] - s["failure_count"] - s["pending_count"])
    return report(d, "rspec", s["example_count"], passed, s["failure_count"] + F.coalesce(s["errors_outside_of_examples_count"], F.lit(0)), s["pending_count"], s["duration"], F.concat(tests, more))


def xcresult(runs: DataFrame) -> DataFrame:
    """Summaries of Xcode results; those with no test, or a failure none shows, give no row."""
    d = runs.withColumn("r", F.from_json(json_part("text"), XCRESULT)).where("r.totalTestCount > 0 and (r.failedTests > 0 or coalesce(r.result, '') <> 'Failed')")

    def one(f: Column) -> Column:
        tail = F.when(F.coalesce(f["testIdentifierString"], F.lit("")) == "", f["testName"]).otherwise(f["testIdentifierString"])
        return failure(F.when(F.coalesce(f["targetName"], F.lit("")) == "", tail).otherwise(F.concat(f["targetName"], F.lit("."), tail)), F.lit(""), f["failureText"])

    failures = F.transform(F.coalesce("r.testFailures", F.array()), one)
    return report(d, "xcodebuild-test", F.col("r.totalTestCount"), F.col("r.passedTests"), F.col("r.failedTests"), F.col("r.skippedTests"), F.greatest(F.lit(0.0), F.col("r.finishTime") - F.col("r.startTime")), failures)


def go_events(runs: DataFrame) -> DataFrame:
    """(run_id, pos, event fields): the lines of ``go test -json``."""
    lines = to_lines(runs, "text", "run_id").withColumnRenamed("doc_id", "run_id").where(F.trim("line").startswith("{"))
    return lines.select("run_id", "pos", F.from_json(F.trim("line"), GO).alias("e")).where("e.Action is not null").select("run_id", "pos", "e.*")


def go_test(events: DataFrame) -> DataFrame:
    """Reports from event rows.

    Events are dealt by run and package once; tests, their packages and their
    ancestors are then read by windows within a package, and one row per run
    remains. What builds printed is joined to that row.
    """
    package = W.partitionBy("run_id", "Package")
    is_test, ended = F.col("Test").isNotNull(), F.col("Action").isin("pass", "fail", "skip")
    failed = F.col("Action") == "fail"
    own = events.where(~F.col("Action").startswith("build-")).repartition("run_id", "Package")
    rows = own.groupBy("run_id", "Package", "Test").agg(
        F.collect_list(F.when(is_test & ended, F.struct("pos", "Action"))).alias("ends"), F.collect_list(F.when(is_test & (F.col("Action") == "run"), F.col("pos"))).alias("begins"),
        F.array_sort(F.collect_list(F.when(F.col("Output").isNotNull(), F.struct("pos", "Output")))).alias("said"), F.max(failed.cast("int")).alias("failed"),
        F.max(F.when(F.col("Action").isin("pass", "fail"), F.col("Elapsed"))).alias("seconds"), F.max(F.when(failed, F.col("FailedBuild"))).alias("build"),
        F.max(F.coalesce(F.col("Output").rlike(BUILD_MARKS), F.lit(False)).cast("int")).alias("marked"), F.min("pos").alias("pos"),
    )
    whole = F.col("Test").isNull()
    rows = rows.withColumn("broken", F.max(F.when(whole, F.col("failed"))).over(package) == 1)
    # a test of a broken package that never ended failed; others that never ended do not count
    hung = (F.size("ends") == 0) & F.col("broken")
    lost = F.transform("begins", lambda p: F.struct(p.alias("pos"), F.lit("fail").alias("Action")))
    rows = rows.withColumn("ends", F.when(hung, lost).otherwise(F.col("ends"))).where(whole | (F.size("ends") > 0))
    # slashes first: what follows a test in this order is below it, if anything is
    after = F.lead("Test").over(package.orderBy(F.translate("Test", "/", "\x01")))
    rows = rows.withColumn("leaf", ~whole & ~F.coalesce(after.startswith(F.concat("Test", F.lit("/"))), F.lit(False)))
    text = F.array_join(F.transform("said", lambda x: x["Output"]), "")
    of = lambda a: F.filter("ends", lambda e: e["Action"] == a)
    name = F.substring_index("Package", "/", -1)
    entry = lambda kind, pos, id_, build: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), id_.alias("id"), text.alias("text"), build.alias("build"), F.col("Package").alias("package"))
    none = F.lit(None).cast("string")
    bad = F.when(F.col("leaf"), F.transform(of("fail"), lambda e: entry(0, e["pos"], F.concat(name, F.lit("."), "Test"), none)))
    rows = rows.withColumn("bad", bad).withColumn("has", F.max(F.size("bad")).over(package) > 0)
    lone = whole & (((F.col("failed") == 1) & ~F.coalesce("has", F.lit(False))) | (F.col("marked") == 1))
    rows = rows.withColumn("found", F.when(lone, F.array(entry(1, F.col("pos"), name, F.col("build")))).otherwise(F.col("bad")))
    many = lambda a: F.sum(F.when(F.col("leaf"), F.size(of(a))).otherwise(0))
    runs = rows.groupBy("run_id").agg(many("pass").alias("p"), many("fail").alias("f"), many("skip").alias("s"), F.count_if(lone).alias("lone"), F.max(F.when(whole, F.col("seconds"))).alias("seconds"), F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    # builds are few: what they printed, by name, and by package
    built = events.where(F.col("Action").startswith("build-") & F.col("Output").isNotNull()).groupBy("run_id", "ImportPath").agg(F.array_sort(F.collect_list(F.struct("pos", "Output"))).alias("o"))
    built = built.select("run_id", "ImportPath", F.array_join(F.transform("o", lambda x: x["Output"]), "").alias("o"))
    entries = lambda key: F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col(key).alias("k"), F.col("o").alias("v")))))
    first = F.min_by("o", "ImportPath").over(W.partitionBy("run_id", "stem"))
    stems = built.withColumn("stem", T.strip_variant("ImportPath")).withColumn("o", first).groupBy("run_id").agg(entries("stem").alias("by_stem"))
    d = runs.join(built.groupBy("run_id").agg(entries("ImportPath").alias("by_name")).join(stems, "run_id"), "run_id", "full").fillna(0, ["p", "f", "s", "lone"])
    said = lambda x: F.coalesce(F.try_element_at("by_name", x["build"]), F.when(x["kind"] == 1, F.try_element_at("by_stem", x["package"])), F.lit(""))
    d = d.withColumn("found", F.transform(F.coalesce("found", F.array()), lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"), F.concat(said(x), x["text"]).alias("text"))))

    def explain(frames):
        for f in frames:
            told = [[dict(zip(("id", "loc", "msg", "trace"), (x["id"], *_go_failure(x["text"] or "", x["kind"] == 0)))) for x in found] for found in f["found"]]
            yield f.drop(columns="found").assign(failures=told)

    kinds = dict(d.dtypes)
    d = d.select("run_id", "p", "f", "s", "lone", "seconds", "found").mapInPandas(explain, f"run_id {kinds['run_id']}, p long, f long, s long, lone long, seconds double, failures array<{FAILURE}>")
    return report(d, "go-test", F.col("p") + F.col("f") + F.col("s") + F.col("lone"), F.col("p"), F.col("f") + F.col("lone"), F.col("s"), F.col("seconds"), F.col("failures"))


# --- free text, in Python ---

_GO_FRAME, _GO_PLACE = re.compile(GO_FRAME), re.compile(GO_PLACE)
_GO_STATUS = re.compile(r"=== |--- |PASS$|FAIL$|FAIL\t|ok\s|exit status|#")


def _go_failure(text: str, test: bool) -> tuple[str, str, list[str]]:
    """(loc, msg, trace) of what a failed Go test, or package, printed."""
    lines = text.split("\n")
    frames = {i: m for i, x in enumerate(lines) if (m := _GO_FRAME.match(x))}
    roots = [m[1][: m[1].index("/src/") + 5] for m in frames.values() if re.search("/src/(?:runtime|testing)/", m[1])]
    inner = {i for i, m in frames.items() if m[1] == "_testmain.go" or (roots and m[1].startswith(roots[0]))}
    heads = {i - 1 for i in inner if i - 1 not in frames and i and not lines[i - 1].startswith("\t")}
    useful = [x.strip() for i, x in enumerate(lines) if i not in inner and i not in heads]
    useful = [x for x in useful if x and not _GO_STATUS.match(x)]
    if not test:
        return "", useful[0] if useful else "", useful[1:]
    panic = next((i for i, x in enumerate(lines) if x.strip().startswith("panic: ")), None)
    place_ = next((m for x in lines[:panic] if (m := _GO_PLACE.match(x.strip()))), None)
    loc, msg = (f"{place_[1]}:{place_[2]}", place_[3].strip()) if place_ else ("", "")
    if panic is not None:
        msg = lines[panic].strip().removesuffix(" [recovered]")
        own = next((m for i, m in frames.items() if i > panic and i not in inner and i - 1 not in frames and not lines[i - 1].startswith("created by ")), None)
        loc = f"{own[1].rsplit('/', 1)[-1]}:{own[2]}" if own else loc
    return loc, msg, useful


_EXCEPTION = re.compile(r"^[A-Za-z_][A-Za-z0-9_.]*(Error|Exception|Failure|Exit|Interrupt)\b")


def _useful(text: str) -> list[str]:
    out, skip = [], False
    for line in (x.strip() for x in text.splitlines()):
        if re.match(FRAME, line):
            skip = bool(re.search(NOISE, line))
        if line and not re.fullmatch(r"[\^~ ]+", line) and line not in ("Traceback (most recent call last):", "???") and (not skip or line.startswith("E ")):
            out.append(line)
    return out


def _report(runner, total, passed, failed, skipped, seconds, failures):
    return {"runner": runner, "total": total, "passed": passed, "failed": failed, "skipped": skipped, "duration_s": round(seconds, 3), "failures": [dict(zip(("id", "loc", "msg", "trace"), f)) for f in failures]}


def parse_unittest(text: str) -> dict | None:
    ran = re.search(r"Ran (\d+) tests? in ([0-9.]+)s", text)
    if not ran:
        return None
    after = re.search(r"(?m)^(?:OK|FAILED)\s*(?:\(([^)]*)\))?", text[ran.end() :])
    said = dict(p.strip().split("=") for p in (after[1] or "").split(",") if "=" in p) if after else {}
    n = lambda k: int(said.get(k, 0))
    failures = []
    for block in text[: ran.start()].split("=" * 70):
        head = re.search(r"(?m)^(FAIL|ERROR|UNEXPECTED SUCCESS): (\S+) \(([^)]+)\)", block)
        if not head:
            continue
        if head[1] == "UNEXPECTED SUCCESS":
            failures.append((head[3], "", "unexpected success (test marked @expectedFailure passed)", []))
            continue
        places = [m for m in re.findall(r'File "([^"]+)", line (\d+)', block) if "site-packages" not in m[0] and "/unittest/" not in m[0]]
        lines = block.splitlines()
        at = next((i for i, x in enumerate(lines) if _EXCEPTION.match(x.strip())), None)
        last = next((x for x in reversed(lines) if x.strip() and not x.strip().startswith("-")), "")
        msg = (lines[at] if at is not None else last).strip()
        upto = lines[: at + 1] if at is not None else lines
        start = next((i for i, x in enumerate(upto) if x.startswith("Traceback (most recent call last):")), 0)
        trace = _useful("\n".join(upto[start:]))
        if trace and trace[-1] == msg:
            trace.pop()
        rest = [x.rstrip() for x in (lines[at + 1 :] if at is not None else []) if x.strip().strip("-")]
        rest = ([x for x in rest if x.startswith(("- ", "+ "))] or rest)[-6:]
        if rest and " : " in rest[-1] and rest[-1].rsplit(" : ", 1)[1] not in msg:
            msg += " : " + rest[-1].rsplit(" : ", 1)[1]
        failures.append((head[3], ":".join(places[-1]) if places else "", msg, trace + rest))
    total, failed = int(ran[1]), n("failures") + n("errors") + n("unexpected successes")
    return _report("unittest", total, max(0, total - failed - n("skipped")), failed, n("skipped"), float(ran[2]), failures)


def _panic(name: str, block: str) -> tuple:
    lines = [x for x in block.splitlines() if x.strip()]
    at = next((i for i, x in enumerate(lines) if "panicked at" in x), None)
    if at is None:
        return name, "", lines[0].strip() if lines else "", []
    where = re.search(r"panicked at (?:'(.*)', )?(\S+?:\d+(?::\d+)?):?$", lines[at].strip())
    rest = [x.strip() for x in lines[at + 1 :] if not x.strip().startswith(("note:", "stack backtrace", "--- "))][:5]
    msg = where[1] if where and where[1] else (rest[0] if rest else "")
    return name, where[2] if where else "", msg, rest[1:] if not (where and where[1]) else rest


def _thread(text: str, name: str) -> str:
    """What a test's thread said when it panicked, from interleaved output."""
    found = re.search(rf"(?m)^thread '{re.escape(name)}'(?: \(\d+\))? panicked at .*\n(?:(?!thread '|test |$).*\n?){{0,5}}", text)
    return found[0] if found else ""


def parse_cargo_test(text: str) -> dict | None:
    found = re.findall(r"test result: (?:ok|FAILED)\. (\d+) passed; (\d+) failed; (\d+) ignored; \d+ measured; \d+ filtered out; finished in ([0-9.]+)s", text)
    if found:
        blocks = re.split(r"(?m)^---- (.+?) stdout ----$", text)
        said = {n: re.split(r"(?m)^(?:failures:|test result:)", b)[0] for n, b in zip(blocks[1::2], blocks[2::2])}
        names = [x.strip() for part in re.findall(r"(?m)^failures:\n((?:    \S.*\n)+)", text + "\n") for x in part.splitlines()]
        names = list(dict.fromkeys([*said, *names]))
        passed, failed, ignored = (sum(int(r[i]) for r in found) for i in range(3))
        said = {n: said.get(n) or _thread(text, n) for n in names}
        return _report("cargo-test", passed + failed + ignored, passed, failed, ignored, sum(float(r[3]) for r in found), [_panic(n, said.get(n, "")) for n in names])
    whole = re.search(r"Summary \[\s*([0-9.]+)s\]\s*\d+ tests? run: (\d+) passed(?: \([^)]*\))?(?:, (\d+) failed)?(?:, (\d+) exec failed)?(?:, (\d+) timed out)?(?:, (\d+) skipped)?", text)
    if not whole:
        return None
    blocks = re.split(r"(?m)^--- (?:STDOUT|STDERR): (.+) ---$", text)
    said: dict[str, str] = {}
    for n, b in zip(blocks[1::2], blocks[2::2]):
        said[n.strip()] = "\n".join(x for x in (said.get(n.strip(), ""), b.strip()) if x)
    names = re.findall(r"(?m)^\s*(?:FAIL|ABORT|SIGSEGV|SIGABRT|TIMEOUT)\s*\[\s*[0-9.]+s\]\s*(\S+ \S+)\s*$", text)
    passed, failed, skipped = int(whole[2]), sum(int(whole[i] or 0) for i in (3, 4, 5)), int(whole[6] or 0)
    return _report("cargo-nextest", passed + failed + skipped, passed, failed, skipped, float(whole[1]), [_panic(n, said.get(n, "")) for n in names])


def parse_xctest(text: str) -> dict | None:
    """Failures and the last ``Executed N tests`` line of an XCTest log."""
    done = re.findall(r"Executed (\d+) tests?, with (?:(\d+) tests? skipped and )?(\d+) failures? \(\d+ unexpected\) in ([0-9.]+)", text)
    if not done:
        return None
    total, skipped, failed, seconds = int(done[-1][0]), int(done[-1][1] or 0), int(done[-1][2]), float(done[-1][3])
    seen: dict[str, tuple] = {}
    for loc, name, msg in re.findall(r"(?m)^(\S[^\n]*?:\d+): error: -?\[?([^\]\n]+?)\]? : (.*)$", text):
        key = ".".join(name.split())
        if key in seen:
            seen[key][3].append(msg)
        else:
            seen[key] = (key, loc, msg, [])
    return _report("xctest", total, max(0, total - failed - skipped), failed, skipped, seconds, list(seen.values()))


TEXT_PARSERS = {"unittest": parse_unittest, "cargo-test": parse_cargo_test, "xctest": parse_xctest}
PARSERS = {"pytest": junit, "jest": jest, "vitest": lambda r: jest(r, "vitest"), "rspec": rspec, "xcodebuild-test": xcresult, "dotnet": trx, "go-test": lambda r: go_test(go_events(r))}
PARSERS |= {name: (lambda r, name=name: junit(r, name)) for name in ("phpunit", "gradle", "maven", "swift-test")}


def register_parser(name: str, parse) -> None:
    """Add a parser: a function of a text that returns a report or None."""
    TEXT_PARSERS[name] = parse


def parse_text(runs: DataFrame, kind: str) -> DataFrame:
    parse = TEXT_PARSERS[kind]

    @F.pandas_udf(REPORT.removeprefix("struct<").removesuffix(">"))
    def run(texts: pd.Series) -> pd.DataFrame:
        got = [parse(t) or {} for t in texts]
        return pd.DataFrame([[g.get(c) for c in COLUMNS[1:]] for g in got], columns=COLUMNS[1:], dtype=object)

    return runs.select("run_id", run("text").alias("r")).where("r.runner is not null").select("run_id", "r.*")


def parse_reports(runs: DataFrame, kind: str) -> DataFrame:
    """Reports of runs (run_id, text) whose outputs are all of one ``kind``."""
    if kind == "pre-commit":
        from .console import pre_commit

        return pre_commit(runs).drop("passthrough")
    return PARSERS[kind](runs) if kind in PARSERS else parse_text(runs, kind)


def sniff(text: str | Column) -> Column:
    """What an output looks like: xctest, xcodebuild, junit, json or null."""
    t = T.col(text)
    xcode = F.array(*(t.contains(x) for x in ("** BUILD FAILED **", "** BUILD SUCCEEDED **", "** TEST FAILED **", "** TEST SUCCEEDED **", "Command line invocation:")))
    return (
        F.when(t.rlike(r"Executed \d+ tests?, with"), "xctest").when(F.exists(xcode, lambda x: x), "xcodebuild")
        .when(t.rlike(r"^\s*(?:<\?xml[^>]*>\s*)?<testsuites?[\s>/]"), "junit").when(T.is_json_document(t), "json")
    )


def items(reports: DataFrame) -> DataFrame:
    """(run_id, idx, id, loc, rule, msg): what differences are taken over."""
    flat = reports.select("run_id", F.posexplode("failures").alias("idx", "f"))
    return flat.select("run_id", "idx", F.col("f.id").alias("id"), F.col("f.loc").alias("loc"), F.lit("").alias("rule"), F.col("f.msg").alias("msg"))
