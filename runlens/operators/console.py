"""What only a tool's console tells: failures, causes and output of tests.

Consoles are rows (run_id, text). Their lines are read as frames; blocks are
islands between the lines that open or close them. Reports (see ``reports``) are
completed by joins on run_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .diagnostics import build_report, place
from .ladder import strip_escapes
from .lines import to_lines
from .reports import FAILURE, failure, strip

# What the tools print.
BANNER = r"^!{3,} (.+?) !{3,}$"
COVERAGE = "FAIL Required test coverage"
JAVAC = r"^([^\s:][^:]*\.(?:java|groovy|scala)):(\d+): error: (.+)$"
KOTLINC = r"^e: (?:file://)?(\S+?\.kts?):(\d+):(\d+) (.+)$"
KOTLINC_OLD = r"^e: (\S+?\.kts?): \((\d+), (\d+)\): (.+)$"
WENT_WRONG = "* What went wrong:"
FAILING_TESTS = r"There were failing tests"
MAVEN = r"^\[ERROR\] (?:file://)?([^\s\[][^\[]*?\.(?:java|kt|groovy|scala)):\[(\d+),(\d+)\] (.+)$"
MAVEN_GOAL = r"^\[ERROR\] (Failed to execute goal .+)$"
MAVEN_TESTS = r"There (?:are|were) test failures"
BUILD_ID, RUN_ID, UNHANDLED_ID = "(build)", "(run)", "(unhandled error)"
CONSOLE_HEAD = r"^(stdout|stderr) \| (\S+)(?: > (.+))?$"
RULE = "⎯"
HOOK = r"^(.+?)\.{3,}(?:\([^)]*\))?(Passed|Failed|Skipped)\s*$"
REAL_DIAGNOSTIC = r"^(?:warning|error)(?:\[|:)"
CARGO_TRAILER = r"^error: test failed, to rerun|^error: .* targets failed:$"
CONSOLE_LINES, HOOK_LINES = 10, 20

NO_TRACE = "array<string>"


def console_lines(consoles: DataFrame) -> DataFrame:
    """(run_id, pos, line) without escapes and trailing blanks."""
    rows = to_lines(consoles.select("run_id", strip_escapes("text").alias("text")), "text", "run_id")
    return rows.select(F.col("doc_id").alias("run_id"), "pos", F.regexp_replace("line", r"(?U)\s+$", "").alias("line"))


def in_run() -> W:
    return W.partitionBy("run_id").orderBy("pos")


def so_far() -> W:
    return in_run().rowsBetween(W.unboundedPreceding, 0)


def add_failures(reports: DataFrame, found: DataFrame, counted: bool) -> DataFrame:
    """Reports with further failures (run_id, pos, id, loc, msg, trace) at the
    end; ``counted``: they also raise the number of failed ones."""
    entry = F.struct("pos", failure(F.col("id"), F.col("loc"), F.col("msg"), F.col("trace")).alias("f"))
    more = found.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["f"]).alias("_more"))
    rows = reports.join(more, "run_id", "left")
    none = F.array().cast(f"array<{FAILURE}>")
    extra = F.coalesce(F.col("_more").cast(f"array<{FAILURE}>"), none)
    failed = F.col("failed") + (F.size(extra) if counted else 0)
    return rows.withColumns({"failed": failed.cast("long"), "failures": F.concat("failures", extra)}).select(*reports.columns)


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


def pytest_session(reports: DataFrame, consoles: DataFrame) -> DataFrame:
    """Reports with what stopped a session and unmet coverage as failures.

    A banner that failed tests already explain (a stop after so many, errors
    during collection) adds nothing.
    """
    lines = console_lines(consoles)
    reason = F.regexp_extract("line", BANNER, 1)
    said = lines.withColumn("reason", reason).where((F.col("reason") != "") | F.col("line").startswith(COVERAGE))
    said = said.join(reports.select("run_id", F.col("failed").alias("_failed")), "run_id")
    collected = F.col("reason").startswith("Interrupted: ") & F.col("reason").contains("during collection")
    explained = (F.col("_failed") > 0) & (collected | F.col("reason").startswith("stopping after "))
    banner = F.col("reason") != ""
    found = said.where(~(banner & explained))
    found = found.select("run_id", "pos", F.when(banner, "(session)").otherwise("(coverage)").alias("id"), F.lit("").alias("loc"), F.when(banner, F.col("reason")).otherwise(F.col("line")).alias("msg"), none_of(NO_TRACE).alias("trace"))
    return add_failures(reports, found, counted=True)


def gradle_failures(consoles: DataFrame) -> DataFrame:
    """(run_id, pos, loc, msg): compiler errors, then causes of failed builds."""
    lines = console_lines(consoles)
    line = F.col("line")
    part = lambda p, i: F.regexp_extract("line", p, i)
    compiled = [
        F.when(line.rlike(JAVAC), F.struct(place(part(JAVAC, 1), part(JAVAC, 2)).alias("loc"), part(JAVAC, 3).alias("msg"))),
        *(F.when(line.rlike(p), F.struct(place(part(p, 1), part(p, 2), part(p, 3)).alias("loc"), part(p, 4).alias("msg"))) for p in (KOTLINC, KOTLINC_OLD)),
    ]
    errors = lines.withColumn("e", F.coalesce(*compiled)).where("e is not null").select("run_id", F.lit(0).alias("kind"), "pos", "e.loc", "e.msg")
    # a block goes from its title to the next blank line or title
    bare = strip(line)
    lines = lines.withColumn("t", bare)
    opens, ends = F.col("t") == WENT_WRONG, (F.col("t") == "") | F.col("t").startswith("* ")
    blocks = lines.withColumn("n", F.count_if(ends).over(so_far())).withColumn("open", F.max(F.when(opens, F.col("n"))).over(so_far()))
    inside = blocks.where((F.col("open") == F.col("n")) & ~ends)
    parts = F.array_sort(F.collect_list(F.struct("pos", "t")))
    blocks = inside.groupBy("run_id", "n").agg(F.min("pos").alias("pos"), F.transform(parts, lambda x: x["t"]).alias("b"))
    blocks = blocks.where(~F.exists("b", lambda x: x.rlike(FAILING_TESTS)))
    reason = F.try_element_at(F.filter(F.slice("b", F.lit(2), F.size("b")), lambda x: x.startswith("> ")), F.lit(1))
    msg = F.concat(F.col("b")[0], F.coalesce(F.concat(F.lit(" "), F.regexp_replace(reason, "^> ", "")), F.lit("")))
    wrong = blocks.select("run_id", F.lit(1).alias("kind"), "pos", F.lit("").alias("loc"), msg.alias("msg"))
    return errors.unionByName(wrong)


def maven_failures(consoles: DataFrame) -> DataFrame:
    """(run_id, pos, loc, msg): compiler errors and failed goals but for failed tests."""
    line = F.col("line")
    part = lambda p, i: F.regexp_extract("line", p, i)
    placed = F.when(line.rlike(MAVEN), F.struct(place(part(MAVEN, 1), part(MAVEN, 2), part(MAVEN, 3)).alias("loc"), part(MAVEN, 4).alias("msg")))
    goal = F.when(line.rlike(MAVEN_GOAL) & ~line.rlike(MAVEN_TESTS), F.struct(F.lit("").alias("loc"), part(MAVEN_GOAL, 1).alias("msg")))
    rows = console_lines(consoles).withColumn("e", F.coalesce(placed, goal)).where("e is not null")
    return rows.select("run_id", F.lit(0).alias("kind"), "pos", "e.loc", "e.msg")


def add_build_failures(reports: DataFrame, found: DataFrame) -> DataFrame:
    """Reports with build failures (run_id, kind, pos, loc, msg), each once, where
    it came first; they do not raise the number of failed tests."""
    once = found.groupBy("run_id", "loc", "msg").agg(F.min(F.struct("kind", "pos")).alias("pos"))
    return add_failures(reports, once.select("run_id", "pos", F.lit(BUILD_ID).alias("id"), "loc", "msg", none_of(NO_TRACE).alias("trace")), counted=False)


def vitest_unhandled(consoles: DataFrame) -> DataFrame:
    """(run_id, pos, id, loc, msg, trace): errors thrown outside any test.

    Rules part the console; a section of them begins with one titled Unhandled
    Errors and ends with an untitled one. Each other title within it is an error.
    """
    lines = console_lines(consoles).withColumn("t", strip(F.col("line")))
    rule = F.col("t").startswith(RULE)
    title = F.when(rule, F.regexp_replace("t", rf"(?U)^[{RULE}\s]+|[{RULE}\s]+$", ""))
    lines = lines.withColumn("title", title)
    heads = F.col("title").startswith("Unhandled Error")
    before = in_run().rowsBetween(W.unboundedPreceding, -1)
    section = F.last(F.when(heads, F.lit(True)).when(F.col("title") == "", F.lit(False)), ignorenulls=True).over(before)
    opens = F.col("title").isNotNull() & ~heads & (F.col("title") != "") & ~F.col("title").startswith("[") & F.coalesce(section, F.lit(False))
    # a title of the section's own does not close the error before it
    closes = F.col("title").isNotNull() & ~heads
    lines = lines.withColumns({"opens": opens, "n": F.count_if(closes).over(so_far())})
    named = F.max(F.when(F.col("opens"), F.struct("n", "title", "pos"))).over(so_far())
    lines = lines.withColumn("error", named).where((F.col("error.n") == F.col("n")) & (F.col("title").isNull() | F.col("opens")) & (F.col("t") != ""))
    said = F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("pos", "t"))))
    found = lines.groupBy("run_id", "error.pos", "error.title").agg(F.transform(said, lambda x: x["t"]).alias("said"))
    own = lambda x: (x.startswith("❯") & ~x.contains("node:internal") & ~x.contains("node_modules")) | x.startswith("This error originated in") | x.startswith("The latest test that might")
    rest = F.filter(F.slice("said", F.lit(2), F.greatest(F.size("said"), F.lit(1))), own)
    return found.select("run_id", "pos", F.lit(UNHANDLED_ID).alias("id"), F.lit("").alias("loc"), F.coalesce(F.try_element_at("said", F.lit(1)), F.lit("")).alias("msg"), F.concat(F.array("title"), rest).alias("trace"))


def add_unhandled(reports: DataFrame, found: DataFrame) -> DataFrame:
    """Reports with unhandled errors, which stand for a run that failed without a reason."""
    has = found.select("run_id").distinct().withColumn("_has", F.lit(True))
    rows = reports.join(has, "run_id", "left")
    kept = F.filter("failures", lambda f: ~(F.coalesce(F.col("_has"), F.lit(False)) & (f["id"] == RUN_ID)))
    gone = F.size("failures") - F.size(kept)
    rows = rows.withColumns({"failed": F.greatest(F.lit(0), F.col("failed") - gone).cast("long"), "failures": kept}).select(*reports.columns)
    return add_failures(rows, found, counted=True)


def explain_run(reports: DataFrame, consoles: DataFrame, prefix: str) -> DataFrame:
    """The message of a failed run without a reason: the first console line that
    starts with ``prefix``."""
    said = console_lines(consoles).withColumn("t", strip(F.col("line"))).where(F.col("t").startswith(prefix))
    first = said.groupBy("run_id").agg(F.min_by("t", "pos").alias("_why"))
    rows = reports.join(first, "run_id", "left")
    told = F.transform("failures", lambda f: F.when((f["id"] == RUN_ID) & F.col("_why").isNotNull(), failure(f["id"], f["loc"], F.col("_why"), f["trace"])).otherwise(f))
    return rows.withColumn("failures", told.cast(f"array<{FAILURE}>")).select(*reports.columns)


def vitest_console(consoles: DataFrame) -> DataFrame:
    """(run_id, pos, file, test, line): what tests printed, up to a blank line."""
    lines = console_lines(consoles)
    head = F.col("line").rlike(CONSOLE_HEAD)
    blank = ~F.col("line").rlike(r"(?U)\S")
    lines = lines.withColumns({"head": head, "n": F.count_if(head | blank).over(so_far())})
    opened = F.max(F.when(F.col("head"), F.struct("n", "line"))).over(so_far())
    rows = lines.withColumn("by", opened).where((F.col("by.n") == F.col("n")) & ~F.col("head") & F.col("line").rlike(r"(?U)\S"))
    part = lambda i: F.regexp_extract("by.line", CONSOLE_HEAD, i)
    return rows.select("run_id", "pos", part(2).alias("file"), F.when(part(3) != "", part(3)).alias("test"), F.concat(F.lit("console: "), strip(F.col("line"))).alias("line"))


def add_console(reports: DataFrame, printed: DataFrame) -> DataFrame:
    """What a failed test printed, behind its trace: tests are joined by name, as
    written or with blanks for arrows, in the file that the console names."""
    flat = reports.select("run_id", F.posexplode("failures").alias("idx", "f"))
    names = printed.where("test is not null").withColumn("id", F.explode(F.array_distinct(F.array("test", F.replace("test", F.lit(" > "), F.lit(" "))))))
    both = flat.withColumn("id", F.col("f.id")).join(names, ["run_id", "id"])
    where, short = T.file_of("f.loc"), F.regexp_replace("file", r"^(?:\./)+", "")
    both = both.where((where == F.col("file")) | where.endswith(F.concat(F.lit("/"), short)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    said = both.groupBy("run_id", "idx").agg(lines.alias("said"))
    more = F.size("said") - CONSOLE_LINES
    marker = F.concat(F.lit("… +"), more.cast("string"), F.lit(" console lines omitted (see raw_log)"))
    said = said.withColumn("said", F.when(more > 0, F.concat(F.slice("said", 1, CONSOLE_LINES), F.array(marker))).otherwise(F.col("said")))
    by_run = said.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "said"))).alias("_said"))
    rows = reports.join(by_run, "run_id", "left")
    longer = F.transform("failures", lambda f, i: failure(f["id"], f["loc"], f["msg"], F.concat(f["trace"], F.coalesce(F.try_element_at("_said", i), none_of(NO_TRACE)))))
    return rows.withColumn("failures", F.when(F.col("_said").isNull(), F.col("failures")).otherwise(longer.cast(f"array<{FAILURE}>"))).select(*reports.columns)


def has_real_diagnostic(text: str | Column) -> Column:
    """Whether a console shows a compiler's warning or error, not just that tests failed."""
    return F.exists(F.split(T.col(text), r"\r?\n"), lambda x: x.rlike(REAL_DIAGNOSTIC) & ~x.rlike(CARGO_TRAILER))


def build_fallback(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Diagnostics (run_id, pos, loc, severity, rule, msg) of failed runs (run_id,
    text, exit) without a report, if their console shows an error: they did not
    build. Other runs have no rows; their output is shown as it is."""
    lost = runs.where("exit <> 0").join(reports.select("run_id"), "run_id", "left_anti")
    found = build_report(lost)
    return found.join(found.where("severity = 'error'").select("run_id").distinct(), "run_id", "left_semi")


def hooks(consoles: DataFrame) -> DataFrame:
    """(run_id, pos, name, status, said) of pre-commit: what follows a status line
    up to the next belongs to its hook."""
    lines = console_lines(consoles).withColumn("head", F.col("line").rlike(HOOK))
    lines = lines.withColumn("at", F.max(F.when(F.col("head"), F.struct("pos", "line"))).over(so_far())).where("at is not null")
    said = F.array_sort(F.collect_list(F.when(~F.col("head") & F.col("line").rlike(r"(?U)\S"), F.struct("pos", strip(F.col("line")).alias("t")))))
    rows = lines.groupBy("run_id", "at").agg(F.transform(said, lambda x: x["t"]).alias("said"))
    return rows.select("run_id", "at.pos", strip(F.regexp_extract("at.line", HOOK, 1)).alias("name"), F.regexp_extract("at.line", HOOK, 2).alias("status"), "said")


def pre_commit(consoles: DataFrame) -> DataFrame:
    """Reports of pre-commit, and ``passthrough``: in full what hooks said that is
    too long for a trace."""
    rows = hooks(consoles)
    note = lambda x, what: F.regexp_extract(x, f"^- {what}:\\s*(.*)$", 1)
    first = lambda what: F.coalesce(F.array_max(F.transform("said", lambda x: note(x, what))), F.lit(""))
    modified = "- files were modified by this hook"
    said = F.filter("said", lambda x: ~x.rlike("^- (?:hook id|exit code):") & (x != modified))
    rows = rows.withColumns({"loc": first("hook id"), "code": first("exit code"), "touched": F.array_contains("said", modified), "out": said})
    long_ = F.size("out") > HOOK_LINES + 1
    else_ = F.when(F.col("touched"), modified.removeprefix("- ")).when(F.col("code") != "", F.concat(F.lit("exit code "), "code")).otherwise("failed")
    msg = F.coalesce(F.try_element_at("out", F.lit(1)), else_)
    pointer = F.array(F.concat(F.size("out").cast("string"), F.lit(" lines of hook output: full output follows the report")))
    trace = F.when(long_, pointer).otherwise(F.slice("out", F.lit(2), F.greatest(F.size("out"), F.lit(1))))
    full = F.concat(F.lit("--- "), "name", F.lit(" ("), F.when(F.col("loc") == "", F.col("name")).otherwise(F.col("loc")), F.lit("): full output ---\n"), F.array_join("out", "\n"), F.lit("\n"))
    bad = F.col("status") == "Failed"
    rows = rows.select("run_id", "pos", "status", F.when(bad, failure(F.col("name"), F.col("loc"), msg, trace)).alias("f"), F.when(bad & long_, full).alias("full"))
    n = lambda s: F.count_if(F.col("status") == s)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("v"))))), lambda x: x["v"])
    got = rows.groupBy("run_id").agg(F.lit("pre-commit").alias("runner"), F.count(F.lit(1)).alias("total"), n("Passed").alias("passed"), n("Failed").alias("failed"), n("Skipped").alias("skipped"), listed("f").cast(f"array<{FAILURE}>").alias("failures"), F.array_join(listed("full"), "").alias("passthrough"))
    return got.select("run_id", "runner", "total", "passed", "failed", "skipped", F.lit(0.0).alias("duration_s"), "failures", "passthrough")


def locate_sources(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """Failures placed in a bare file get the path of that source file.

    ``sources`` (run_id, path): files of the run's module below its src folder, as
    src/<set>/<language>/<package>/<file>. The package is that of the test's class;
    places without such a file stay as they are.
    """
    flat = reports.select("run_id", F.posexplode("failures").alias("idx", "f"))
    file, owner = T.file_of("f.loc"), F.regexp_extract("f.id", r"^(.*)\.[^.]+$", 1)
    package = F.replace(F.regexp_extract(owner, r"^(.*)\.[^.]+$", 1), F.lit("."), F.lit("/"))
    wanted = flat.where((F.col("f.loc") != "") & ~F.col("f.loc").contains("/")).withColumn("tail", F.concat_ws("/", F.when(package != "", package), file))
    tail = F.regexp_extract("path", r"(?:^|/)src/[^/]+/(?:java|kotlin|groovy|scala)/(.+)$", 1)
    known = sources.withColumn("tail", tail).where("tail <> ''").groupBy("run_id", "tail").agg(F.min("path").alias("path"))
    found = wanted.join(known, ["run_id", "tail"]).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "path"))).alias("_at"))
    rows = reports.join(found, "run_id", "left")
    moved = lambda f, i: F.concat(F.try_element_at("_at", i), F.substr(f["loc"], F.length(T.file_of(f["loc"])) + 1, F.length(f["loc"])))
    placed = F.transform("failures", lambda f, i: failure(f["id"], F.coalesce(moved(f, i), f["loc"]), f["msg"], f["trace"]))
    return rows.withColumn("failures", F.when(F.col("_at").isNull(), F.col("failures")).otherwise(placed.cast(f"array<{FAILURE}>"))).select(*reports.columns)
