"""Linter and compiler outputs as diagnostics rows.

Each parser takes runs (run_id, text) and returns a row per diagnostic: run_id,
pos (order in the output), loc, severity, rule, msg. ``summarise`` counts them
per run. JSON is read by expressions; a text that is not the tool's JSON gives
no rows (see ``malformed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col, is_container
from .ladder import strip_escapes
from .lines import to_lines

# The fields that the tools write.
RUFF = "array<struct<code:string,message:string,filename:string,location:struct<row:bigint,column:bigint>>>"
ESLINT = "array<struct<filePath:string,errorCount:bigint,warningCount:bigint,messages:array<struct<ruleId:string,severity:bigint,message:string,line:bigint,column:bigint>>>>"
SWIFTLINT = "array<struct<character:bigint,file:string,line:bigint,reason:string,rule_id:string,severity:string>>"
MYPY = "struct<file:string,line:bigint,column:bigint,message:string,hint:string,code:string,severity:string>"
GOLANGCI = "struct<Issues:array<struct<FromLinter:string,Text:string,Severity:string,Pos:struct<Filename:string,Line:bigint,Column:bigint>>>>"
CARGO = (
    "struct<reason:string,message:struct<message:string,level:string,code:struct<code:string>,"
    "spans:array<struct<file_name:string,is_primary:boolean,line_start:bigint,column_start:bigint,label:string>>,"
    "children:array<struct<message:string,level:string,spans:array<struct<suggested_replacement:string>>>>>>"
)
TSC = r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.*)$"
TSC_GLOBAL = r"^(error|warning) (TS\d+): (.*)$"
CLANG = r"(?U)^([^\s:][^:]*):(\d+):(\d+): (error|warning): (.*)$"
TOOL_ERROR = r"^(?:(?:ld|ld64\.lld|clang|clang\+\+|swiftc|swift-frontend|swift-driver|xcodebuild): )?error: .+$|^ld: .+$"
MSBUILD = r"^\s*(?:([^\s(][^(]*)\((\d+),(\d+)\)|([^:]+?)) ?: error ([A-Z]+\d+): (.+?)(?: \[[^\]]+\])?$"

OUT = ["run_id", "pos", "loc", "severity", "rule", "msg"]


def first_line(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\A[^\r\n]*", 0)


def place(*parts: Column) -> Column:
    return F.concat_ws(":", *(p.cast("string") for p in parts))


def rows(found: DataFrame, loc: Column, severity: Column, rule: Column, msg: Column) -> DataFrame:
    return found.select("run_id", F.col("pos").cast("long").alias("pos"), loc.alias("loc"), severity.alias("severity"), F.coalesce(rule, F.lit("")).alias("rule"), msg.alias("msg"))


#: Lines at which a JSON document may begin that are tried; fixed.
MAX_STARTS = 20


def json_part(text: str | Column) -> Column:
    """The first JSON object or array that starts at a line and is all of the rest.

    At most ``MAX_STARTS`` lines that could start one are tried; null if none does.
    """
    trimmed = F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")
    lines = F.split(trimmed, "\n")
    starts = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^[{\[]"), i)), lambda i: i.isNotNull())
    rest = lambda i: F.array_join(F.slice(lines, i + 1, F.size(lines)), "\n")
    later = lambda found, i: F.when(found.isNotNull(), found).otherwise(F.when(is_container(rest(i)), rest(i)))
    tried = F.aggregate(F.slice(starts, 1, MAX_STARTS), F.lit(None).cast("string"), later)
    return F.when(is_container(trimmed), trimmed).otherwise(tried)


def malformed(runs: DataFrame) -> DataFrame:
    """Runs whose output has no JSON document."""
    return runs.where(json_part("text").isNull()).select("run_id")


def unknown_severities(runs: DataFrame) -> DataFrame:
    """Runs whose swiftlint output holds a severity that is neither; they have no rows."""
    d = runs.select("run_id", F.explode(F.from_json(json_part("text"), SWIFTLINT)).alias("d"))
    return d.where(~F.coalesce(F.lower("d.severity").isin("error", "warning"), F.lit(False))).select("run_id").distinct()


def ruff(runs: DataFrame) -> DataFrame:
    d = runs.select("run_id", F.posexplode(F.from_json(json_part("text"), RUFF)).alias("pos", "d"))
    return rows(d, place(F.col("d.filename"), F.col("d.location.row"), F.col("d.location.column")), F.lit("error"), F.col("d.code"), first_line(F.col("d.message")))


def eslint(runs: DataFrame) -> DataFrame:
    f = runs.select("run_id", F.posexplode(F.from_json(json_part("text"), ESLINT)).alias("i", "f"))
    d = f.select("run_id", "i", F.col("f.filePath").alias("file"), F.posexplode("f.messages").alias("j", "d"))
    d = d.withColumn("pos", F.col("i").cast("long") * 1_000_000 + F.col("j"))
    severity = F.when(F.col("d.severity") == 2, "error").otherwise("warning")
    return rows(d, place(F.col("file"), F.col("d.line"), F.col("d.column")), severity, F.col("d.ruleId"), first_line(F.col("d.message")))


def eslint_summary(runs: DataFrame) -> DataFrame:
    """Totals come from the files' own counts."""
    f = runs.select("run_id", F.explode_outer(F.from_json(json_part("text"), ESLINT)).alias("f"))
    total = lambda c: F.coalesce(F.sum(f"f.{c}"), F.lit(0))
    return f.groupBy("run_id").agg(F.lit("eslint").alias("runner"), total("errorCount").alias("errors"), total("warningCount").alias("warnings"), F.count("f").alias("files"))


def swiftlint(runs: DataFrame, strict: bool = False) -> DataFrame:
    d = runs.select("run_id", F.posexplode(F.from_json(json_part("text"), SWIFTLINT)).alias("pos", "d"))
    found = F.lower("d.severity")
    severity = F.when(found == "error", "error").when(found == "warning", "error" if strict else "warning")
    # one unknown severity makes the run's whole output unreadable, but no other run's
    bad = F.max(severity.isNull().cast("int")).over(W.partitionBy("run_id"))
    d = d.withColumn("_bad", bad).where("_bad = 0")
    return rows(d, place(F.col("d.file"), F.col("d.line"), F.col("d.character")), severity, F.col("d.rule_id"), first_line(F.col("d.reason")))


def mypy(runs: DataFrame) -> DataFrame:
    lines = to_lines(runs, "text", "run_id").withColumnRenamed("doc_id", "run_id").where(F.trim("line").startswith("{"))
    d = lines.select("run_id", "pos", F.from_json(F.trim("line"), MYPY).alias("d")).where("d.file is not null and d.severity is not null")
    loc = F.when((F.col("d.line") < 0) | (F.col("d.column") < 0), F.col("d.file")).otherwise(place(F.col("d.file"), F.col("d.line"), F.col("d.column") + 1))
    hint = F.when(first_line(F.col("d.hint")) != "", F.concat(F.lit(" ("), first_line(F.col("d.hint")), F.lit(")"))).otherwise("")
    return rows(d, loc, F.col("d.severity"), F.col("d.code"), F.concat(first_line(F.col("d.message")), hint))


def golangci(runs: DataFrame) -> DataFrame:
    """The first JSON value of the output; text may follow it on later lines."""
    text = F.regexp_extract("text", r"(?s)\{.*", 0)
    one = F.coalesce(F.when(F.try_parse_json(text).isNotNull(), text), F.regexp_extract("text", r"(\{[^\r\n]*)", 1))
    d = runs.select("run_id", F.posexplode(F.from_json(one, GOLANGCI)["Issues"]).alias("pos", "d"))
    found = F.lower(F.coalesce("d.Severity", F.lit("")))
    severity = F.when(found.isin("warning", "warn"), "warning").when(found.isin("info", "hint", "note"), "info").otherwise("error")
    line, column = F.coalesce("d.Pos.Line", F.lit(0)), F.coalesce("d.Pos.Column", F.lit(0))
    loc = F.when(line == 0, F.col("d.Pos.Filename")).when(column == 0, place(F.col("d.Pos.Filename"), line)).otherwise(place(F.col("d.Pos.Filename"), line, column))
    return rows(d, loc, severity, F.col("d.FromLinter"), first_line(F.col("d.Text")))


def cargo(runs: DataFrame) -> DataFrame:
    """Compiler messages; the first of equal (loc, rule, text) stays."""
    lines = to_lines(runs, "text", "run_id").withColumnRenamed("doc_id", "run_id").where(F.trim("line").startswith("{"))
    # most lines are of other kinds and need no parsing
    lines = lines.where(F.col("line").contains("compiler-message"))
    d = lines.select("run_id", "pos", F.from_json(F.trim("line"), CARGO).alias("d")).where("d.reason = 'compiler-message' and d.message.level in ('error', 'warning')")
    d = d.select("run_id", "pos", F.col("d.message").alias("m")).withColumn("text", first_line(F.col("m.message")))
    d = d.where(~F.col("text").startswith("aborting due to") & ~F.col("text").rlike(r"^\d+ warnings? emitted"))
    span = F.coalesce(F.try_element_at(F.filter("m.spans", lambda s: s["is_primary"]), F.lit(1)), F.try_element_at("m.spans", F.lit(1)))
    d = d.withColumn("span", span).withColumn("loc", F.when(span.isNull(), "").otherwise(place(span["file_name"], span["line_start"], span["column_start"])))
    d = d.withColumn("rule", F.coalesce("m.code.code", F.lit("")))
    first = d.groupBy("run_id", "loc", "rule", "text").agg(F.min_by(F.struct("pos", "m", "span"), "pos").alias("d"))
    label = first["d"]["span"]["label"]
    shown = F.when(F.coalesce(label, F.lit("")).isin("") | (label == F.col("text")), "").otherwise(F.concat(F.lit(" ("), label, F.lit(")")))

    def aside(c: Column) -> Column:
        head = F.trim(first_line(c["message"]))
        new = F.filter(F.transform(c["spans"], lambda s: s["suggested_replacement"]), lambda r: r.isNotNull() & (r != "") & ~r.contains("\n"))
        fix = F.when(F.size(new) == 1, F.concat(F.lit(": `"), F.try_element_at(new, F.lit(1)), F.lit("`"))).otherwise("")
        return F.when((head != "") & ~head.endswith("on by default") & ~head.startswith("for further information visit"), F.concat(F.lit("; "), c["level"], F.lit(": "), head, fix)).otherwise("")

    asides = F.array_join(F.transform(F.filter(F.coalesce(first["d"]["m"]["children"], F.array()), lambda c: c["level"].isin("help", "note")), aside), "")
    level = first["d"]["m"]["level"]
    msg = F.when(level == "error", F.concat("text", shown, asides)).otherwise(F.col("text"))
    return rows(first.withColumn("pos", first["d"]["pos"]), F.col("loc"), level, F.col("rule"), msg)


def tsc(runs: DataFrame) -> DataFrame:
    """Indented lines go on with the message of the diagnostic before them."""
    lines = to_lines(runs, "text", "run_id").withColumnRenamed("doc_id", "run_id")
    more = F.col("line").startswith(" ") & (F.trim("line") != "")
    placed = ~more & F.col("line").rlike(TSC)
    general = ~more & ~placed & F.col("line").rlike(TSC_GLOBAL)
    lines = lines.withColumn("starts", placed | general).where(F.col("starts") | more)
    lines = lines.withColumn("n", F.sum(F.col("starts").cast("int")).over(W.partitionBy("run_id").orderBy("pos"))).where("n > 0")
    part = lambda i, j: F.when(F.col("line").rlike(TSC), F.regexp_extract("line", TSC, i)).otherwise(F.regexp_extract("line", TSC_GLOBAL, j))
    loc = F.when(F.col("line").rlike(TSC), place(*(F.regexp_extract("line", TSC, i) for i in (1, 2, 3)))).otherwise("")
    text = F.when(F.col("starts"), part(6, 3)).otherwise(F.trim("line"))
    d = lines.select("run_id", "n", "pos", "starts", loc.alias("loc"), part(4, 1).alias("severity"), part(5, 2).alias("rule"), text.alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "t")))
    d = d.groupBy("run_id", "n").agg(F.min("pos").alias("pos"), F.min_by("loc", "pos").alias("loc"), F.min_by("severity", "pos").alias("severity"), F.min_by("rule", "pos").alias("rule"), F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("msg"))
    return rows(d, F.col("loc"), F.col("severity"), F.col("rule"), F.col("msg"))


def clang(runs: DataFrame) -> DataFrame:
    """One-line compiler diagnostics, as Swift and Xcode builds print them."""
    lines = to_lines(runs.select("run_id", strip_escapes("text").alias("text")), "text", "run_id").withColumnRenamed("doc_id", "run_id")
    part = lambda i: F.regexp_extract("line", CLANG, i)
    d = lines.where(F.col("line").rlike(CLANG) & part(1).rlike(r"[/\\.]"))
    return rows(d, place(part(1), part(2), part(3)), part(4), F.lit(None).cast("string"), part(5))


def tool_errors(runs: DataFrame) -> DataFrame:
    """Errors of linkers and drivers, each line once."""
    lines = to_lines(runs.select("run_id", strip_escapes("text").alias("text")), "text", "run_id").withColumnRenamed("doc_id", "run_id")
    lines = lines.withColumn("line", F.rtrim("line"))
    d = lines.where(F.col("line").rlike(TOOL_ERROR) & ~F.col("line").startswith("ld: warning:"))
    d = d.groupBy("run_id", "line").agg(F.min("pos").alias("pos"))
    return rows(d, F.lit(""), F.lit("error"), F.lit(None).cast("string"), F.col("line"))


def build_report(runs: DataFrame) -> DataFrame:
    """Compiler diagnostics; for failed runs (exit) without errors, tool errors too."""
    found = clang(runs)
    explained = found.where("severity = 'error'").select("run_id").distinct()
    silent = runs.where("exit <> 0").join(explained, "run_id", "left_anti")
    return found.unionByName(tool_errors(silent))


def msbuild(runs: DataFrame) -> DataFrame:
    lines = to_lines(runs, "text", "run_id").withColumnRenamed("doc_id", "run_id").withColumn("line", F.rtrim("line"))
    part = lambda i: F.regexp_extract("line", MSBUILD, i)
    d = lines.where(F.col("line").rlike(MSBUILD))
    loc = F.when(part(1) != "", place(part(1), part(2), part(3))).otherwise("")
    return rows(d, loc, F.lit("error"), part(5), F.concat(part(5), F.lit(": "), part(6)))


PARSERS = {"ruff": ruff, "eslint": eslint, "swiftlint": swiftlint, "mypy": mypy, "golangci-lint": golangci, "cargo": cargo, "tsc": tsc, "swift-build": clang, "xcodebuild-build": clang, "dotnet-build": msbuild}


def summarise(found: DataFrame, runs: DataFrame, runner: str) -> DataFrame:
    """A row per run: runner, errors, warnings; runs without diagnostics too.

    Severities that are neither count as warnings for golangci-lint alone.
    """
    loose = runner == "golangci-lint"
    warns = F.col("severity") != "error" if loose else F.col("severity") == "warning"
    counts = found.groupBy("run_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(warns).alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return runs.select("run_id").join(counts, "run_id", "left").select("run_id", F.lit(runner).alias("runner"), zero("errors"), zero("warnings"))
