"""Reports about archived runs: the list, the last one, what changed since.

Archived runs are rows (id, ts, argv, mode, exit, cwd, stdout_bytes,
stderr_bytes, mtime), stored reports (run_id, kind, runner, failed, total, items,
rendered); items are structs (id, loc, rule, msg).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .render import encoded
from .runs import diff, newest_first

#: Runs that a list shows unless asked for more.
LISTED = 20


def quoted(word: str | Column) -> Column:
    """A word as a shell needs it written."""
    w = T.col(word)
    plain = w.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(plain, w).otherwise(F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def display_command(argv: str | Column) -> Column:
    return F.array_join(F.transform(T.col(argv), quoted), " ")


def matches_command(argv: str | Column, part: str | None) -> Column:
    """Whether a command, as typed or as quoted, contains ``part``."""
    if part is None:
        return F.lit(True)
    return display_command(argv).contains(part) | F.array_join(T.col(argv), " ").contains(part)


def run_ids(runs: DataFrame, at: str = "ts") -> DataFrame:
    """``runs`` with ``id``: the UTC second and four hex digits of a count within it,
    so ids order as times do and no two runs of a second share one (up to 65,536)."""
    stamp = F.date_format(at, "yyyyMMdd-HHmmss")
    rows = runs.withColumn("_s", stamp)
    salt = (F.row_number().over(W.partitionBy("_s").orderBy(at, *[c for c in runs.columns if c != at])) - 1) % 65536
    return rows.withColumn("id", F.concat("_s", F.lit("-"), F.lpad(F.lower(F.hex(salt.cast("long"))), 4, "0"))).drop("_s")


def render_list(metas: DataFrame, part: str | None = None, most: int = LISTED) -> DataFrame:
    """(text): the newest runs as a table."""
    rows = newest_first(metas.where(matches_command("argv", part))).limit(most)
    key = F.struct(F.substring("id", 1, 15).alias("s"), F.coalesce(F.col("mtime").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")).alias("m"), "id")
    entry = F.struct("id", "ts", display_command("argv").alias("cmd"), "mode", "exit")
    listed = rows.agg(F.reverse(F.array_sort(F.collect_list(F.struct(key.alias("k"), entry.alias("e"))))).alias("l"))
    doc = F.to_json(F.struct(F.transform("l", lambda x: x["e"]).alias("runs")))
    return encoded(listed.select(F.lit(0).alias("run_id"), doc.alias("json"))).select("text")


def render_run(runs: DataFrame, stream: str | None = None) -> DataFrame:
    """(id, text) of archived runs with their streams: one stream as it is, or
    what the run was and both."""
    if stream is not None:
        return runs.select("id", F.coalesce(stream, F.lit("")).alias("text"))
    doc = F.to_json(F.struct("id", "ts", F.array_join("argv", " ").alias("cmd"), "mode", "exit"))
    head = encoded(runs.select(F.col("id").alias("run_id"), doc.alias("json"))).select(F.col("run_id").alias("id"), F.col("text").alias("_head"))
    parts = [F.concat(F.lit(f"\n--- {s} ---\n"), F.coalesce(s, F.lit(""))) for s in ("stdout", "stderr")]
    return runs.join(head, "id").select("id", F.concat("_head", *parts).alias("text"))


def with_reports(metas: DataFrame, reports: DataFrame) -> DataFrame:
    """Runs with ``report``, their stored report, or null."""
    stored = reports.select(F.col("run_id").alias("id"), F.struct(*[c for c in reports.columns if c != "run_id"]).alias("report"))
    return metas.join(stored, "id", "left")


def _newest(metas: DataFrame, by: list[str]) -> DataFrame:
    """The newest run of each group."""
    order = W.partitionBy(*by).orderBy(F.desc(F.substring("id", 1, 15)), F.desc("mtime"), F.desc("id"))
    return metas.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def render_last(metas: DataFrame, reports: DataFrame, root: str, part: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., text): the newest matching run of each group as it was printed,
    with its command, exit code and raw log; without a report, a short summary."""
    by = by or []
    last = _newest(metas.where(matches_command("argv", part)).withColumn("_all", F.lit(0)), by or ["_all"])
    rows = with_reports(last, reports)
    raw = F.concat(F.lit(root.rstrip("/") + "/"), "id").alias("raw_log")
    run, command = F.col("id").alias("run"), display_command("argv").alias("command")
    code = F.col("exit").alias("exit_code")
    brief = F.to_json(F.struct(run, command, F.when(F.col("exit") != 0, F.col("exit")).alias("exit_code"), raw))
    note = F.concat(F.lit("no adapter report for this run; its raw log is kept as run "), "id").alias("note")
    full = F.to_json(F.struct(run, command, "ts", "mode", code, "stdout_bytes", "stderr_bytes", raw, note))
    rows = rows.withColumn("json", F.when(F.col("report").isNull(), full).otherwise(brief)).withColumn("run_id", F.col("id"))
    foot = encoded(rows.select("run_id", "json")).withColumnRenamed("text", "_foot")
    shown = F.concat(F.regexp_replace("report.rendered", r"(?U)\s+$", ""), F.lit("\n"))
    return rows.join(foot, "run_id").select(*by, F.concat(F.coalesce(shown, F.lit("")), "_foot").alias("text"))


def comparable_pairs(metas: DataFrame, reports: DataFrame) -> DataFrame:
    """Each run with a report and the run with one, of the same command and
    folder, just before it: ``current`` and ``previous`` structs, ``same_kind``,
    ``fewer`` (tests ran than before)."""
    rows = with_reports(metas, reports).where("report is not null")
    rows = rows.withColumn("key", T.command_key("argv"))
    order = W.partitionBy("key", "cwd").orderBy(F.substring("id", 1, 15), F.col("mtime").asc_nulls_first(), "id")
    side = F.struct("id", "exit", "argv", "report")
    rows = rows.select("id", side.alias("current"), F.lag(side).over(order).alias("previous")).where("previous is not null")
    kind = F.col("current.report.kind") == F.col("previous.report.kind")
    return rows.withColumn("same_kind", kind).withColumn("fewer", F.coalesce(F.col("current.report.total") < F.col("previous.report.total"), F.lit(False)))


def deltas(pairs: DataFrame) -> DataFrame:
    """(run_id, idx, id, loc, rule, msg, status) of comparable pairs."""
    pairs = pairs.where("same_kind")
    side = lambda name: pairs.select(F.col("id").alias("run_id"), F.posexplode(f"{name}.report.items").alias("idx", "i")).select("run_id", "idx", "i.id", "i.loc", "i.rule", "i.msg")
    return diff(side("previous"), side("current"), ["run_id"])


def vs_previous(pairs: DataFrame) -> DataFrame:
    """(run_id, summary): one line about each run against the one before; null
    where their kinds differ or neither has items."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = deltas(pairs).groupBy(F.col("run_id").alias("id")).agg(n("fixed"), n("still"), n("new"))
    rows = pairs.join(counts, "id", "left")
    name = F.when(F.col("fewer"), "fixed or not run").otherwise("fixed")
    line = F.concat(name, F.format_string(" %d; still %d; new %d", "fixed", "still", "new"))
    return rows.select(F.col("id").alias("run_id"), F.when(F.col("same_kind"), line).alias("summary"))


def render_diff(pairs: DataFrame) -> DataFrame:
    """(run_id, text): each run against the one before, in full. Pairs of
    different kinds (a build that broke after a test run) say so instead."""
    tests = F.col("current.report.kind") == "tests"
    item = F.struct("id", "loc", "rule", "msg")
    part = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("idx", item.alias("i"))))).alias(s)
    listed = deltas(pairs).groupBy(F.col("run_id").alias("id")).agg(part("fixed"), part("still"), part("new"))
    rows = pairs.join(listed, "id", "left")
    # names of fields, in the order in which they are shown
    test = lambda c, full: F.transform(c, lambda x: F.struct(x["i"]["id"].alias("id"), x["i"]["loc"].alias("loc"), *([x["i"]["msg"].alias("msg")] if full else [])))
    other = lambda c: F.transform(c, lambda x: F.struct(x["i"]["loc"].alias("loc"), x["i"]["rule"].alias("rule"), x["i"]["msg"].alias("msg")))
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<struct<idx:int,i:struct<id:string,loc:string,rule:string,msg:string>>>"))
    side = lambda name: F.struct(F.col(f"{name}.id").alias("id"), F.col(f"{name}.exit").alias("exit"), F.col(f"{name}.report.failed").alias("failed")).alias(name)
    note = F.format_string("current run executed %d tests vs %d before (stopped early or filtered): previous failures it lacks may not have run", F.coalesce("current.report.total", F.lit(0)), F.coalesce("previous.report.total", F.lit(0)))
    head = [display_command("current.argv").alias("command"), side("previous"), side("current")]

    def doc(entries, plain) -> Column:
        fields = [*head, entries(none("still")).alias("still_failing"), entries(none("new")).alias("new_failures")]
        fixed = plain(none("fixed"))
        return F.when(F.col("fewer"), F.to_json(F.struct(*fields, note.alias("note"), fixed.alias("fixed_or_not_run")))).otherwise(F.to_json(F.struct(*fields, fixed.alias("fixed"))))

    json = F.when(tests, doc(lambda c: test(c, True), lambda c: test(c, False))).otherwise(doc(other, other))
    compared = encoded(rows.where("same_kind").select(F.col("id").alias("run_id"), json.alias("json")))
    differs = F.format_string("run %s reported %s but run %s reported %s (a build break after a test run, or the reverse): nothing comparable", "previous.id", "previous.report.kind", "current.id", "current.report.kind")
    return compared.unionByName(pairs.where("not same_kind").select(F.col("id").alias("run_id"), differs.alias("text")))
