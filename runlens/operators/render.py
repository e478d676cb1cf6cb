"""Reports as compact text."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.toon import encode, loads
from .reports import budget_trace


def encoded(docs: DataFrame, **options) -> DataFrame:
    """(run_id, text) of (run_id, json)."""

    def run(frames):
        for f in frames:
            yield f.assign(text=f["json"].map(lambda t: encode(loads(t), **options)))[["run_id", "text"]]

    return docs.mapInPandas(run, f"run_id {dict(docs.dtypes)['run_id']}, text string")


def trace_keys(failures: Column) -> Column:
    """A key for each failure: its id; id@loc where ids repeat and there is a
    place; keys that still repeat get #2, #3 and so on. One pass over a run."""

    @F.pandas_udf("array<string>")
    def run(ids: pd.Series, places: pd.Series) -> pd.Series:
        def one(names, locs):
            if names is None:
                return None
            often, used, out = Counter(names), Counter(), []
            for name, loc in zip(names, locs):
                key = f"{name}@{loc}" if name is not None and loc and often[name] > 1 else name
                used[key] += 1
                out.append(key if key is None or used[key] == 1 else f"{key}#{used[key]}")
            return out

        return pd.Series([one(n, p) for n, p in zip(ids, places)], dtype=object)

    return run(F.transform(failures, lambda f: f["id"]), F.transform(failures, lambda f: f["loc"]))


def render_reports(reports: DataFrame, trace_lines: int = 20) -> DataFrame:
    """(run_id, text): runner, summary, failures as a table, traces by failure."""
    f = F.col("failures")
    # keys are unique over all failures, those without a trace too
    reports = reports.withColumn("_keys", trace_keys(f))
    both = F.transform(f, lambda x, i: F.struct(F.get("_keys", i).alias("key"), budget_trace(x["trace"], trace_lines).alias("trace")))
    traced = F.filter(both, lambda x: F.size(x["trace"]) > 0)
    traces = F.map_from_entries(traced)
    rows = F.transform(f, lambda x: F.struct(x["id"].alias("id"), x["loc"].alias("loc"), x["msg"].alias("msg")))
    summary = F.struct("total", "passed", "failed", "skipped", "duration_s")
    doc = F.struct("runner", summary.alias("summary"), F.when(F.size(f) > 0, rows).alias("failures"), F.when(F.size(traced) > 0, traces).alias("traces"))
    return encoded(reports.select("run_id", F.to_json(doc).alias("json")), indent=1, list_scalars=True)


def render_diagnostics(found: DataFrame, summary: DataFrame) -> DataFrame:
    """(run_id, text): runner, counts, and the diagnostics as a table."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.struct("loc", "severity", "rule", "msg").alias("d"))))
    rows = found.groupBy("run_id").agg(F.transform(parts, lambda x: x["d"]).alias("diagnostics"))
    both = summary.join(rows, "run_id", "left")
    counts = F.struct(*(c for c in ("errors", "warnings", "files") if c in summary.columns))
    return encoded(both.select("run_id", F.to_json(F.struct("runner", counts.alias("summary"), "diagnostics")).alias("json")), indent=1)


def fill_from_log(failures: DataFrame, log: DataFrame) -> DataFrame:
    """Failures (run_id, id, loc, msg) without a place take it from the log.

    ``log``: run_id, pos, id, loc, msg. An id of the log may be a suffix of the
    failure's, cut at a dot or slash: all suffixes are joined by equality, and
    the first matching line counts.
    """
    parts = F.split(F.col("id"), "[./]")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    wanted = failures.where("loc = ''").select("run_id", "id", F.explode(suffix).alias("tail"))
    said = log.select("run_id", "pos", F.regexp_replace("id", "/", ".").alias("tail"), F.col("loc").alias("at"), F.col("msg").alias("says"))
    first = wanted.join(said, ["run_id", "tail"]).groupBy("run_id", "id").agg(F.min_by("at", "pos").alias("at"), F.min_by("says", "pos").alias("says"))
    out = failures.join(first, ["run_id", "id"], "left")
    return out.select("run_id", "id", F.when(F.col("loc") == "", F.coalesce("at", "loc")).otherwise(F.col("loc")).alias("loc"), F.when(F.col("loc") == "", F.coalesce("says", "msg")).otherwise(F.col("msg")).alias("msg"))


def render_stats(ledger: DataFrame) -> DataFrame:
    """(text): calls, tokens saved, and a table per adapter in order of first use."""
    from .ledger import stats

    by = stats(ledger)
    entry = F.struct(F.col("adapter"), F.struct("calls", "saved").alias("v"))
    parts = F.array_sort(F.collect_list(F.struct("first_seq", entry.alias("e"))))
    total = by.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("saved"), F.lit(0)).alias("tokens_saved"), F.coalesce(F.sum("saved_vs_visible"), F.lit(0)).alias("saved_vs_visible"), F.map_from_entries(F.transform(parts, lambda p: p["e"])).alias("by_adapter"))
    doc = F.to_json(F.struct("calls", "tokens_saved", "saved_vs_visible", "by_adapter"))
    return encoded(total.select(F.lit(0).alias("run_id"), doc.alias("json"))).select("text")


def suggestions(ledger: DataFrame) -> DataFrame:
    """(kind, cmd, calls, avg_tokens_in, action, rank): what the ledger says to change.

    Shell strings of a shell stand where the shell stands among the wasters,
    which are ordered by tokens; failures in a row come last.
    """
    from . import commands as C
    from . import ledger as L

    pin = lambda c: F.concat(F.lit("pin [command."), c, F.lit('] level="aggressive"'))
    waste = L.wasters(ledger)
    how = F.when(F.col("saved_percent").isNull(), "output passed through uncompressed today").otherwise(F.concat(F.lit("the safe tier saved only "), F.col("saved_percent").cast("string"), F.lit("% today")))
    waste = waste.select(F.lit("token_waster").alias("kind"), "cmd", "calls", "avg_tokens_in", F.concat(pin(F.col("cmd")), F.lit(" ("), how, F.lit(")")).alias("action"), F.struct(F.lit(0).alias("a"), (-F.col("tokens_in")).alias("b"), F.col("first_seq").alias("c")).alias("rank"))
    shells = L.shell_strings(ledger)
    known = C.adapter_of(F.concat("inner_cmd", F.lit(" test"))).isNotNull() | C.adapter_of("inner_cmd").isNotNull()
    advice = F.when(known, F.concat(F.lit("run `"), "inner_cmd", F.lit("` without the pipe or shell operator, so that its report is parsed"))).otherwise(F.concat(F.lit("run `"), "inner_cmd", F.lit("` directly and pin it if it stays noisy")))
    shells = shells.select(F.lit("shell_string").alias("kind"), F.col("inner_cmd").alias("cmd"), "calls", "avg_tokens_in", advice.alias("action"), F.struct(F.lit(0).alias("a"), (-F.col("tokens_in")).alias("b"), F.col("first_seq").alias("c")).alias("rank"))
    again = L.repeat_failures(ledger).select(F.lit("repeat_failure").alias("kind"), "cmd", F.lit(L.REPEATED).cast("long").alias("calls"), F.lit(None).cast("long").alias("avg_tokens_in"), F.concat(F.lit("`"), "cmd", F.lit(f"` failed {L.REPEATED}x in a row: read the archived log instead of running it again")).alias("action"), F.struct(F.lit(1).alias("a"), F.lit(0).cast("long").alias("b"), F.col("seq").alias("c")).alias("rank"))
    return waste.unionByName(shells).unionByName(again)


def render_suggestions(ledger: DataFrame) -> DataFrame:
    """(text): calls, tokens saved, and the suggestions or a verdict."""
    found = suggestions(ledger)
    parts = F.array_sort(F.collect_list(F.struct("rank", F.struct("kind", "cmd", "calls", "avg_tokens_in", "action").alias("s"))))
    listed = found.agg(F.transform(parts, lambda p: p["s"]).alias("s"))
    totals = ledger.agg(F.count(F.lit(1)).alias("analyzed_calls"), F.coalesce(F.sum("saved"), F.lit(0)).alias("tokens_saved"))
    one = totals.withColumn("k", F.lit(0)).join(listed.withColumn("k", F.lit(0)), "k")  # a row each
    none = F.size("s") == 0
    doc = F.struct("analyzed_calls", "tokens_saved", F.when(none, "no waste detected").alias("verdict"), F.when(~none, F.col("s")).alias("suggestions"))
    return encoded(one.select(F.lit(0).alias("run_id"), F.to_json(doc).alias("json"))).select("text")


def render_delta(delta: DataFrame, fewer: bool = False) -> DataFrame:
    """(text): what was fixed, is still there, is new; empty parts are left out."""
    part = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("idx", F.struct("id", "loc", "rule", "msg").alias("i")))))
    got = delta.agg(part("fixed").alias("f"), part("still").alias("s"), part("new").alias("n"))
    rows = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda x: x["i"]))
    counts = F.struct(F.size("f").alias("fixed"), F.size("s").alias("still"), F.size("n").alias("new"))
    doc = F.struct(counts.alias("summary"), rows("f").alias("fixed_or_not_run" if fewer else "fixed"), rows("s").alias("still"), rows("n").alias("new"))
    return encoded(got.select(F.lit(0).alias("run_id"), F.to_json(doc).alias("json"))).select("text")
