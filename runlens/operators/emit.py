"""What a wrapped run shows: candidates, the savings guard, footers, the ceiling.

Runs are rows (run_id, stdout, stderr, raw_log, interrupted). Both streams go
through the ladder as rows of one frame; each is shown in its reduced form only
if that, its footers included, has fewer tokens than the stream itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.toon import cell, encode_json
from .budget import cap_tokens, split_ceiling
from .ladder import bounded, compress

STREAMS = ("stdout", "stderr")


def footer(name: str, value: Column) -> Column:
    """A line behind a report; empty where the value is null."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"\n{name}: "), cell(value, "string")))


def number_footer(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"\n{name}: "), value.cast("string")), F.lit(""))


def report_footers(exit_code: Column, vs_previous: Column, raw_log: Column, dropped_filter: Column, interrupted: Column) -> Column:
    """All that may follow a parsed report, in this order; the last line ends."""
    code = number_footer("exit_code", F.when(exit_code != 0, exit_code))
    return F.concat(code, footer("vs_previous", vs_previous), footer("raw_log", raw_log), footer("pipe_filter_dropped", dropped_filter), footer("interrupted", interrupted))


def lossy_allowed(raw_log: Column, keep_runs: int) -> Column:
    """A reduced form needs the raw log it points at, unless archiving is off."""
    return F.lit(keep_runs == 0) | raw_log.isNotNull()


def explains_failure(failed: Column, errors: Column) -> Column:
    """Whether a report itself shows why a run failed: failed tests or errors."""
    return (F.coalesce(failed, F.lit(0)) > 0) | (F.coalesce(errors, F.lit(0)) > 0)


def guarded(candidate: Column, original: Column, exact=None) -> Column:
    """(pays, tokens, original): estimates decide unless they are close and
    ``exact``, a function of a column, can count both sides."""
    cand, orig = T.approx_tokens(candidate), T.approx_tokens(original)
    if exact is not None:
        close = T.is_close(cand, orig)
        cand, orig = F.when(close, exact(candidate)).otherwise(cand), F.when(close, exact(original)).otherwise(orig)
    return F.struct(F.coalesce(T.pays(cand, orig), F.lit(False)).alias("pays"), cand.alias("tokens"), orig.alias("original"))


def as_document(text: str | Column) -> Column:
    """JSON texts as one document: several lines that are one each as an array."""
    lines = F.filter(F.transform(F.split(T.col(text), "\n"), F.trim), lambda x: x != "")
    listed = F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))
    return F.when(T.is_container(text), F.trim(T.col(text))).when(T.is_json_document(text), listed)


def transform(docs: DataFrame, level: str = "safe", json: Column | None = None) -> DataFrame:
    """(doc_id, candidate, mode) of (doc_id, text): TOON of a JSON document, else
    the ladder's result, else null. Losing only the last line end is no change.

    ``json``: where documents are looked for; everywhere by default.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.lit(True) if json is None else json).alias("_json"))
    rows = rows.withColumn("_doc", F.when(F.col("_json"), as_document("text")))
    plain = rows.where("_doc is null")
    small = compress(bounded(plain.select("doc_id", "text")), level).withColumnRenamed("text", "_small")
    both = plain.join(small, "doc_id", "left")
    same = F.col("_small").isNull() | (F.col("_small") == F.col("text")) | (F.concat("_small", F.lit("\n")) == F.col("text"))
    reduced = both.select("doc_id", F.when(~same, F.col("_small")).alias("candidate"), F.when(~same, F.lit(level)).alias("mode"))
    structured = rows.where("_doc is not null").select("doc_id", encode_json("_doc").alias("candidate"), F.lit("json").alias("mode"))
    return reduced.unionByName(structured)


def emit(runs: DataFrame, level: str = "safe", keep_runs: int = 1, max_tokens: int | None = None, exact=None) -> DataFrame:
    """(run_id, out, err, mode, tokens_in, tokens_out) of runs.

    stdout may be JSON. Where only stderr is reduced it carries the footers. If
    the raw log is missing, nothing is reduced. ``max_tokens`` holds for both
    streams together, shared in proportion.
    """
    base = runs.select("run_id", *(F.coalesce(s, F.lit("")).alias(s) for s in STREAMS), "raw_log", "interrupted")
    streams = base.select("run_id", F.inline(F.array(*(F.struct(F.lit(s).alias("stream"), F.col(s).alias("text")) for s in STREAMS))))
    named = streams.select(F.struct("run_id", "stream").alias("doc_id"), "text")
    found = transform(named, level, F.col("doc_id.stream") == "stdout").select("doc_id.run_id", "doc_id.stream", "candidate", "mode")
    pick = lambda s, c: F.max(F.when(F.col("stream") == s, F.col(c))).alias(f"{s}_{c}")
    wide = found.groupBy("run_id").agg(*(pick(s, c) for s in STREAMS for c in ("candidate", "mode")))
    rows = base.join(wide, "run_id")
    foot = F.concat(footer("raw_log", F.col("raw_log")), footer("interrupted", F.col("interrupted")))
    rows = rows.withColumn("_out", F.concat("stdout_candidate", foot))
    rows = rows.withColumn("_o", guarded(F.col("_out"), F.col("stdout"), exact))
    rows = rows.withColumn("_err", F.when(F.col("_o.pays"), F.col("stderr_candidate")).otherwise(F.concat("stderr_candidate", foot)))
    rows = rows.withColumn("_e", guarded(F.col("_err"), F.col("stderr"), exact))
    allowed = lossy_allowed(F.col("raw_log"), keep_runs)
    out, err = allowed & F.col("_o.pays"), allowed & F.col("_e.pays")
    mode = F.when(out, F.col("stdout_mode")).when(err, F.lit(level)).otherwise("passthrough")
    ended = F.when(F.col("_out").endswith("\n"), F.col("_out")).otherwise(F.concat("_out", F.lit("\n")))
    tokens = lambda used, g: F.when(used, F.col(f"{g}.tokens")).otherwise(F.col(f"{g}.original"))
    shown = rows.select("run_id", F.when(out, ended).otherwise(F.col("stdout")).alias("out"), F.when(err, F.col("_err")).otherwise(F.col("stderr")).alias("err"), mode.alias("mode"), (F.col("_o.original") + F.col("_e.original")).alias("tokens_in"), (tokens(out, "_o") + tokens(err, "_e")).alias("tokens_out"))
    return cap_streams(shown, max_tokens) if max_tokens is not None else shown


def cap_streams(shown: DataFrame, max_tokens: int) -> DataFrame:
    """Both streams of a run cut so that together they keep to the ceiling."""
    share = split_ceiling(T.approx_tokens("out"), T.approx_tokens("err"), max_tokens)
    over = shown.where(F.col("tokens_out") > max_tokens).withColumn("_share", share)
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("text"), F.col(f"_share.{s}").alias("ceiling")) for s in ("out", "err")))
    texts = over.select("run_id", F.inline(sides)).select(F.struct("run_id", "side").alias("doc_id"), "text", "ceiling")
    cut = cap_tokens(texts, F.col("ceiling"))
    side = lambda s: F.max(F.when(F.col("doc_id.side") == s, F.col("text"))).alias(f"_{s}")
    cut = cut.groupBy("doc_id.run_id").agg(side("out"), side("err"))
    capped = over.drop("out", "err", "_share", "tokens_out").join(cut, "run_id")
    capped = capped.select("run_id", F.col("_out").alias("out"), F.col("_err").alias("err"), "mode", "tokens_in", (T.approx_tokens("_out") + T.approx_tokens("_err")).alias("tokens_out"))
    return shown.where(F.col("tokens_out") <= max_tokens).unionByName(capped)
