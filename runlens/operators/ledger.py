"""Analytics over the ledger of wrapped runs.

A ledger frame has ts, cmd, adapter, tokens_in, tokens_out, saved, exit, run_id,
inner_cmd, and ``seq``, its order of appending (``part`` within a line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed values of the reports.
VISIBLE_CAP = 7500
UNCOMPRESSED = ("passthrough", "safe", "heuristic")
MEANINGFUL_PERCENT, MIN_CALLS, MIN_AVERAGE = 10, 3, 500
FILE_VIEWERS = ("cat", "less", "more", "head", "tail", "bat", "batcat")
SHELLS = ("sh", "bash", "zsh", "dash", "cmd")
REPEATED = 3


def is_uncompressed() -> Column:
    saved = F.greatest(F.col("tokens_in") - F.col("tokens_out"), F.lit(0))
    little = saved * 100 < F.col("tokens_in") * MEANINGFUL_PERCENT
    return (F.col("adapter") == "passthrough") | (F.col("adapter").isin(*UNCOMPRESSED) & little)


def since(ledger: DataFrame, cutoff: Column) -> DataFrame:
    """Rows from ``cutoff`` on; a time that cannot be read is dropped."""
    return ledger.where(F.try_to_timestamp(F.col("ts").cast("string")) >= cutoff)


def stats(ledger: DataFrame) -> DataFrame:
    """A row per adapter, in order of first use: calls, saved, saved_vs_visible."""
    seen = F.greatest(F.least("tokens_in", F.lit(VISIBLE_CAP)) - F.col("tokens_out"), F.lit(0))
    return ledger.groupBy("adapter").agg(F.count(F.lit(1)).alias("calls"), F.sum("saved").alias("saved"), F.sum(seen).alias("saved_vs_visible"), F.min("seq").alias("first_seq"))


def wasters(ledger: DataFrame) -> DataFrame:
    """Commands whose output is often long and little reduced."""
    rows = ledger.where(is_uncompressed()).groupBy("cmd").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if(F.col("adapter") == "passthrough").alias("passthrough"), F.min("seq").alias("first_seq")
    )
    rows = rows.where((F.col("calls") >= MIN_CALLS) & (F.expr("tokens_in div calls") >= MIN_AVERAGE))
    rows = rows.where(~T.basename("cmd").isin(*FILE_VIEWERS) & ~F.col("cmd").isin(*SHELLS))
    percent = F.expr("greatest(tokens_in - tokens_out, 0) * 100 div greatest(tokens_in, 1)")
    return rows.select("cmd", "calls", "tokens_in", F.expr("tokens_in div calls").alias("avg_tokens_in"), F.when(F.col("passthrough") == F.col("calls"), None).otherwise(percent).alias("saved_percent"), "first_seq")


def shell_strings(ledger: DataFrame) -> DataFrame:
    """What ran uncompressed inside ``sh -c`` strings, by inner command."""
    rows = ledger.where(is_uncompressed() & F.col("cmd").isin(*SHELLS))
    inner = F.coalesce("inner_cmd", F.lit("(unknown)")).alias("inner_cmd")
    return rows.groupBy("cmd", inner).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.expr("sum(tokens_in) div count(1)").alias("avg_tokens_in"), F.min("seq").alias("first_seq"))


def repeat_failures(ledger: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """Commands that failed three times in a row, once each, where it happened.

    The order is one over the whole ledger, by ``seq`` and, for records that
    share a line, ``part``; gaps do not matter and malformed rows do not count.
    Windows run over stretches of ``seq``; only the last two rows of each stretch
    are put in one order, for the first two of the next.
    """
    if "malformed" in ledger.columns:
        ledger = ledger.where("not malformed")
    part = F.col("part") if "part" in ledger.columns else F.lit(0)
    run = F.struct("cmd", (F.col("exit") != 0).alias("failed"))
    rows = ledger.select("seq", part.alias("part"), "cmd", run.alias("run"), F.expr(f"seq div {stretch}").alias("b"))
    order = W.partitionBy("b").orderBy("seq", "part")
    rows = rows.withColumns({"one": F.lag("run").over(order), "two": F.lag("run", 2).over(order), "n": F.row_number().over(order)})
    back = F.row_number().over(W.partitionBy("b").orderBy(F.desc("seq"), F.desc("part")))
    ends = rows.select("b", "seq", "part", "run", back.alias("k")).where(F.col("k") < REPEATED)
    ends = ends.groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "run"))), lambda x: x["run"]).alias("last"))
    # a stretch has a row at least, so two stretches hold the two rows before the next
    none = F.array().cast(ends.schema["last"].dataType)
    all_ = W.orderBy("b")
    before = ends.select("b", F.concat(F.coalesce(F.lag("last", 2).over(all_), none), F.coalesce(F.lag("last").over(all_), none)).alias("before"))
    rows = rows.join(before, "b")
    nth = lambda i: F.try_element_at("before", F.lit(-i))
    one = F.when(F.col("n") == 1, nth(1)).otherwise(F.col("one"))
    two = F.when(F.col("n") == 1, nth(2)).when(F.col("n") == 2, nth(1)).otherwise(F.col("two"))
    again = lambda x: (x["cmd"] == F.col("cmd")) & x["failed"]
    return rows.where(F.col("run.failed") & again(one) & again(two)).groupBy("cmd").agg(F.min("seq").alias("seq"))


def top_uncompressed(ledger: DataFrame, n: int = 5) -> DataFrame:
    """The heads whose long outputs saved nothing, by tokens."""
    shell = F.col("inner_cmd").isNotNull() & F.col("cmd").isin("sh", "bash", "zsh", "cmd")
    head = F.when(shell, F.concat(F.lit("sh -c "), "inner_cmd")).otherwise(F.col("cmd")).alias("cmd")
    rows = ledger.where("saved <= 0 and tokens_in >= 500").groupBy(head).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.min("seq").alias("_s"))
    return rows.orderBy(F.desc("tokens_in"), "_s").limit(n).drop("_s")


def negative_saved(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count_if(F.col("saved") < 0).alias("negative_saved"), F.count(F.lit(1)).alias("calls"))


def hourly(ledger_stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Calls and savings per adapter and hour; for streams and batches."""
    rows = ledger_stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    got = rows.groupBy(F.window("at", "1 hour").alias("w"), "adapter").agg(F.count(F.lit(1)).alias("calls"), F.sum("saved").alias("saved"))
    return got.select(F.col("w.start").alias("hour"), "adapter", "calls", "saved")


def ordered(frame: DataFrame) -> DataFrame:
    """``frame`` in the order the reports show it in: tokens first, then first seen."""
    return frame.orderBy(F.desc("tokens_in"), "first_seq")
