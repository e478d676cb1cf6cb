"""Questions across runs: differences, previous runs, searches, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Matches shown by a search, runs that size alone never deletes, seconds of grace.
MAX_MATCHES, MIN_KEEP, MIN_AGE = 50, 5, 60


def match_key() -> Column:
    """Tests match by id; diagnostics by file, rule and message."""
    named = F.coalesce(F.col("id"), F.lit("")) != ""
    return F.when(named, F.struct(F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"))).otherwise(
        F.struct(T.file_of("loc").alias("a"), F.coalesce("rule", F.lit("")).alias("b"), F.coalesce("msg", F.lit("")).alias("c"))
    )


def diff(previous: DataFrame, current: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Items (idx, id, loc, rule, msg) with ``status``: fixed, still or new.

    Items match one to one, in order, as bags: of three equal items before and
    two after, two are still there and one is fixed. ``still`` and ``new`` rows
    are those of ``current``.
    """
    by = within or []
    number = lambda d: d.withColumn("k", match_key()).withColumn("n", F.row_number().over(W.partitionBy(*by, "k").orderBy("idx")))
    old, new = number(previous), number(current)
    keys = [*by, "k", "n"]
    still = new.join(old.select(*keys), keys, "left_semi").withColumn("status", F.lit("still"))
    fresh = new.join(old.select(*keys), keys, "left_anti").withColumn("status", F.lit("new"))
    fixed = old.join(new.select(*keys), keys, "left_anti").withColumn("status", F.lit("fixed"))
    return fixed.unionByName(still).unionByName(fresh).drop("k", "n")


def versus_previous(delta: DataFrame, fewer: bool = False) -> DataFrame:
    """One line about a difference; no row if it is empty."""
    n = lambda s: F.count_if(F.col("status") == s)
    name = "fixed or not run" if fewer else "fixed"
    got = delta.agg(n("fixed").alias("f"), n("still").alias("s"), n("new").alias("w"))
    return got.where("f + s + w > 0").select(F.format_string(f"{name} %d; still %d; new %d", "f", "s", "w").alias("summary"))


def previous_run(metas: DataFrame) -> DataFrame:
    """``previous``: the run of the same command and folder just before each."""
    order = W.partitionBy("key", "cwd").orderBy(F.substring("id", 1, 15), F.col("mtime").asc_nulls_first(), "id")
    return metas.withColumn("previous", F.lag("id").over(order))


def newest_first(metas: DataFrame) -> DataFrame:
    return metas.orderBy(F.desc(F.substring("id", 1, 15)), F.desc("mtime"), F.desc("id"))


def grep(lines: DataFrame, pattern: str, context: int = 0, quota: int = MAX_MATCHES) -> DataFrame:
    """Matching lines of each run with ``context`` around them.

    ``lines``: doc_id (the run), stream, pos, line. The quota of matches per run
    is spent in order of stream and position before context is added. Columns:
    doc_id, stream, pos, line, hit, island (count of gaps before), matches (of
    the stream), shown (of them within the quota).
    """
    by_stream = W.partitionBy("doc_id", "stream")
    order = by_stream.orderBy("pos")
    rows = lines.withColumn("match", F.col("line").rlike(pattern))
    # rank of a match in its run: matches of earlier streams, plus those before it
    rank = F.sum(F.col("match").cast("int")).over(W.partitionBy("doc_id").orderBy(F.desc("stream"), "pos").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("hit", F.col("match") & (rank <= quota))
    rows = rows.withColumn("matches", F.count_if("match").over(by_stream)).withColumn("shown", F.count_if("hit").over(by_stream))
    near = F.max(F.col("hit").cast("int")).over(order.rowsBetween(-context, context))
    rows = rows.withColumn("_near", near).where("_near = 1").withColumn("_gap", F.col("pos") - F.lag("pos").over(order) > 1)
    rows = rows.withColumn("island", F.coalesce(F.sum(F.col("_gap").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    return rows.select("doc_id", "stream", "pos", "line", "hit", "island", "matches", "shown")


def render_grep(found: DataFrame) -> DataFrame:
    """(doc_id, text) of :func:`grep` as the report shows it."""
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit(":"), "line", F.lit("\n"))
    first = F.row_number().over(W.partitionBy("doc_id", "stream").orderBy("pos")) == 1
    begins = F.lag("island").over(W.partitionBy("doc_id", "stream").orderBy("pos")) < F.col("island")
    head = F.concat(F.lit("--- "), "stream", F.lit(" ("), F.col("matches").cast("string"), F.lit(" matches) ---\n"))
    rows = found.withColumn("t", F.concat(F.when(first, head).otherwise(""), F.when(begins, "...\n").otherwise(""), line))
    parts = rows.groupBy("doc_id", "stream").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("p"), F.first("matches").alias("m"), F.first("shown").alias("s"))
    note = F.when(F.col("s") < F.col("m"), F.format_string("  (showing %d of %d matches)\n", "s", "m")).otherwise("")
    text = F.concat(F.array_join(F.transform("p", lambda x: x["t"]), ""), note)
    both = parts.select("doc_id", "stream", text.alias("t")).groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("stream", "t")))).alias("p"))
    return both.select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


def prune_plan(runs: DataFrame, keep_runs: int, max_bytes: int, now: Column, root: str = "root") -> DataFrame:
    """Runs to delete, oldest first, of each root (id, size).

    A run goes while there are more than ``keep_runs``, or the sizes of all but
    the newest exceed ``max_bytes`` and more than five are left; the first run
    that may not go, or is under a minute old, ends it.
    """
    all_ = W.partitionBy(root)
    order = all_.orderBy("id")
    left = F.count(F.lit(1)).over(all_) - F.row_number().over(order) + 1
    last = F.lead("id").over(order).isNull()
    size = F.when(last, 0).otherwise(F.col("size"))
    after = F.sum(size).over(order.rowsBetween(0, W.unboundedFollowing))
    rows = runs.withColumn("left", left).withColumn("_last", last).withColumn("_size", size)
    rows = rows.withColumn("bytes_left", after)
    over = (F.col("left") > keep_runs) | ((F.col("bytes_left") > max_bytes) & (F.col("left") > MIN_KEEP))
    young = F.coalesce(T.run_time("id") > now - F.expr(f"interval {MIN_AGE} seconds"), F.lit(False))
    rows = rows.withColumn("_stop", F.col("_last") | ~over | young)
    stopped = F.max(F.col("_stop").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_s", stopped).where("_s = 0").select(root, "id", "size")


def nearest_owner(calls: DataFrame, declarations: DataFrame, by: list[str], reach: int = 10) -> DataFrame:
    """Each call line with the nearest declaration at most ``reach`` lines above.

    Buckets of ``reach`` lines make it an equi-join: a declaration can only be
    in a call's bucket or the one before.
    """
    left = calls.withColumn("_b", F.explode(F.array(F.floor(F.col("line") / reach), F.floor(F.col("line") / reach) - 1)))
    right = declarations.select(*by, F.floor(F.col("line") / reach).alias("_b"), F.col("line").alias("declared"), "name")
    near = left.join(right, [*by, "_b"]).where((F.col("declared") <= F.col("line")) & (F.col("line") - F.col("declared") <= reach))
    return near.groupBy(*by, "line").agg(F.max("declared").alias("declared"), F.max_by("name", "declared").alias("name"))


def merge_streams(chunks: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, text): the chunks of all streams in order of arrival (seq)."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return chunks.groupBy(run).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
