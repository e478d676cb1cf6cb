"""Texts as relations of lines, and back.

A line frame has the columns doc_id, pos (order within the document), line
(content) and term (its own line end: CR LF, LF, or '' for an unterminated last
line). All rules use one window, partitioned by doc_id and ordered by pos, so a
chain of rules shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["doc_id", "pos", "line", "term"]


def by_doc():
    return W.partitionBy("doc_id")


def in_order():
    return by_doc().orderBy("pos")


def so_far():
    return in_order().rowsBetween(W.unboundedPreceding, 0)


def to_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per line; an empty or null text has none."""
    # cut behind each line feed: every piece shows its own end, so nothing about
    # the whole text is needed, and none of it evaluated again, per line
    pieces = F.split(F.col(text), "(?<=\n)", -1)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(pieces).alias("pos", "raw")).where("raw <> ''")
    term = F.when(F.col("raw").endswith("\r\n"), "\r\n").when(F.col("raw").endswith("\n"), "\n").otherwise("")
    rows = rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "raw", term.alias("term"))
    return rows.select("doc_id", "pos", F.expr("left(raw, length(raw) - length(term))").alias("line"), "term")


def join_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text): each line with its own end."""
    sorted_ = F.array_sort(F.collect_list(F.struct("pos", F.concat("line", "term").alias("l"))))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(sorted_, lambda x: x["l"]), "").alias("text"))


def join_lines_with_separator(lines: DataFrame) -> DataFrame:
    """(doc_id, text): lines joined by the document's one separator: CR LF if any line ends so."""
    sorted_ = F.array_sort(F.collect_list(F.struct("pos", "line")))
    sep = F.when(F.max((F.col("term") == "\r\n").cast("int")) == 1, "\r\n").otherwise("\n")
    got = lines.groupBy("doc_id").agg(F.transform(sorted_, lambda x: x["line"]).alias("l"), sep.alias("sep"))
    return got.select("doc_id", F.expr("array_join(l, sep)").alias("text"))


def runs(lines: DataFrame, changes: Column) -> DataFrame:
    """Adds ``run``, which counts up where ``changes`` holds."""
    return lines.withColumn("_c", F.coalesce(changes.cast("int"), F.lit(1))).withColumn("run", F.sum("_c").over(so_far())).drop("_c")


def with_markers(rows: DataFrame, marker: Column, before: Column | None = None) -> DataFrame:
    """Each row, followed by ``marker`` as a line of its own where not null.

    The marker takes the row's ``last_term``; a row without an end of its own
    gets the document's separator first. ``pos`` stays unique and in order.
    """
    sep = F.when(F.max((F.col("term") == "\r\n").cast("int")).over(by_doc()) == 1, "\r\n").otherwise("\n")
    rows = rows.withColumn("_m", marker).withColumn("_sep", sep)
    own = F.struct((F.col("pos") * 2).alias("pos"), F.col("line"), F.when(F.col("_m").isNotNull() & (F.col("term") == ""), F.col("_sep")).otherwise(F.col("term")).alias("term"))
    extra = F.struct((F.col("pos") * 2 + 1).alias("pos"), F.col("_m").alias("line"), F.col("last_term").alias("term"))
    both = F.when(F.col("_m").isNotNull(), F.array(own, extra)).otherwise(F.array(own))
    return rows.select("doc_id", F.inline(both))


def head(lines: DataFrame, n: int) -> DataFrame:
    return lines.withColumn("_n", F.row_number().over(in_order())).where(F.col("_n") <= n).drop("_n")


def tail(lines: DataFrame, n: int) -> DataFrame:
    return lines.withColumn("_n", F.row_number().over(by_doc().orderBy(F.desc("pos")))).where(F.col("_n") <= n).drop("_n")


def parse_line_cut(args: str | Column) -> Column:
    """The count of ``-n N``, ``-nN``, ``-N``, ``--lines=N``; null if none."""
    c = F.col(args) if isinstance(args, str) else args
    got = F.regexp_extract(c, r"(?:^|\s)(?:-n\s*|--lines[= ]|-)(\d+)(?:\s|$)", 1)
    return F.when(got != "", got.cast("long"))


def large_window(text: str | Column, limit: int = 4 << 20, head_bytes: int = 512 << 10, tail_bytes: int = 1 << 20, errors: int = 200) -> Column:
    """Of a text above ``limit`` bytes: the head, error lines of the middle, the tail.

    A line before the error lines says how many lines and megabytes are left out
    and how many errors follow, a line behind them that the part ends. Head and
    tail are whole lines, if lines are shorter than they. Texts up to the limit
    stay as they are. All within the row: lines of large texts are never shuffled.
    """
    from ..functions.text import col, is_error_line

    text = col(text)
    data, total = text.cast("binary"), F.octet_length(text)
    part = lambda start, n: F.substr(data, (start + 1).cast("int"), n.cast("int")).cast("string")
    first = part(F.lit(0), F.lit(head_bytes))
    # what follows the last line end of the head, and what precedes the first of the tail
    over = F.octet_length(F.substring_index(first, "\n", -1))
    begin = F.when(over < F.octet_length(first), F.lit(head_bytes) - over).otherwise(F.lit(head_bytes))
    last = part(total - tail_bytes, F.lit(tail_bytes))
    under = F.octet_length(F.substring_index(last, "\n", 1))
    end = total - tail_bytes + F.when(under < F.octet_length(last), under + 1).otherwise(0)
    middle = part(begin, end - begin)
    rows = F.transform(F.split(F.regexp_replace(middle, r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    found = F.filter(rows, is_error_line)
    more = F.greatest(F.lit(0), F.size(found) - errors)
    mb = lambda n: F.format_string("%.1f", n / 1048576.0)
    said = F.concat(F.format_string("… %d lines (", F.size(rows)), mb(end - begin), F.lit(" MB) of a "), mb(total), F.lit(" MB output omitted; "), F.least(F.lit(errors), F.size(found)).cast("string"), F.lit(" error line(s) from them follow"), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more not shown)"))).otherwise(""), F.lit(" — full text in raw_log\n"))
    shown = F.array_join(F.transform(F.slice(found, 1, errors), lambda x: F.concat(x, F.lit("\n"))), "")
    whole = F.concat(part(F.lit(0), begin), said, shown, F.lit("… end of omitted section\n"), part(end, total - end))
    return F.when((total > limit) & (end > begin), whole).otherwise(text)


def fold_dropped(lines: DataFrame, keep: Column, marker) -> DataFrame:
    """Kept lines as they are; each run of dropped lines becomes one marker."""
    rows = lines.withColumn("_keep", keep)
    rows = runs(rows, F.col("_keep") | F.lag("_keep").over(in_order()))
    folded = rows.groupBy("doc_id", "run").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.max_by("term", "pos").alias("term"), F.min("_keep").alias("_keep"), F.count(F.lit(1)).alias("n"))
    return folded.select("doc_id", "pos", F.when(F.col("_keep"), F.col("line")).otherwise(marker(F.col("n"))).alias("line"), "term")
