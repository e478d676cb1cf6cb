"""The log reduction ladder: ordered rules on line frames.

Safe: escapes, progress, blanks, repeats. Aggressive: then levels, near
duplicates, diagnostics, error windows. A safe rule keeps each line's own end;
aggressive rules join lines by the document's separator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.toon import table_head, table_row
from .lines import KEY, by_doc, fold_dropped, in_order, join_lines, large_window, runs, to_lines, with_markers

#: Fixed values of the rules.
MIN_LEVELED, MIN_LEVELED_SHARE, LEVEL_CONTEXT = 10, 0.5, 2
MIN_SIMILAR, MAX_SLOT_VALUES = 3, 6
MIN_DIAGNOSTICS = 3
HEAD, TAIL, ERROR_CONTEXT, MIN_TOTAL = 15, 15, 3, 80


def strip_escapes(text: str | Column) -> Column:
    """On whole texts: an escape may span lines."""
    return F.regexp_replace(T.col(text), P.ESCAPES, "")


def redraw_final(line: str | Column) -> Column:
    """The last state of a line redrawn with carriage returns; others as they are."""
    body = F.regexp_replace(T.col(line), r"\r+$", "")
    shown = F.filter(F.split(body, "\r"), lambda s: s != "")
    return F.when(F.contains(body, F.lit("\r")), F.coalesce(F.try_element_at(shown, F.lit(-1)), F.lit(""))).otherwise(T.col(line))


def collapse_progress(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("line", redraw_final("line"))
    template = F.when(T.is_bar_line("line"), F.translate("line", P.BAR_TEMPLATE_DROPS, ""))
    rows = rows.withColumn("tpl", template)
    rows = runs(rows, ~F.coalesce(F.col("tpl") == F.lag("tpl").over(in_order()), F.lit(False)))
    folded = rows.groupBy("doc_id", "run").agg(
        F.min("pos").alias("pos"), F.max_by("line", "pos").alias("line"), F.max_by("term", "pos").alias("term"), F.count(F.lit(1)).alias("n")
    )
    folded = folded.withColumn("last_term", F.col("term"))
    return with_markers(folded, F.when(F.col("n") > 1, F.format_string("  (x%d progress frames, last kept)", "n")))


def collapse_blanks(lines: DataFrame) -> DataFrame:
    before = F.lag("line").over(in_order())
    return lines.withColumn("_drop", (F.col("line") == "") & (F.coalesce(before, F.lit("x")) == "")).where("not _drop").drop("_drop")


def repeats(lines: DataFrame) -> DataFrame:
    """Runs of equal lines: doc_id, pos of the first, line, n."""
    rows = runs(lines, ~F.coalesce(F.col("line") == F.lag("line").over(in_order()), F.lit(False)))
    return rows.groupBy("doc_id", "run").agg(
        F.min("pos").alias("pos"), F.first("line").alias("line"), F.min_by("term", "pos").alias("term"), F.max_by("term", "pos").alias("last_term"), F.count(F.lit(1)).alias("n")
    ).drop("run")


def collapse_repeats(lines: DataFrame) -> DataFrame:
    return with_markers(repeats(lines), F.when(F.col("n") > 1, F.format_string("  (x%d)", "n")))


def filter_levels(lines: DataFrame) -> DataFrame:
    """Fold noise lines far from warnings into counts, if levels dominate."""
    rows = lines.withColumn("lv", T.level_of("line"))
    leveled = F.count("lv").over(by_doc())
    filled = F.count_if(F.trim(F.regexp_replace("line", r"(?U)\s+", "")) != "").over(by_doc())
    rows = rows.withColumn("_gate", (leveled >= MIN_LEVELED) & (leveled >= filled * MIN_LEVELED_SHARE))
    loud = (F.col("lv").isNotNull() & ~T.is_noise("lv")).cast("int")
    near = F.max(loud).over(in_order().rowsBetween(-LEVEL_CONTEXT, LEVEL_CONTEXT))
    rows = rows.withColumn("_keep", ~F.col("_gate") | F.col("lv").isNull() | (near == 1))
    rows = runs(rows, F.col("_keep") | F.lag("_keep").over(in_order()))
    names = [F.struct(F.min(F.when(F.col("lv") == n, F.col("pos"))).alias("at"), F.count_if(F.col("lv") == n).alias("k"), F.lit(n).alias("name")) for n in P.NOISE]
    folded = rows.groupBy("doc_id", "run").agg(
        F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.max_by("term", "pos").alias("term"), F.min("_keep").alias("_keep"), F.array(*names).alias("names")
    )
    listed = F.transform(F.array_sort(F.filter("names", lambda x: x["k"] > 0)), lambda x: F.concat(x["k"].cast("string"), F.lit(" "), x["name"]))
    marker = F.concat(F.lit("  (filtered "), F.array_join(listed, ", "), F.lit(" lines, see raw_log)"))
    return folded.select("doc_id", "pos", F.when(F.col("_keep"), F.col("line")).otherwise(marker).alias("line"), "term")


def _slot(values: Column) -> Column:
    """How one numeric slot of a run is shown."""
    first = values[0]
    constant = F.forall(values, lambda v: v == first)
    has_id = F.exists(values, lambda v: (F.length(v) >= 8) & ~v.rlike("^[0-9]+$"))
    bare = F.transform(values, lambda v: F.regexp_replace(v, "^0+(?=.)", ""))
    fits = F.forall(bare, lambda v: v.rlike("^[0-9]+$") & ((F.length(v) < 39) | ((F.length(v) == 39) & (v <= "340282366920938463463374607431768211455"))))
    pairs = F.arrays_zip(F.slice(bare, F.lit(1), F.size(bare) - 1).alias("a"), F.slice(bare, F.lit(2), F.size(bare) - 1).alias("b"))
    rising = F.forall(pairs, lambda p: (F.length(p["a"]) < F.length(p["b"])) | ((F.length(p["a"]) == F.length(p["b"])) & (p["a"] < p["b"])))
    distinct = F.array_distinct(values)
    more = F.when(F.size(distinct) > MAX_SLOT_VALUES, F.concat(F.lit(",…+"), (F.size(distinct) - MAX_SLOT_VALUES).cast("string"))).otherwise("")
    shown = F.concat(F.lit("{"), F.array_join(F.slice(distinct, 1, MAX_SLOT_VALUES), ","), more, F.lit("}"))
    return F.when(constant | has_id | (fits & rising), first).otherwise(shown)


def collapse_near_dups(lines: DataFrame) -> DataFrame:
    """Runs of at least three lines equal but for numbers: a summary and a marker."""
    rows = lines.withColumn("_p", T.is_error_line("line") | T.is_diagnostic_line("line"))
    rows = rows.withColumn("_norm", F.when(~F.col("_p"), F.regexp_replace("line", P.SLOT, "#")))
    rows = runs(rows, ~F.coalesce(F.col("_norm") == F.lag("_norm").over(in_order()), F.lit(False)))
    run = F.array_sort(F.collect_list(F.struct("pos", "line", "term")))
    rows = rows.groupBy("doc_id", "run").agg(run.alias("r"))
    folds = F.size("r") >= MIN_SIMILAR
    slots = F.transform("r", lambda x: F.regexp_extract_all(x["line"], F.lit(P.SLOT), F.lit(0)))
    rows = rows.withColumn("_slots", F.when(folds, slots)).withColumn("_text", F.when(folds, F.split(F.col("r")[0]["line"], P.SLOT, -1)))
    shown = F.transform("_text", lambda t, k: F.when(k < F.size(F.col("_slots")[0]), F.concat(t, _slot(F.transform("_slots", lambda s: s[k])))).otherwise(t))
    first, last = F.col("r")[0], F.element_at("r", -1)
    summary = F.struct((first["pos"] * 2).alias("pos"), F.array_join(shown, "").alias("line"), first["term"].alias("term"))
    marker = F.struct((first["pos"] * 2 + 1).alias("pos"), F.format_string("  (x%d similar)", F.size("r")).alias("line"), last["term"].alias("term"))
    plain = F.transform("r", lambda x: F.struct((x["pos"] * 2).alias("pos"), x["line"].alias("line"), x["term"].alias("term")))
    return rows.select("doc_id", F.inline(F.when(folds, F.array(summary, marker)).otherwise(plain)))


def window_errors(lines: DataFrame) -> DataFrame:
    """Head, tail and the lines around errors of long documents; tables whole."""
    own = F.col("pos") < TABLE
    n = F.count_if(own).over(by_doc())
    place = F.row_number().over(in_order())
    near = F.max((own & T.is_error_line("line")).cast("int")).over(in_order().rowsBetween(-ERROR_CONTEXT, ERROR_CONTEXT))
    rows = lines.withColumn("_n", n).withColumn("_i", place).withColumn("_near", near)
    keep = (F.col("_n") < MIN_TOTAL) | (F.col("_i") <= HEAD) | (F.col("_i") > F.col("_n") - TAIL) | (F.col("_near") == 1)
    return fold_dropped(rows, keep, lambda k: F.format_string("  (skipped %d lines, see raw_log)", k)).select(*KEY)


def gcc_diagnostics(lines: DataFrame) -> DataFrame:
    """Lines of the one-line shape ``file:line[:column]: severity: message``."""
    part = lambda i: F.regexp_extract("line", P.GCC, i)
    return lines.where(F.col("line").rlike(P.GCC)).select("doc_id", "pos", part(1).alias("loc"), part(2).alias("severity"), F.trim(part(3)).alias("msg"))


#: Stands behind every line of a document: the head of its table, or all of it.
TABLE = 1 << 62
DIAGNOSTIC = [(c, "string") for c in ("loc", "severity", "msg")]


def _paragraph():
    return W.partitionBy("doc_id", "_par")


def compiler_blocks(lines: DataFrame) -> DataFrame:
    """Adds ``place`` (from 1), ``block`` (the place of its header, or null) and
    ``arrow`` (how far behind the header its place is named).

    A header counts if its arrow is one or two lines below. Its block ends with
    the paragraph of the arrow, the blank line included, so blocks are islands of
    paragraphs: from the first header on within one, or the whole next one if
    only a blank line parts header and arrow. Such a header stands at the end of
    its paragraph and counts unless that is itself part of a block; along a row
    of paragraphs that all end so, every second one does.
    """
    order = in_order()
    line, next_, after = F.col("line"), F.lead("line", 1).over(order), F.lead("line", 2).over(order)
    says = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False))
    blank = ~line.rlike(r"(?U)\S")
    off = F.when(says(next_, P.ARROW), 1).when(says(after, P.ARROW), 2)
    head = ~line.rlike(P.GCC) & line.rlike(P.RUSTC)
    rows = lines.withColumns({
        "place": F.row_number().over(order),
        "_blank": blank,
        "_off": F.when(head, off),
        "_apart": head & (off == 2) & ~says(next_, r"(?U)\S"),
        "_par": F.coalesce(F.sum(blank.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    })
    whole = F.col("_off").isNotNull() & ~F.coalesce("_apart", F.lit(False))
    rows = rows.withColumns({
        "_first": F.min(F.when(whole, F.struct("place", "_off"))).over(_paragraph()),
        "_reaches": F.max(F.coalesce("_apart", F.lit(False))).over(_paragraph()),
        "_start": F.min("place").over(_paragraph()),
    })
    reaches = F.col("_reaches") & F.col("_first").isNull()
    firm = F.max(F.when(~reaches, F.col("_par"))).over(by_doc().orderBy("_par").rangeBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_taken", (F.col("_par") - 1 - F.coalesce(firm, F.lit(-1))) % 2 == 1)
    place = F.col("place")
    block = (
        F.when(F.col("_taken"), F.col("_start") - 2)
        .when(F.col("_first").isNotNull(), F.when(place >= F.col("_first.place"), F.col("_first.place")))
        .when(reaches & F.coalesce("_apart", F.lit(False)), place)
        .when(reaches & F.col("_blank"), place - 1)
    )
    arrow = F.when(~F.col("_taken") & F.col("_first").isNotNull(), F.col("_first._off")).otherwise(2)
    return rows.withColumns({"block": block, "arrow": arrow}).drop("_off", "_apart", "_par", "_first", "_reaches", "_start", "_taken")


def extract_diagnostics(lines: DataFrame) -> DataFrame:
    """:func:`diagnostic_rows`, the table as one row at ``TABLE``."""
    place = F.least("pos", F.lit(TABLE)).alias("pos")
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    got = diagnostic_rows(lines).groupBy("doc_id", place).agg(parts.alias("parts"), F.max("term").alias("term"))
    return got.select("doc_id", "pos", F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("line"), "term")


def diagnostic_rows(lines: DataFrame) -> DataFrame:
    """Documents with at least three compiler diagnostics: their other lines, and
    the diagnostics as a table from ``TABLE`` on, a row for each of its lines, so
    that no row holds more than a block. Others as they are.

    A block gives its message, the first label and its asides, each once; other
    lines of it stay only if they signal an error and draw nothing. All lines end
    in the document's separator; an empty last line goes.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    line, order = F.col("line"), in_order()
    part = lambda c, pattern, i: F.regexp_extract(c, pattern, i)
    rows = compiler_blocks(lines)
    starts = F.coalesce(F.col("block") == F.col("place"), F.lit(False))
    plain = F.col("block").isNull() & line.rlike(P.GCC)
    rows = rows.withColumns({
        "_starts": starts,
        "_gcc": plain,
        "_at": F.when(F.col("arrow") == 1, F.lead("line", 1).over(order)).otherwise(F.lead("line", 2).over(order)),
        "_many": F.count_if(starts | plain).over(by_doc()) >= MIN_DIAGNOSTICS,
        "_sep": F.when(F.max((F.col("term") == "\r\n").cast("int")).over(by_doc()) == 1, "\r\n").otherwise("\n"),
    })
    inside = F.col("block").isNotNull() & (F.col("place") > F.col("block") + F.col("arrow")) & ~F.col("_blank")
    aside = line.rlike(P.ASIDE)
    label = ~aside & line.rlike(P.LABEL)
    loud = inside & ~aside & ~label & ~line.rlike(P.SCAFFOLD) & T.is_error_line("line")
    stays = ~F.col("_many") | (F.col("block").isNull() & ~F.col("_gcc")) | loud
    code = part(line, P.RUSTC, 2)
    severity = F.concat(part(line, P.RUSTC, 1), F.when(code != "", F.concat(F.lit("["), code, F.lit("]"))).otherwise(""))
    one = lambda *values: F.struct(F.col("place").alias("at"), *(v.alias(n) for v, n in zip(values, ("loc", "severity", "msg"))))
    text = lambda c: F.struct(F.col("place").alias("at"), c.alias("text"))
    last = F.max(F.when(stays, F.col("pos"))).over(by_doc())
    rows = rows.withColumns({"_stays": stays, "_last": last, "_all": F.count_if(starts | plain).over(by_doc())})
    rows = rows.withColumn("_stays", F.col("_stays") & ~((F.col("pos") == F.col("_last")) & (line == "")))
    # a block is one group, any other line is one of its own
    groups = rows.groupBy("doc_id", F.coalesce(F.when(F.col("_many"), F.col("block")), F.col("place")).cast("long").alias("_at")).agg(
        F.collect_list(F.when(F.col("_stays"), F.struct("pos", "line", F.col("_sep").alias("term")))).alias("body"),
        F.max(F.when(F.col("_many") & F.col("_gcc"), one(part(line, P.GCC, 1), part(line, P.GCC, 2), strip(part(line, P.GCC, 3))))).alias("plain"),
        F.max(F.when(F.col("_many") & F.col("_starts"), one(part("_at", P.ARROW, 1), severity, strip(part(line, P.RUSTC, 3))))).alias("head"),
        F.collect_list(F.when(F.col("_many") & inside & aside, text(F.concat(part(line, P.ASIDE, 1), F.lit(": "), strip(part(line, P.ASIDE, 2)))))).alias("asides"),
        F.min(F.when(F.col("_many") & inside & label, text(strip(part(line, P.LABEL, 1))))).alias("label"),
        F.max(F.when(F.col("_many") & (F.col("place") == 1), F.col("_all"))).alias("n"),
    )
    extras = F.array_sort(F.concat("asides", F.filter(F.array("label"), lambda x: x.isNotNull())))
    msg = F.concat_ws("; ", F.array(F.col("head.msg")), F.array_distinct(F.transform(extras, lambda x: x["text"])))
    block = F.struct(F.col("head.at").alias("at"), F.col("head.loc").alias("loc"), F.col("head.severity").alias("severity"), msg.alias("msg"))
    groups = groups.withColumn("one", F.when(F.col("head").isNotNull(), block).otherwise(F.col("plain")))
    extra = lambda at, line: F.struct(at.cast("long").alias("pos"), line.alias("line"), F.lit("").alias("term"))
    head = F.when(F.col("n").isNotNull(), F.array(extra(F.lit(TABLE), table_head("diagnostics", DIAGNOSTIC, F.col("n")))))
    told = F.when(F.col("one").isNotNull(), F.array(extra(F.lit(TABLE) + F.col("one.at"), table_row(DIAGNOSTIC, F.col("one")))))
    none = F.array().cast("array<struct<pos:bigint,line:string,term:string>>")
    return groups.select("doc_id", F.inline(F.concat("body", F.coalesce(told, none), F.coalesce(head, none))))


def join_with_table(lines: DataFrame) -> DataFrame:
    """(doc_id, text): lines joined by the separator, then the table if there is one."""
    is_table = F.col("pos") >= TABLE
    part = lambda which: F.sort_array(F.collect_list(F.when(which, F.struct("pos", "line"))))
    got = lines.groupBy("doc_id").agg(
        part(~is_table).alias("body"),
        part(is_table).alias("table"),
        F.when(F.max((F.col("term") == "\r\n").cast("int")) == 1, "\r\n").otherwise("\n").alias("sep"),
    )
    table = F.when(F.size("table") > 0, F.array_join(F.transform("table", lambda x: x["line"]), "\n"))
    got = got.select("doc_id", "sep", F.expr("array_join(transform(body, x -> x.line), sep)").alias("body"), table.alias("table"))
    text = F.when(F.col("table").isNull(), F.col("body")).when(~F.col("body").rlike(r"(?U)\S"), F.col("table")).otherwise(F.concat("body", "sep", "table"))
    return got.select("doc_id", text.alias("text"))


def safe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The safe rules, as a line frame."""
    lines = to_lines(docs.select(F.col(doc_id).alias("doc_id"), strip_escapes(text).alias("text")))
    return collapse_repeats(collapse_blanks(collapse_progress(lines)))


def compress(docs: DataFrame, level: str = "safe", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) of each non-empty document at ``safe`` or ``aggressive``."""
    if level not in ("safe", "aggressive"):
        raise ValueError("level is safe or aggressive")
    lines = safe(docs, text, doc_id)
    if level == "safe":
        return join_lines(lines)
    # one partitioning by document for all rules
    return join_with_table(window_errors(diagnostic_rows(collapse_near_dups(filter_levels(lines)))))


def bounded(docs: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """(doc_id, text): documents above ``limit`` bytes cut by ``large_window``."""
    return docs.select("doc_id", large_window("text", limit).alias("text"))


def reduce_logs(docs: DataFrame, level: str = "safe", text: str = "text", doc_id: str = "doc_id", limit: int | None = 4 << 20) -> DataFrame:
    """What is emitted for each document: the reduction if it saves tokens.

    Documents above ``limit`` bytes are cut first; None: every line goes through
    the rules. Columns: doc_id, emitted, tokens_in, tokens_out, compressed.
    """
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_raw"))
    whole = raw.select("doc_id", F.col("_raw").alias("text"))
    small = compress(whole if limit is None else bounded(whole, limit), level).withColumnRenamed("text", "_small")
    both = raw.join(small, "doc_id", "left")
    tokens_in, tokens = T.approx_tokens("_raw"), T.approx_tokens(F.coalesce("_small", "_raw"))
    better = T.pays(tokens, tokens_in)
    return both.select("doc_id", F.when(better, F.col("_small")).otherwise(F.col("_raw")).alias("emitted"), tokens_in.alias("tokens_in"), F.least(tokens, tokens_in).alias("tokens_out"), better.alias("compressed"))
