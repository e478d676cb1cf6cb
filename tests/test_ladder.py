"""Line rules against hand-written cases and small Python models."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.operators import budget, ladder, lines


def apply(spark, rule, text):
    rows = lines.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = lines.join_lines(rule(rows)).collect()
    return got[0]["text"] if got else ""


def check(spark, function, cases):
    """Expected values of one column function, in one job."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, want string")
    bad = rows.withColumn("got", function("a").cast("string")).where(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert not bad


def test_escapes(spark):
    check(spark, ladder.strip_escapes, [("\x1b[1;31mred\x1b[0m", "red"), ("a\x1b]8;;http://x\x1b\\link\x1b]8;;\x07b", "alinkb"), ("\x1b]0;t\ni\x07z", "z"), ("\x1b(B\x1b=plain", "plain")])


def test_lines_keep_their_ends(spark):
    text = "a\r\nb\n\nc\r\r\nd"
    got = lines.to_lines(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id", "pos").collect()
    assert [(r.line, r.term) for r in got] == [("a", "\r\n"), ("b", "\n"), ("", "\n"), ("c\r", "\r\n"), ("d", "")]
    assert apply(spark, lambda d: d, text) == text


def test_repeats(spark):
    assert apply(spark, ladder.collapse_repeats, "a\na\na\nb\n\nb\n") == "a\n  (x3)\nb\n\nb\n"
    assert apply(spark, ladder.collapse_repeats, "x\r\nx") == "x\r\n  (x2)"


def test_blanks(spark):
    assert apply(spark, ladder.collapse_blanks, "\n\na\n\n\n \n\nb") == "\na\n\n \n\nb"


def test_progress(spark):
    bars = "pull [####    ] 10%\npull [######  ] 60%\npull [########] 100%\ndone\n"
    assert apply(spark, ladder.collapse_progress, bars) == "pull [########] 100%\n  (x3 progress frames, last kept)\ndone\n"
    assert apply(spark, ladder.collapse_progress, "GPU0 util: 12%\nGPU1 util: 99%\n") == "GPU0 util: 12%\nGPU1 util: 99%\n"
    # an unterminated last frame gets an end before its marker
    assert apply(spark, ladder.collapse_progress, "####  1%\n####  2%") == "####  2%\n  (x2 progress frames, last kept)"


def test_redraw(spark):
    check(spark, ladder.redraw_final, [("10%\r50%\r100%", "100%"), ("plain\r", "plain\r"), ("a\r\r", "a\r\r"), ("a\rb\r", "b"), ("\rb", "b")])


def test_levels(spark):
    quiet = "".join(f"2024-01-01 00:00:{i:02d} INFO step {i}\n" for i in range(12))
    text = quiet + "2024-01-01 00:01:00 ERROR bad\n"
    got = ladder.filter_levels(lines.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    out = [r.line for r in got.orderBy("pos").collect()]
    assert out == ["  (filtered 10 INFO lines, see raw_log)", "2024-01-01 00:00:10 INFO step 10", "2024-01-01 00:00:11 INFO step 11", "2024-01-01 00:01:00 ERROR bad"]
    few = "INFO a\n" * 9
    assert apply(spark, ladder.filter_levels, few) == few
    check(spark, T.level_of, [("[2024-01-01T00:00:00Z] WARNING x", "WARN"), ("CRITICAL", "FATAL"), ("INFORMATION", None), ("  DEBUG: y", "DEBUG")])


def test_near_dups(spark):
    def lines_of(text):
        got = ladder.collapse_near_dups(lines.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
        return [r.line for r in got.orderBy("pos").collect()]

    assert lines_of("get 1 status 200\nget 2 status 500\nget 3 status 200\n") == ["get 1 status {200,500}", "  (x3 similar)"]
    assert lines_of("a 1\na 2\n") == ["a 1", "a 2"]
    assert lines_of("error 1\nerror 2\nerror 3\n") == ["error 1", "error 2", "error 3"]
    assert lines_of("".join(f"v {x}\n" for x in (9, 1, 2, 3, 4, 5, 6, 7))) == ["v {9,1,2,3,4,5,…+2}", "  (x8 similar)"]
    assert lines_of("id deadbeef01 k\nid deadbeef02 k\nid deadbeef03 k\n") == ["id deadbeef01 k", "  (x3 similar)"]
    big = "9" * 38
    assert lines_of(f"n 7 x\nn {big} x\nn 1{big} x\n") == ["n 7 x", "  (x3 similar)"]


def test_error_lines(spark):
    yes = ["an Error here", "npm ERR! x", "Killed", "E   assert", "KeyError: x", "java.lang.NullPointerException", "was not found", "2 failures"]
    no = ["terror", "failover", "errorless", "killed", "é_fail_", "all good"]
    check(spark, T.is_error_line, [(x, "true") for x in yes] + [(x, "false") for x in no])


def test_window(spark):
    text = "".join(f"line {i}\n" for i in range(100)).replace("line 50\n", "panic: line 50\n")
    got = ladder.window_errors(lines.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("pos").collect()
    out = [r.line for r in got]
    assert out[15] == "  (skipped 32 lines, see raw_log)" and out[23] == "  (skipped 31 lines, see raw_log)"
    assert len(out) == 15 + 1 + 7 + 1 + 15
    short = "x\n" * 79
    assert apply(spark, ladder.window_errors, short) == short


RUSTC = """   Compiling a
error[E0308]: mismatched types
 --> src/a.rs:2:5
  |
2 |     1
  |     ^ expected `String`
  = note: expected one thing
  = help: try this

a.c:3:4: warning: unused
b.c:1:1: error: bad
error: could not compile
"""


def split(spark, text):
    """The lines that stay and the rows of the table."""
    got = ladder.extract_diagnostics(lines.to_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("pos").collect()
    table = [r.line for r in got if r.pos == ladder.TABLE]
    return [r.line for r in got if r.pos < ladder.TABLE], table[0].splitlines()[1:] if table else None


def test_diagnostics(spark):
    body, table = split(spark, RUSTC)
    assert body == ["   Compiling a", "error: could not compile"]
    assert table == [
        '  "src/a.rs:2:5","error[E0308]","mismatched types; expected `String`; note: expected one thing; help: try this"',
        '  "a.c:3:4",warning,unused',
        '  "b.c:1:1",error,bad',
    ]
    assert split(spark, "a.c:3:4: warning: unused") == (["a.c:3:4: warning: unused"], None)


def header(n):
    return f"error: e{n}"


def arrow(n):
    return f"  --> f{n}.rs:{n}:1"


def test_diagnostic_blocks(spark):
    """Headers within a block, apart from their arrow by a blank line, one after the other."""
    gcc = ["x.c:1:1: error: one", "x.c:2:1: error: two", "x.c:3:1: error: three"]
    # a second header in one paragraph is part of the first one's block
    body, table = split(spark, "\n".join([*gcc, header(1), arrow(1), " | code", header(2), arrow(2), "panic: kept", "", "after"]))
    assert len(table) == 4 and '"f1.rs:1:1",error,e1' in table[3] and body == ["error: e2", "panic: kept", "after"]
    # a line between header and arrow belongs to the block
    body, table = split(spark, "\n".join([*gcc, header(1), "fatal: dropped", arrow(1), "", "after"]))
    assert len(table) == 4 and body == ["after"]
    # apart by a blank line: the whole next paragraph is the block, and a header at its end counts no more
    apart = [*gcc, header(1), "", arrow(1), "plain", header(2), "", arrow(2), "plain", header(3), "", arrow(3), "x", "", "after"]
    body, table = split(spark, "\n".join(apart))
    assert [t.split(",")[0].strip() for t in table[3:]] == ['"f1.rs:1:1"', '"f3.rs:3:1"']
    assert body == ["error: e2", arrow(2), "plain", "after"] or body == [arrow(2), "plain", "after"]
    # no arrow in time: an ordinary line
    body, table = split(spark, "\n".join([*gcc, header(1), "a", "b", arrow(1)]))
    assert len(table) == 3 and body == [header(1), "a", "b", arrow(1)]
    # labels: the first only; asides once each
    body, table = split(spark, "\n".join([*gcc, header(1), arrow(1), "1 | x", "  | ^ first", "  | ^ second", "  = note: n", "  = note: n", "help: h"]))
    assert table[3] == '  "f1.rs:1:1",error,"e1; first; note: n; help: h"' and body == []


def test_compress_keeps_failures(spark):
    text = "".join(f"2024-01-01 00:00:00 INFO poll {i % 5}\n" for i in range(200)) + RUSTC + "Traceback: KeyError: 'x'\n"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    small = ladder.compress(frame, "aggressive").first()["text"]
    assert "KeyError: 'x'" in small and '"b.c:1:1",error,bad' in small and len(small) < len(text) / 5
    out = ladder.reduce_logs(frame, "safe").first()
    assert out.tokens_out <= out.tokens_in
    with pytest.raises(ValueError):
        ladder.compress(frame, "other")


def model_safe(text):
    """The safe rules on plain lists: blanks, then repeats (no bars, no escapes)."""
    parts = []
    for x in text.split("\n")[:-1]:
        parts.append((x[:-1], "\r\n") if x.endswith("\r") else (x, "\n"))
    if tail := text.split("\n")[-1]:
        parts.append((tail, ""))
    kept = [p for i, p in enumerate(parts) if p[0] or not i or parts[i - 1][0]]
    out = ""
    i = 0
    while i < len(kept):
        j = i
        while j + 1 < len(kept) and kept[j + 1][0] == kept[i][0]:
            j += 1
        out += "".join(kept[i]) + (f"  (x{j - i + 1}){kept[j][1]}" if j > i else "")
        i = j + 1
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from(["", "a", "b", " ", "a ", "x y"]), st.sampled_from(["\n", "\r\n"])), max_size=12), min_size=20, max_size=40))
def test_safe_against_model(spark, texts):
    rows = [(i, "".join(a + b for a, b in t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in ladder.compress(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got.get(i, "") == model_safe(text)


def cap(spark, text, ceiling):
    return budget.cap_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), ceiling).first()["text"]


def test_budget(spark):
    assert cap(spark, "short", 10) == "short"
    text = "".join(f"line {i} of a long text\n" for i in range(200)).replace("line 90 of", "error 90 of")
    rows = spark.createDataFrame([(c, text, c) for c in (0, 5, 40, 100, 500)], "doc_id long, text string, most long")
    for r in budget.cap_tokens(rows, F.col("most")).collect():
        assert len(r.text.encode()) // 4 <= r.doc_id and (r.doc_id < 5) == (r.text == "")
    out = cap(spark, text, 300)
    kept = [x for x in out.splitlines() if "of a long" in x]
    assert kept[0].startswith("line 0 ") and kept[-1].startswith("line 199 ") and "omitted" in out
    at = kept.index("error 90 of a long text")
    assert kept[at - 1].startswith("line 89 ") and kept[at + 1].startswith("line 91 ")
    both = spark.range(1).select(budget.split_ceiling(F.lit(100), F.lit(10), 50).alias("s")).first().s
    assert (both.out, both.err) == (46, 4)


def test_budget_errors(spark):
    """Half the budget goes to error lines, in order; where three lines are too dear, the error alone."""
    long_ = "x" * 400
    rows = [long_ if i % 2 else f"error {i}" for i in range(200)]
    out = cap(spark, "\n".join(rows) + "\n", 200).splitlines()
    assert [x for x in out if x.startswith("error")] == [f"error {i}" for i in sorted({int(x.split()[1]) for x in out if x.startswith("error")})]
    assert long_ not in out and sum("omitted" in x or x.startswith("(+") for x in out) >= 2
    dropped = sum(int("".join(c for c in x if c.isdigit())) for x in out if not x.startswith("error"))
    assert dropped + sum(x.startswith("error") for x in out) == 200
    same = "".join(f"error {i}\n" for i in range(500))
    out = cap(spark, same, 200)
    assert out.startswith("error 0\nerror 1\n") and len(out.encode()) // 4 <= 200


def test_head_tail_and_cuts(spark):
    rows = lines.to_lines(spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string"))
    assert [r.line for r in lines.head(rows, 2).orderBy("pos").collect()] == ["a", "b"]
    assert [r.line for r in lines.tail(rows, 1).collect()] == ["c"]
    assert lines.head(rows, 0).count() == 0
    check(spark, lines.parse_line_cut, [("-n 5", "5"), ("-n7", "7"), ("-3", "3"), ("--lines=9", "9"), ("file", None)])


def test_large_window(spark):
    text = "".join(f"line {i}\n" for i in range(1000)).replace("line 500\n", "fatal 500\n").replace("line 501\n", "fatal 501\n")
    rows = spark.createDataFrame([(1, text), (2, "a\nb\n"), (3, None), (4, "é" * 3000)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in rows.select("doc_id", lines.large_window("text", limit=2000, head_bytes=200, tail_bytes=200, errors=1).alias("text")).collect()}
    out = got[1].splitlines()
    head, tail = [x for x in text.splitlines() if len("\n".join(text.splitlines()[: text.splitlines().index(x) + 1])) + 1 <= 200], [x for k, x in enumerate(text.splitlines()) if sum(len(y) + 1 for y in text.splitlines()[k:]) < 200]
    middle = 1000 - len(head) - len(tail)
    said = f"… {middle} lines (0.0 MB) of a 0.0 MB output omitted; 1 error line(s) from them follow (+1 more not shown) — full text in raw_log"
    assert out == [*head, said, "fatal 500", "… end of omitted section", *tail]
    assert got[2] == "a\nb\n" and got[3] is None and got[4].count("omitted") == 2
