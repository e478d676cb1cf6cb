"""What is shown of a run, and reports across archived runs."""

import json

from pyspark.sql import functions as F

from runlens.operators import emit as E
from runlens.operators import history as H
from runlens.sources import logs

RUNS = "run_id long, stdout string, stderr string, raw_log string, interrupted string"


def test_emit(spark):
    noise = "".join(f"progress {i % 2}\n" * 30 for i in range(4))
    doc = json.dumps([{"name": f"n{i}", "value": i} for i in range(30)], indent=2)
    rows = [
        (0, noise, "", "/r/0", None), (1, doc + "\n", "", "/r/1", "SIGINT"), (2, "plain\n", "", "/r/2", None), (3, noise, "", None, None),
        (4, "plain\n", noise, "/r/4", None), (5, '{"a":1}\n{"a":2}\n' * 9, "", "/r/5", None), (6, None, None, "/r/6", None), (7, noise, noise, "/r/7", None),
    ]
    frame = spark.createDataFrame(rows, RUNS)
    got = {r.run_id: r for r in E.emit(frame).collect()}
    assert len(got) == 8
    assert got[0].out.startswith("progress 0\n  (x30)\n") and got[0].out.endswith("\nraw_log: /r/0\n") and got[0].mode == "safe"
    assert got[1].out.startswith("[30]{name,value}:\n  n0,0\n") and got[1].out.endswith("\nraw_log: /r/1\ninterrupted: SIGINT\n") and got[1].mode == "json"
    assert (got[2].out, got[2].mode, got[2].tokens_in) == ("plain\n", "passthrough", 1)
    assert (got[3].out, got[3].mode) == (noise, "passthrough")  # nothing may be lost without a raw log
    assert got[4].out == "plain\n" and got[4].err.endswith("raw_log: /r/4") and got[4].mode == "safe"
    assert got[5].out.startswith("[18]{a}:\n  1\n") and got[5].mode == "json"
    assert (got[6].out, got[6].err, got[6].tokens_out) == ("", "", 0)
    assert "raw_log" in got[7].out and "raw_log" not in got[7].err and got[7].err.startswith("progress 0\n  (x30)\n")
    assert {r.run_id: r.mode for r in E.emit(frame, keep_runs=0).collect()}[3] == "safe"
    for r in E.emit(frame, max_tokens=40).collect():
        assert (len(r.out.encode()) // 4) + (len(r.err.encode()) // 4) <= 40 and r.tokens_out <= 40
        assert r.run_id != 2 or r.out == "plain\n"


def test_guard_counts_close_calls(spark):
    """An estimate within a fifth is not enough: words are counted then."""
    words = lambda c: F.size(F.split(c, " ")).cast("long")
    rows = spark.createDataFrame([("a b c d e f g", "aaaa bbbbbbbb"), ("aaaa", "b " * 40)], "cand string, orig string")
    plain = [r.g.pays for r in rows.select(E.guarded(F.col("cand"), F.col("orig")).alias("g")).collect()]
    exact = [(r.g.pays, r.g.tokens) for r in rows.select(E.guarded(F.col("cand"), F.col("orig"), words).alias("g")).collect()]
    assert plain == [False, True] and exact == [(False, 7), (True, 1)]


def test_footers(spark):
    none = F.lit(None).cast("string")
    one = spark.range(1).select(
        E.report_footers(F.lit(2), F.lit("fixed 1; still 0; new 0"), F.lit("/r/x"), F.lit("tail -5"), F.lit("SIGTERM")).alias("all"), E.report_footers(F.lit(0), none, none, none, none).alias("none"),
        E.explains_failure(F.lit(0), F.lit(2)).alias("errors"), E.explains_failure(F.lit(0), F.lit(None).cast("long")).alias("silent"),
    ).first()
    assert one["all"] == '\nexit_code: 2\nvs_previous: fixed 1; still 0; new 0\nraw_log: /r/x\npipe_filter_dropped: tail -5\ninterrupted: SIGTERM'
    assert one["none"] == "" and one.errors and not one.silent


ITEM = "struct<id:string,loc:string,rule:string,msg:string>"


def archive_of(spark):
    metas = [
        ("20240101-000000-0001", ["make", "a b"], 1, "/w"), ("20240102-000000-0001", ["make", "a  b"], 1, "/w"), ("20240103-000000-0001", ["ruff"], 0, "/w"),
        ("20240104-000000-0001", ["make", "a b"], 2, "/w"), ("20240105-000000-0001", ["make", "a b"], 2, "/other"), ("20240106-000000-0001", ["ls", "it's"], 0, "/w"),
    ]
    rows = [(i, "ts" + i[6:8], a, "safe", e, c, 10, 20, None) for i, a, e, c in metas]
    frame = spark.createDataFrame(rows, "id string, ts string, argv array<string>, mode string, exit int, cwd string, stdout_bytes long, stderr_bytes long, mtime timestamp")
    t = lambda *ids: [(i, "", "", "m " + i) for i in ids]
    reports = [
        ("20240101-000000-0001", "tests", "pytest", 2, 9, t("a", "b"), "first\n\n"), ("20240102-000000-0001", "tests", "pytest", 2, 5, t("b", "c"), "second\n"),
        ("20240104-000000-0001", "diagnostics", "cargo", 1, None, [("", "x.c:1", "E1", "bad")], "third"), ("20240105-000000-0001", "tests", "pytest", 1, 5, t("z"), "fourth"),
    ]
    return frame, spark.createDataFrame(reports, f"run_id string, kind string, runner string, failed long, total long, items array<{ITEM}>, rendered string")


def test_history(spark):
    metas, reports = archive_of(spark)
    text = H.render_list(metas, most=2).first().text
    assert text == 'runs[2]{id,ts,cmd,mode,exit}:\n  20240106-000000-0001,ts06,"ls \'it\'\\\\\'\'s\'",safe,0\n  20240105-000000-0001,ts05,make \'a b\',safe,2'
    assert H.render_list(metas, "a  b").first().text.count("\n") == 1
    assert H.render_last(metas, reports, "/runs", "make").first().text == "fourth\nrun: 20240105-000000-0001\ncommand: make 'a b'\nexit_code: 2\nraw_log: /runs/20240105-000000-0001"
    assert H.render_last(metas, reports, "/runs").first().text.endswith("mode: safe\nexit_code: 0\nstdout_bytes: 10\nstderr_bytes: 20\nraw_log: /runs/20240106-000000-0001\nnote: no adapter report for this run; its raw log is kept as run 20240106-000000-0001")
    assert H.render_last(metas, reports, "/runs", "nothing").count() == 0
    pairs = H.comparable_pairs(metas, reports)
    assert {(r.previous.id[7], r.current.id[7], r.same_kind, r.fewer) for r in pairs.collect()} == {("1", "2", True, True), ("2", "4", False, False)}
    assert {r.run_id[7]: r.summary for r in H.vs_previous(pairs).collect()} == {"2": "fixed or not run 1; still 1; new 1", "4": None}
    full = {r.run_id[7]: r.text for r in H.render_diff(pairs).collect()}
    assert full["4"].startswith("run 20240102-000000-0001 reported tests but run 20240104-000000-0001 reported diagnostics")
    assert full["2"] == (
        "command: make 'a  b'\nprevious:\n  id: 20240101-000000-0001\n  exit: 1\n  failed: 2\ncurrent:\n  id: 20240102-000000-0001\n  exit: 1\n  failed: 2\n"
        'still_failing[1]{id,loc,msg}:\n  b,"",m b\nnew_failures[1]{id,loc,msg}:\n  c,"",m c\n'
        'note: "current run executed 5 tests vs 9 before (stopped early or filtered): previous failures it lacks may not have run"\nfixed_or_not_run[1]{id,loc}:\n  a,""'
    )


def test_run_ids(spark):
    rows = spark.createDataFrame([(k, "2024-01-02 03:04:05") for k in range(20)] + [(99, "2024-01-02 03:04:06")], "k int, at string").withColumn("ts", F.to_timestamp("at"))
    ids = [r.id for r in H.run_ids(rows).collect()]
    assert len(set(ids)) == 21 and all(len(i) == 20 for i in ids) and max(ids) == "20240102-030406-0000" and "20240102-030405-0013" in ids


def test_archive_round_trip(spark, tmp_path):
    root = str(tmp_path / "runs")
    runs = spark.createDataFrame([(f"2024010{k}-000000-aaaa", "t", ["make", str(k)], "safe", k, "/w", out, err) for k, (out, err) in enumerate([("one\n", ""), ("two\nlines", "é\n"), ("", None)])] + [("../evil", "t", [], "safe", 0, "/", "x", "y")], "id string, ts string, argv array<string>, mode string, exit int, cwd string, stdout string, stderr string")
    logs.write_archive(runs, root)
    logs.write_reports(archive_of(spark)[1].where("failed = 1").withColumn("run_id", F.lit("20240101-000000-aaaa")).limit(1), root)
    got = {r.id: r for r in logs.archive(spark, root).collect()}
    assert [(got[i].exit, got[i].argv, got[i].stdout_bytes, got[i].stderr_bytes) for i in sorted(got)] == [(0, ["make", "0"], 4, 0), (1, ["make", "1"], 9, 3), (2, ["make", "2"], 0, 0)]
    assert {(r.doc_id[7], r.stream, r.text) for r in logs.run_lines(spark, root).where("text <> ''").collect()} == {("0", "stdout", "one\n"), ("1", "stdout", "two\nlines"), ("1", "stderr", "é\n")}
    one = logs.load_run(spark, root, "20240101-000000-aaaa").first()
    assert (one.exit, one.stdout, one.stderr) == (1, "two\nlines", "é\n")
    shown = H.render_run(logs.load_run(spark, root, "20240101-000000-aaaa")).first().text
    assert shown == "id: 20240101-000000-aaaa\nts: t\ncmd: make 1\nmode: safe\nexit: 1\n--- stdout ---\ntwo\nlines\n--- stderr ---\né\n"
    assert [(r.run_id, r.failed) for r in logs.reports(spark, root).collect()] == [("20240101-000000-aaaa", 1)]
    try:
        logs.load_run(spark, root, "../x")
        raise AssertionError("a path is no id")
    except ValueError:
        pass


def test_ledger_of_files(spark, tmp_path):
    """Rotation, gaps in seq, and three failures in a row across files and glued records."""
    from runlens.operators import ledger as L

    path = str(tmp_path / "stats.jsonl")
    row = lambda cmd, e: (cmd, "x", 5, 1, 4, e)
    frame = lambda rows: spark.createDataFrame(rows, "cmd string, adapter string, tokens_in long, tokens_out long, saved long, exit int").coalesce(1)
    logs.append_ledger(frame([row("a", 1), row("b", 1)]), path)
    logs.append_ledger(frame([row("b", 1)]), path, most=1)
    logs.append_ledger(frame([row("b", 1), row("c", 0)]), path)
    (tmp_path / "stats.jsonl.bak").write_text("not read\n")
    rows = logs.ledger(spark, path)
    assert [r.cmd for r in rows.orderBy("seq", "part").collect()] == ["a", "b", "b", "b", "c"]
    assert [r.cmd for r in L.repeat_failures(rows).collect()] == ["b"]
    one = lambda cmd, e: json.dumps({"cmd": cmd, "tokens_in": 5, "exit": e})
    text = [one("x", 1) + one("x", 1), "", "{broken", one("x", 1), one("y", 1), one("y", 0), one("y", 1), one("y", 1), one("z", 1) + one("z", 1) + one("z", 1) + one("z", 1)]
    parsed = logs.parse_ledger(spark.createDataFrame([(70_000 * i, t) for i, t in enumerate(text)], "seq long, line string"))
    assert {(r.cmd, r.seq // 70_000) for r in L.repeat_failures(parsed).collect()} == {("x", 3), ("z", 8)}
    assert {(r.cmd, r.seq // 70_000) for r in L.repeat_failures(parsed, stretch=1).collect()} == {("x", 3), ("z", 8)}
