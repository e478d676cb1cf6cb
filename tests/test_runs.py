import datetime as dt

from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.operators import ledger as L
from runlens.operators import runs as R


def items(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx int, id string, loc string, rule string, msg string")


def test_diff_is_a_bag(spark):
    old = items(spark, [("t1", "", "", ""), ("t1", "", "", ""), ("", "a.c:1:2", "R", "m"), ("t9", "", "", "")])
    new = items(spark, [("t1", "", "", ""), ("", "a.c:77:1", "R", "m"), ("t2", "", "", "")])
    got = sorted((r.status, r.id or r.loc) for r in R.diff(old, new).collect())
    assert got == [("fixed", "t1"), ("fixed", "t9"), ("new", "t2"), ("still", "a.c:77:1"), ("still", "t1")]
    assert R.versus_previous(R.diff(old, new)).first().summary == "fixed 2; still 2; new 1"
    assert R.versus_previous(R.diff(old.limit(0), new.limit(0))).count() == 0


def test_prune(spark):
    rows = [("r", f"20240101-0000{i:02d}-abcd", 100) for i in range(10)]
    now = F.lit("2024-02-01").cast("timestamp")
    runs = spark.createDataFrame(rows, "root string, id string, size long")
    gone = lambda **k: [r.id[11:15] for r in R.prune_plan(runs, now=now, **k).orderBy("id").collect()]
    assert gone(keep_runs=8, max_bytes=10**9) == ["0000", "0001"][:0] + [x[11:15] for _, x, _ in rows[:2]]
    assert len(gone(keep_runs=100, max_bytes=350)) == 5  # size alone never goes below five
    assert gone(keep_runs=100, max_bytes=10**9) == []
    young = F.lit(dt.datetime(2024, 1, 1, 0, 0, 30)).cast("timestamp")
    assert R.prune_plan(runs, 1, 0, young).count() == 0


def test_grep(spark):
    text = [("o", i, f"l{i}" + (" hit" if i in (2, 3, 9) else "")) for i in range(12)]
    rows = spark.createDataFrame([(1, "stdout" if s == "o" else "stderr", p, x) for s, p, x in text], "doc_id long, stream string, pos long, line string")
    got = R.render_grep(R.grep(rows, "hit", context=1)).first().text
    assert got == "--- stdout (3 matches) ---\n2:l1\n3:l2 hit\n4:l3 hit\n5:l4\n...\n9:l8\n10:l9 hit\n11:l10\n"
    cut = R.render_grep(R.grep(rows, "hit", quota=2)).first().text
    assert cut.endswith("  (showing 2 of 3 matches)\n") and "l9" not in cut


def test_ledger(spark):
    rows = [(i, "2024-01-01T00:00:00Z", c, a, n, n, 0, e) for i, (c, a, n, e) in enumerate([("x", "passthrough", 900, 1)] * 3 + [("y", "pytest", 9000, 0)])]
    frame = spark.createDataFrame(rows, "seq long, ts string, cmd string, adapter string, tokens_in long, tokens_out long, saved long, exit int").withColumn("inner_cmd", F.lit(None).cast("string"))
    assert [(r.cmd, r.calls) for r in L.wasters(frame).collect()] == [("x", 3)]
    assert [(r.cmd, r.seq) for r in L.repeat_failures(frame).collect()] == [("x", 2)]
    assert {r.adapter: r.calls for r in L.stats(frame).collect()} == {"passthrough": 3, "pytest": 1}
    bad = frame.withColumn("ts", F.lit("never"))
    assert L.since(bad, F.lit("2020-01-01").cast("timestamp")).count() == 0


def test_scalars(spark):
    one = spark.range(1).select(
        T.file_of(F.lit("a/b.c:10:2")).alias("f"), T.basename(F.lit("a/b\\c.txt")).alias("b"), T.relativize(F.lit("at /w/x.py and file:///w/y.py, /a/w/z.py"), "/w").alias("r"),
        T.wildcard(F.lit("git push origin"), F.lit("git push*")).alias("w"), T.wildcard(F.lit("a%b"), F.lit("a_b")).alias("v"), T.clock_seconds(F.lit("01:02:03.5")).alias("s"),
        T.inner_command(F.array(F.lit("/bin/sh"), F.lit("-c"), F.lit("A=1 cargo test | tail"))).alias("i"), T.run_time(F.lit("20240102-030405-ab12")).cast("string").alias("t"),
        T.strip_variant(F.lit("p/q [p/q.test]")).alias("p"), T.round_duration(F.lit(float("nan"))).alias("d"), T.is_json_document(F.lit('{"a":1}\n[2]\n')).alias("j"), T.is_json_document(F.lit('{"a":1}\nx')).alias("k"),
    ).first()
    assert (one.f, one.b, one.r) == ("a/b.c", "c.txt", "at x.py and y.py, /a/w/z.py")
    assert one.w and not one.v and one.s == 3723.5 and one.i == "cargo" and one.t == "2024-01-02 03:04:05" and one.p == "p/q" and one.d == 0.0 and one.j and not one.k


def test_ledger_reports(spark):
    from runlens.operators import render

    rows = [(i, c, a, n, n, e, k) for i, (c, a, n, e, k) in enumerate([("x", "passthrough", 900, 1, None)] * 3 + [("sh", "passthrough", 2000, 0, "cargo")] + [("y", "pytest", 9000, 0, None)])]
    frame = spark.createDataFrame(rows, "seq long, cmd string, adapter string, tokens_in long, tokens_out long, exit int, inner_cmd string").withColumn("saved", F.lit(5).cast("long"))
    assert render.render_stats(frame).first().text == "calls: 5\ntokens_saved: 25\nsaved_vs_visible: 0\nby_adapter[2:]{calls,saved}:\n  passthrough: 4,20\n  pytest: 1,5"
    got = [(r.kind, r.cmd) for r in render.suggestions(frame).orderBy("rank").collect()]
    assert got == [("token_waster", "x"), ("shell_string", "cargo"), ("repeat_failure", "x")]
    text = render.render_suggestions(frame).first().text
    assert text.startswith("analyzed_calls: 5\ntokens_saved: 25\nsuggestions[3]:\n  - kind: token_waster\n    cmd: x\n")
    assert render.render_suggestions(frame.where("cmd = 'y'")).first().text == "analyzed_calls: 1\ntokens_saved: 5\nverdict: no waste detected"


def test_rendered_delta(spark):
    from runlens.operators import render

    old, new = items(spark, [("t1", "", "", "m"), ("t2", "", "", "")]), items(spark, [("t1", "", "", "m")])
    text = render.render_delta(R.diff(old, new), fewer=True).first().text
    assert text == 'summary:\n  fixed: 1\n  still: 1\n  new: 0\nfixed_or_not_run[1]{id,loc,rule,msg}:\n  t2,"","",""\nstill[1]{id,loc,rule,msg}:\n  t1,"","",m'
