"""Queries of the ledger and of questions across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import commands as C
from ..operators import history as H
from ..operators import judge as J
from ..operators import ledger as L
from ..operators import runs as R
from ..sources.logs import parse_ledger
from . import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {V.LEDGER_SQL}
SELECT adapter, count(*) AS calls, sum(saved)::BIGINT AS saved, sum(greatest(least(tokens_in, 7500) - tokens_out, 0))::BIGINT AS saved_vs_visible, min(seq) AS first_seq FROM ledger GROUP BY adapter""")
def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stats(V.ledger(spark, sf_dir))


@query(f"""WITH {V.LEDGER_SQL} SELECT seq, cmd, saved FROM ledger WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'""")
def ledger_since(spark, sf_dir):
    return L.since(V.ledger(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("seq", "cmd", "saved")


UNCOMPRESSED = "(adapter = 'passthrough' OR adapter = 'safe' AND greatest(tokens_in - tokens_out, 0) * 100 < tokens_in * 10)"


@query(f"""WITH {V.LEDGER_SQL}, g AS (
  SELECT cmd || '-' || (seq % 40) AS cmd, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, count(*) FILTER (adapter = 'passthrough') AS passes, min(seq) AS first_seq
  FROM ledger WHERE {UNCOMPRESSED} GROUP BY ALL)
SELECT cmd, calls, tokens_in, tokens_in // calls AS avg_tokens_in, CASE WHEN passes < calls THEN greatest(tokens_in - tokens_out, 0) * 100 // greatest(tokens_in, 1) END AS saved_percent, first_seq
FROM g WHERE calls >= 3 AND tokens_in // calls >= 500""")
def ledger_wasters(spark, sf_dir):
    rows = V.ledger(spark, sf_dir)
    return L.wasters(rows.withColumn("cmd", F.concat("cmd", F.lit("-"), (F.col("seq") % 40).cast("string"))))


@query(f"""WITH {V.LEDGER_SQL}
SELECT 'sh' AS cmd, coalesce(inner_cmd, '(unknown)') AS inner_cmd, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_in)::BIGINT // count(*) AS avg_tokens_in, min(seq) AS first_seq
FROM ledger WHERE cmd = 'view' AND {UNCOMPRESSED} GROUP BY 2""")
def ledger_shell_strings(spark, sf_dir):
    rows = V.ledger(spark, sf_dir)
    return L.shell_strings(rows.withColumn("cmd", F.when(F.col("cmd") == "view", "sh").otherwise(F.col("cmd"))))


@query(f"""WITH {V.LEDGER_SQL},
l AS (SELECT seq, cmd, exit <> 0 AS failed, lag(cmd) OVER (ORDER BY seq) AS c1, lag(cmd, 2) OVER (ORDER BY seq) AS c2, lag(exit) OVER (ORDER BY seq) AS e1, lag(exit, 2) OVER (ORDER BY seq) AS e2 FROM ledger)
SELECT cmd, min(seq) AS seq FROM l WHERE failed AND e1 <> 0 AND e2 <> 0 AND c1 = cmd AND c2 = cmd GROUP BY cmd""")
def ledger_repeat_failures(spark, sf_dir):
    return L.repeat_failures(V.ledger(spark, sf_dir))


@query(f"""WITH {V.LEDGER_SQL}
SELECT CASE WHEN inner_cmd IS NOT NULL AND cmd = 'sh' THEN 'sh -c ' || inner_cmd ELSE cmd END AS cmd, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in
FROM (SELECT * REPLACE (CASE cmd WHEN 'view' THEN 'sh' ELSE cmd END AS cmd) FROM ledger) WHERE saved <= 0 AND tokens_in >= 500 GROUP BY 1 ORDER BY tokens_in DESC, min(seq) LIMIT 5""")
def ledger_top_uncompressed(spark, sf_dir):
    rows = V.ledger(spark, sf_dir)
    return L.top_uncompressed(rows.withColumn("cmd", F.when(F.col("cmd") == "view", "sh").otherwise(F.col("cmd"))))


@query(f"WITH {V.LEDGER_SQL} SELECT count(*) FILTER (saved < 0) AS negative_saved, count(*) AS calls FROM ledger")
def ledger_negative_saved(spark, sf_dir):
    return L.negative_saved(V.ledger(spark, sf_dir))


@query(f"WITH {V.LEDGER_SQL} SELECT date_trunc('hour', ts) AS hour, adapter, count(*) AS calls, sum(saved)::BIGINT AS saved FROM ledger GROUP BY 1, 2")
def ledger_hourly(spark, sf_dir):
    """The streaming report, run as a batch."""
    return L.hourly(V.ledger(spark, sf_dir))


ITEMS_SQL = """
  items AS (SELECT user_id, event_id AS idx, CASE WHEN event_type = 'click' THEN '' ELSE event_type || ':' || json_extract_string(props, '$.k') END AS id,
                   'src/' || event_type || '.c:' || (event_id % 90) || ':3' AS loc, 'r' || (event_id % 4) AS rule, 'k ' || json_extract_string(props, '$.k') AS msg, ts < TIMESTAMP '2024-01-15 00:00:00' AS old FROM events),
  keyed AS (SELECT *, row_number() OVER (PARTITION BY old, key ORDER BY idx) AS n FROM (SELECT *, CASE WHEN id <> '' THEN id ELSE '|' || regexp_replace(loc, '(:[0-9]+)+$', '') || '|' || rule || '|' || msg END AS key FROM items))"""


@query(f"""WITH {ITEMS_SQL},
o AS (SELECT * FROM keyed WHERE old), c AS (SELECT * FROM keyed WHERE NOT old)
SELECT idx, id, loc, rule, msg, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.key = c.key AND o.n = c.n) THEN 'still' ELSE 'new' END AS status FROM c
UNION ALL SELECT idx, id, loc, rule, msg, 'fixed' FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE o.key = c.key AND o.n = c.n)""")
def run_diff(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    items = V.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), F.when(F.col("event_type") == "click", "").otherwise(F.concat("event_type", F.lit(":"), k)).alias("id"),
        F.concat(F.lit("src/"), "event_type", F.lit(".c:"), (F.col("event_id") % 90).cast("string"), F.lit(":3")).alias("loc"),
        F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")).alias("rule"), F.concat(F.lit("k "), k).alias("msg"), "ts",
    )
    old = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return R.diff(items.where(old).drop("ts"), items.where(~old).drop("ts"))


@query("""SELECT o_orderkey AS run, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS previous FROM orders""")
def previous_run(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    run_id = F.concat(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    metas = orders.select(run_id.alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("cwd"), F.lit(None).cast("timestamp").alias("mtime"))
    key = lambda c: F.substring_index(c, "-", -1).cast("long")
    return R.previous_run(metas).select(key("id").alias("run"), key("previous").alias("previous"))


@query(f"""WITH {V.DOC_LINES_SQL},
h AS (SELECT *, regexp_matches(line, '[0-9]{{2}}') AS match FROM doc_lines),
q AS (SELECT *, match AND sum(match::INT) OVER (PARTITION BY doc_id ORDER BY pos) <= 2 AS hit FROM h),
s AS (SELECT *, sum(match::INT) OVER (PARTITION BY doc_id) AS matches, sum(hit::INT) OVER (PARTITION BY doc_id) AS shown,
      max(hit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM q),
g AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 1, false) AS gap FROM s WHERE near = 1)
SELECT doc_id, 'stdout' AS stream, pos, line, hit, sum(gap::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS island, matches::BIGINT AS matches, shown::BIGINT AS shown FROM g""")
def grep_context(spark, sf_dir):
    rows = V.doc_lines(spark, sf_dir).withColumn("stream", F.lit("stdout"))
    return R.grep(rows, "[0-9]{2}", context=1, quota=2)


@query(f"""WITH {V.DOC_LINES_SQL},
h AS (SELECT *, regexp_matches(line, '[0-9]{{2}}') AS match FROM doc_lines),
q AS (SELECT *, match AND sum(match::INT) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 AS hit FROM h),
s AS (SELECT *, sum(match::INT) OVER (PARTITION BY doc_id) AS matches, sum(hit::INT) OVER (PARTITION BY doc_id) AS shown,
      max(hit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM q),
g AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 1, false) AS gap FROM s WHERE near = 1)
SELECT doc_id, '--- stdout (' || max(matches) || ' matches) ---' || chr(10) || string_agg(CASE WHEN gap THEN '...' || chr(10) ELSE '' END || (pos + 1) || ':' || line || chr(10), '' ORDER BY pos)
       || CASE WHEN max(shown) < max(matches) THEN '  (showing ' || max(shown) || ' of ' || max(matches) || ' matches)' || chr(10) ELSE '' END AS text
FROM g GROUP BY doc_id""")
def grep_report(spark, sf_dir):
    rows = V.doc_lines(spark, sf_dir).withColumn("stream", F.lit("stdout"))
    return R.render_grep(R.grep(rows, "[0-9]{2}", context=1))


@query("""
WITH o AS (SELECT o_custkey AS root, strftime(o_orderdate, '%Y%m%d-%H%M%S') || '-' || lpad(o_orderkey::VARCHAR, 12, '0') AS id, round(o_totalprice)::BIGINT AS size, o_orderdate AS made FROM orders),
n AS (SELECT *, count(*) OVER p - row_number() OVER w + 1 AS left_, lead(id) OVER w IS NULL AS newest FROM o WINDOW p AS (PARTITION BY root), w AS (PARTITION BY root ORDER BY id)),
b AS (SELECT *, sum(CASE WHEN newest THEN 0 ELSE size END) OVER (PARTITION BY root ORDER BY id DESC) AS bytes FROM n),
s AS (SELECT *, newest OR NOT (left_ > 12 OR (bytes > 900000 AND left_ > 5)) OR made > TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 60 SECOND AS stop FROM b)
SELECT root, id, size FROM (SELECT *, max(stop::INT) OVER (PARTITION BY root ORDER BY id) AS stopped FROM s) WHERE stopped = 0""")
def prune_plan(spark, sf_dir):
    run_id = F.concat(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    runs = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), run_id.alias("id"), F.round("o_totalprice").cast("long").alias("size"))
    return R.prune_plan(runs, keep_runs=12, max_bytes=900_000, now=F.lit("1998-06-01").cast("timestamp"))


@query("""
WITH d AS (SELECT l_orderkey AS file, l_partkey % 60 AS line, min('t' || l_linenumber) AS name FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL),
d1 AS (SELECT file, line, min(name) AS name FROM d GROUP BY ALL),
c AS (SELECT DISTINCT l_orderkey AS file, l_suppkey % 60 AS line FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT c.file, c.line, max(d1.line) AS declared, arg_max(d1.name, d1.line) AS name FROM c JOIN d1 ON c.file = d1.file AND d1.line <= c.line AND c.line - d1.line <= 10 GROUP BY 1, 2""")
def console_owner(spark, sf_dir):
    items = V.table(spark, sf_dir, "lineitem")
    declared = items.where("l_linenumber % 2 = 1").groupBy(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 60).alias("line")).agg(F.min(F.concat(F.lit("t"), F.col("l_linenumber").cast("string"))).alias("name"))
    calls = items.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("file"), (F.col("l_suppkey") % 60).alias("line")).distinct()
    return R.nearest_owner(calls, declared, ["file"])


@query("SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def merge_streams(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").where("text is not null")
    return R.merge_streams(rows.select("conv_id", F.col("turn").alias("seq"), F.concat("text", F.lit("\n")).alias("text")), "conv_id")


@query(f"""WITH {V.LEDGER_SQL}
SELECT seq // 3 AS line, cmd, adapter, tokens_in, saved, exit::INTEGER AS exit, false AS malformed FROM ledger
UNION ALL SELECT DISTINCT seq // 3, NULL, NULL, NULL::BIGINT, NULL::BIGINT, NULL::INTEGER, true FROM ledger WHERE (seq // 3) % 10 = 0""")
def ledger_parse(spark, sf_dir):
    """Three records glued to each line; every tenth line ends broken."""
    return parse_ledger(_glued(V.ledger(spark, sf_dir))).select(F.col("seq").alias("line"), "cmd", "adapter", "tokens_in", "saved", "exit", "malformed")


def _glued(rows: DataFrame) -> DataFrame:
    record = F.to_json(F.struct("seq", F.col("ts").cast("string").alias("ts"), "cmd", "adapter", "tokens_in", "tokens_out", "saved", "exit"))
    line = F.expr("seq div 3")
    parts = F.array_sort(F.collect_list(F.struct("seq", record.alias("r"))))
    glued = rows.groupBy(line.alias("n")).agg(F.array_join(F.transform(parts, lambda x: x["r"]), " ").alias("line"))
    return glued.select(F.col("n").alias("seq"), F.when(F.col("n") % 10 == 0, F.concat("line", F.lit("{broken"))).otherwise(F.col("line")).alias("line"))


@query(f"""WITH {V.LEDGER_SQL},
l AS (SELECT seq, cmd, exit <> 0 AS failed, lag(cmd) OVER (ORDER BY seq) AS c1, lag(cmd, 2) OVER (ORDER BY seq) AS c2, lag(exit) OVER (ORDER BY seq) AS e1, lag(exit, 2) OVER (ORDER BY seq) AS e2 FROM ledger)
SELECT cmd, min(seq // 3) AS seq FROM l WHERE failed AND e1 <> 0 AND e2 <> 0 AND c1 = cmd AND c2 = cmd GROUP BY cmd""")
def repeat_failures_parsed(spark, sf_dir):
    """Three failures in a row as a parsed ledger has them: glued records, broken ends, gaps."""
    return L.repeat_failures(parse_ledger(_glued(V.ledger(spark, sf_dir)).withColumn("seq", F.col("seq") * 1000))).withColumn("seq", F.expr("seq div 1000"))


RUNS_SQL = """
  runs AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%d-%H%M%S') || '-' || lpad(o_orderkey::VARCHAR, 12, '0') AS id, o_custkey AS cust, o_orderstatus AS cwd, (o_orderkey % 3)::INT AS exit,
                  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'diagnostics' ELSE 'tests' END AS kind, strftime(o_orderdate, '%Y-%m-%d') AS ts FROM orders),
  items AS (SELECT l_orderkey AS k, l_linenumber AS n, 't' || (l_partkey % 6) AS t FROM lineitem)"""


def archived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as archived runs of a command per customer, line items as what their reports list."""
    k = F.col("o_orderkey")
    run_id = F.concat(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit("-"), F.lpad(k.cast("string"), 12, "0"))
    orders = V.table(spark, sf_dir, "orders")
    metas = orders.select(run_id.alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.array(F.lit("make"), F.concat(F.lit("all "), F.col("o_custkey").cast("string"))).alias("argv"), F.lit("safe").alias("mode"), (k % 3).cast("int").alias("exit"), F.col("o_orderstatus").alias("cwd"), F.lit(10).cast("long").alias("stdout_bytes"), k.alias("stderr_bytes"), F.lit(None).cast("timestamp").alias("mtime"))
    name = F.concat(F.lit("t"), (F.col("l_partkey") % 6).cast("string"))
    tests = (F.col("l_orderkey") % 11) != 0
    item = F.struct(F.when(tests, name).otherwise("").alias("id"), F.lit("").alias("loc"), F.when(tests, "").otherwise(name).alias("rule"), F.concat(F.lit("m "), name).alias("msg"))
    listed = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("i")))), lambda x: x["i"]).alias("items"))
    reports = orders.where(k % 5 != 0).join(listed, k == F.col("k")).select(run_id.alias("run_id"), F.when(k % 11 == 0, "diagnostics").otherwise("tests").alias("kind"), F.lit("x").alias("runner"), F.size("items").cast("long").alias("failed"), F.when(k % 11 != 0, (k % 7).cast("long")).alias("total"), "items", F.concat(F.lit("report "), k.cast("string"), F.lit("\n")).alias("rendered"))
    return metas, reports


@query(f"""WITH {RUNS_SQL},
r AS (SELECT *, lag(k) OVER w AS pk, lag(kind) OVER w AS pkind FROM runs WHERE kind IS NOT NULL AND k IN (SELECT k FROM items) WINDOW w AS (PARTITION BY cust, cwd ORDER BY ts, k)),
p AS (SELECT * FROM r WHERE pk IS NOT NULL),
c AS (SELECT k, t, count(*) AS n FROM items GROUP BY ALL),
b AS (SELECT p.k, coalesce(x.n, 0) AS now, 0 AS old, x.t FROM p JOIN c x ON x.k = p.k UNION ALL SELECT p.k, 0, y.n, y.t FROM p JOIN c y ON y.k = p.pk),
d AS (SELECT k, t, sum(now) AS now, sum(old) AS old FROM b GROUP BY k, t),
s AS (SELECT k, sum(least(now, old))::BIGINT AS still, sum(now - least(now, old))::BIGINT AS new, sum(old - least(now, old))::BIGINT AS fixed FROM d GROUP BY k)
SELECT id AS run_id, CASE WHEN kind = pkind THEN CASE WHEN kind = 'tests' AND k % 7 < pk % 7 THEN 'fixed or not run ' ELSE 'fixed ' END || fixed || '; still ' || still || '; new ' || new END AS summary FROM p JOIN s USING (k)""")
def vs_previous(spark, sf_dir):
    """Every run against the one before it; runs of other kinds are not compared."""
    return H.vs_previous(H.comparable_pairs(*archived(spark, sf_dir)))


@query(f"""WITH {RUNS_SQL},
l AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY cwd ORDER BY ts DESC, id DESC) = 1)
SELECT cwd, CASE WHEN kind IS NOT NULL THEN 'report ' || k || chr(10) || 'run: ' || id || chr(10) || 'command: make ''all ' || cust || '''' || CASE WHEN exit <> 0 THEN chr(10) || 'exit_code: ' || exit ELSE '' END || chr(10) || 'raw_log: /runs/' || id
  ELSE 'run: ' || id || chr(10) || 'command: make ''all ' || cust || '''' || chr(10) || 'ts: ' || ts || chr(10) || 'mode: safe' || chr(10) || 'exit_code: ' || exit || chr(10) || 'stdout_bytes: 10' || chr(10) || 'stderr_bytes: ' || k || chr(10) || 'raw_log: /runs/' || id
       || chr(10) || 'note: no adapter report for this run; its raw log is kept as run ' || id END AS text FROM l""")
def last_report(spark, sf_dir):
    """The newest run of each folder as it was printed."""
    return H.render_last(*archived(spark, sf_dir), "/runs", "make", ["cwd"])


@query(f"""WITH {RUNS_SQL},
l AS (SELECT * FROM runs ORDER BY ts DESC, id DESC LIMIT 20)
SELECT 'runs[' || count(*) || ']{{id,ts,cmd,mode,exit}}:' || string_agg(chr(10) || '  ' || id || ',' || ts || ',make ''all ' || cust || ''',safe,' || exit, '' ORDER BY ts DESC, id DESC) AS text FROM l""")
def run_list(spark, sf_dir):
    """The newest runs as a table (a top-k report)."""
    return H.render_list(archived(spark, sf_dir)[0])


COMMANDS = ("pytest -q 2>&1 | tail -%d", "uv run --with x pytest -k %d", "cargo test t%d && rm x", "echo 'a|b' %d", "ls $HOME/%d", "go test ./p%d")


@query("""
SELECT user_id, event_id,
       CASE user_id % 6 WHEN 0 THEN 'pytest' WHEN 1 THEN 'pytest' WHEN 2 THEN 'cargo-test' WHEN 5 THEN 'go-test' END AS tool,
       user_id % 6 IN (0, 2, 4) AS shell, CASE user_id % 6 WHEN 0 THEN 'tail -' || event_id END AS filter,
       CASE user_id % 6 WHEN 0 THEN true WHEN 2 THEN true WHEN 3 THEN event_id % 100 = 7 WHEN 4 THEN true ELSE false END AS guarded
FROM events""")
def command_analysis(spark, sf_dir):
    """Tool, need of a shell, droppable display filter, and guards of commands."""
    pattern = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("user_id") % 6 + 1).cast("int"))
    rows = V.table(spark, sf_dir, "events").select("user_id", "event_id", F.replace(pattern, F.lit("%d"), F.col("event_id").cast("string")).alias("c"))
    guarded = C.is_guarded("c", ["Bash(rm *)", "Bash(echo 'a|b' *07)"])
    return rows.select("user_id", "event_id", C.adapter_of("c").alias("tool"), C.needs_shell("c").alias("shell"), C.drop_display_filter("c")["filter"].alias("filter"), guarded.alias("guarded"))


JUDGED = (("cd app && pytest -k %d", "wrap"), ("CI=1 cargo test t%d && go vet ./p", "wrap"), ("./ci.sh %d", "suggest"), ("ruff check --fix f%d", None), ("pytest ../x%d", None), ("npx vitest run t%d | tail -5", "wrap"), ("make t%d > x", None))


@query(f"""
SELECT event_id, CASE WHEN user_id % 7 = 5 THEN 'vitest' ELSE NULL END AS tool, CASE user_id % 7 {" ".join(f"WHEN {i} THEN '{v}'" for i, (_, v) in enumerate(JUDGED) if v)} END AS verdict,
       CASE WHEN user_id % 7 = 0 THEN 'app' END AS folder FROM events""")
def command_verdicts(spark, sf_dir):
    """Commands taken apart and judged by tables."""
    pattern = F.element_at(F.array(*(F.lit(c) for c, _ in JUDGED)), (F.col("user_id") % len(JUDGED) + 1).cast("int"))
    rows = V.table(spark, sf_dir, "events").select("event_id", F.replace(pattern, F.lit("%d"), F.col("event_id").cast("string")).alias("c"))
    package = F.to_json(F.struct(F.struct(F.lit("vitest run").alias("test")).alias("scripts")))
    tool = F.when(F.col("c").startswith("npx"), J.package_test(F.lit("npm test"), package))
    return rows.select("event_id", tool.alias("tool"), J.judge("c", ["ci.sh"], ["Bash(rm *)"]).alias("verdict"), J.shape("c")["folder"].alias("folder"))


@query("""
SELECT o_orderkey, 'src/f' || (o_custkey % 9) || '.c' AS file, o_orderkey || '.log' AS base, strptime(strftime(o_orderdate, '%Y%m%d-%H%M%S'), '%Y%m%d-%H%M%S') AS run_time,
       (o_orderkey % 24) * 3600 + (o_custkey % 60) * 60 + 1.5::DOUBLE AS seconds, 'cargo' AS inner_cmd, o_orderpriority LIKE '1-%' AS urgent
FROM orders""")
def scalar_functions(spark, sf_dir):
    n = lambda c, k: F.lpad((F.col(c) % k).cast("string"), 2, "0")
    text = lambda c: F.col(c).cast("string")
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        T.file_of(F.concat(F.lit("src/f"), (F.col("o_custkey") % 9).cast("string"), F.lit(".c:"), text("o_orderkey"), F.lit(":7"))).alias("file"),
        T.basename(F.concat(F.lit("a/b\\"), text("o_orderkey"), F.lit(".log"))).alias("base"),
        T.run_time(F.concat(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit("-ab12"))).alias("run_time"),
        T.clock_seconds(F.concat(n("o_orderkey", 24), F.lit(":"), n("o_custkey", 60), F.lit(":01.5"))).alias("seconds"),
        T.inner_command(F.array(F.lit("/bin/bash"), F.lit("-c"), F.concat(F.lit("A=1 B="), text("o_orderkey"), F.lit(" cargo test | tail")))).alias("inner_cmd"),
        T.wildcard("o_orderpriority", F.lit("1-*")).alias("urgent"),
    )
