"""Queries of nested texts, predicates and rendered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.toon import encode_json
from ..operators import diagnostics as D
from ..operators import lines, render
from ..operators import reports as R
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


#: A JSON document and its text, by the number of an event modulo their count; N stands for the number.
SHAPES = [
    ('{"a": N, "b": {"c": null, "d": [], "e": {}}}', "a: N\nb:\n  c: null\n  d: []\n  e:"),
    ('[1, true, "x", "true", "", "a,b", N]', '[7]: 1,true,x,"true","","a,b",N'),
    ('{"rows": [{"i": N, "w": "p q"}, {"w": "-r", "i": 2}]}', 'rows[2]{i,w}:\n  N,p q\n  2,"-r"'),
    ('{"rows": [{"k": {"u": 1, "v": N}}, {"k": {"u": 3, "v": 4}}]}', "rows[2]{k{u,v}}:\n  1,N\n  3,4"),
    ('{"x": {"n": N}, "y": {"n": 5}}', "[2:]{n}:\n  x: N\n  y: 5"),
    ('{"l": [{"a": N, "b": [1, 2]}, 7, [N, [8]]]}', "l[3]:\n  - a: N\n    b[2]: 1,2\n  - 7\n  - [2]:\n    - N\n    - [1]: 8"),
    ('{"two words": "a: N", "t": "x\\\\ty", "n": 1.50e2, "m": -0, "big": 1e400, "small": 0.0000001}', '"two words": "a: N"\nt: "x\\ty"\nn: 150\nm: 0\nbig: 1e+400\nsmall: 1e-7'),
    ('"N é"', "N é"),
    ('{"a": [{"x": N}, {"y": 2}], "c": [[], {}]}', "a[2]:\n  - x: N\n  - y: 2\nc[2]:\n  - [0]:\n  -"),
]


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _shape_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN {_literal(t)}" for i, (_, t) in enumerate(SHAPES))
    return f"SELECT event_id, replace(CASE event_id % {len(SHAPES)} {cases} END, 'N', event_id::VARCHAR) AS toon FROM events"


@query(_shape_sql())
def toon_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of nested value, of key and of number."""
    doc = F.element_at(F.array(*(F.lit(j.replace("\\\\t", "\\t")) for j, _ in SHAPES)), (F.col("event_id") % len(SHAPES) + 1).cast("int"))
    return V.table(spark, sf_dir, "events").select("event_id", encode_json(F.replace(doc, F.lit("N"), F.col("event_id").cast("string"))).alias("toon"))


@query("""
SELECT doc_id, n_chars * 10 >= n * 8 * 10 // 10 AND n_chars * 5 <= n * 6 AND n_chars * 5 >= n * 4 AS close, strlen(text) // 4 AS approx,
       CASE WHEN strlen(text) BETWEEN 4096 AND 4194304 THEN n_words ELSE (strlen(text) + 3) // 4 END AS counted, n_words AS ceiling, 'x.py:' || doc_id || ' and y' AS rel, doc_id % 4 AS cut, doc_id % 3 = 0 AS budget_error,
       doc_id % 2 = 0 AS run_id, doc_id % 5 = 1 AS key_line, doc_id % 5 IN (2, 3) AS noise
FROM (SELECT *, length(text) - 3 * (doc_id % 7) AS n, len(string_split(text, ' ')) AS n_words FROM documents WHERE text IS NOT NULL)""")
def text_predicates(spark, sf_dir):
    """Predicates and scalars on texts derived from the documents."""
    docs = V.table(spark, sf_dir, "documents").where("text is not null")
    d = F.col("doc_id")
    words = lambda c: F.size(F.split(c, " ")).cast("long")
    n = F.char_length("text") - 3 * (d % 7)
    args = F.element_at(F.array(F.lit("-n 0"), F.lit("-n1"), F.lit("-2"), F.lit("--lines=3")), (d % 4 + 1).cast("int"))
    error = F.when(d % 3 == 0, F.element_at(F.array(F.lit("E   x"), F.lit("  npm ERR! y"), F.lit("it Aborted")), (d % 9 / 3 + 1).cast("int"))).otherwise("E  fine")
    trace = F.element_at(F.array(F.lit("x = 1"), F.lit("E   boom"), F.lit('File "/x/site-packages/a.py", line 1'), F.lit("at node:internal/z"), F.lit("at own.js:3")), (d % 5 + 1).cast("int"))
    return docs.select(
        "doc_id", T.is_close(F.col("n_chars").cast("long"), n.cast("long")).alias("close"), T.approx_tokens("text").alias("approx"), T.counted_tokens("text", words).alias("counted"), T.counted_tokens("text", words, ceiling=True).alias("ceiling"),
        T.relativize(F.concat(F.lit("/w/x.py:"), d.cast("string"), F.lit(" and file:///w/y")), "/w").alias("rel"), lines.parse_line_cut(args).alias("cut"), T.is_budget_error(error).alias("budget_error"),
        T.looks_like_run_id(F.when(d % 2 == 0, "20240102-030405-0aff").otherwise("20240102-030405-0AFF")).alias("run_id"), trace.rlike(R.KEY_LINE).alias("key_line"), trace.rlike(R.NOISE).alias("noise"),
    )


@query(f"""WITH {V.LEDGER_SQL},
a AS (SELECT adapter, count(*) AS calls, sum(saved)::BIGINT AS saved, min(seq) AS first FROM ledger GROUP BY adapter),
t AS (SELECT count(*) AS calls, sum(saved)::BIGINT AS saved, sum(greatest(least(tokens_in, 7500) - tokens_out, 0))::BIGINT AS seen FROM ledger)
SELECT 'calls: ' || any_value(t.calls) || chr(10) || 'tokens_saved: ' || any_value(t.saved) || chr(10) || 'saved_vs_visible: ' || any_value(t.seen) || chr(10) || 'by_adapter[' || count(*) || ':]{{calls,saved}}:' || string_agg(chr(10) || '  ' || adapter || ': ' || a.calls || ',' || a.saved, '' ORDER BY first) AS text FROM a, t""")
def ledger_report(spark, sf_dir):
    """The ledger's report as text."""
    return render.render_stats(V.ledger(spark, sf_dir))


@query(f"""WITH {V.LEDGER_SQL},
u AS (SELECT cmd || '-' || (seq % 40) AS cmd, * EXCLUDE (cmd) FROM ledger WHERE adapter = 'passthrough' OR adapter = 'safe' AND greatest(tokens_in - tokens_out, 0) * 100 < tokens_in * 10),
g AS (SELECT cmd, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens, sum(tokens_out)::BIGINT AS left_, count(*) FILTER (adapter = 'passthrough') AS passes, min(seq) AS first FROM u GROUP BY cmd HAVING count(*) >= 3 AND sum(tokens_in)::BIGINT // count(*) >= 500)
SELECT 'token_waster' AS kind, cmd, calls, tokens // calls AS avg_tokens_in, 'pin [command.' || cmd || '] level="aggressive" (' || CASE WHEN passes = calls THEN 'output passed through uncompressed today' ELSE 'the safe tier saved only ' || (greatest(tokens - left_, 0) * 100 // greatest(tokens, 1)) || '% today' END || ')' AS action FROM g""")
def ledger_suggestions(spark, sf_dir):
    """What the ledger says to change: the wasters' part."""
    rows = V.ledger(spark, sf_dir)
    rows = rows.withColumn("cmd", F.concat("cmd", F.lit("-"), (F.col("seq") % 40).cast("string")))
    return render.suggestions(rows).where("kind = 'token_waster'").drop("rank")


@query("""
WITH t AS (SELECT p_brand AS run_id, p_partkey AS pos, 't' || (p_partkey % 9) AS name, p_size AS line, p_size % 5 = 0 AS bad FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY run_id, name) AS same FROM t WHERE bad),
k AS (SELECT *, CASE WHEN same > 1 THEN 'a.py::' || name || '@a.py:' || (line + 1) ELSE 'a.py::' || name END AS key0 FROM f),
k2 AS (SELECT *, key0 || CASE WHEN row_number() OVER w > 1 THEN '#' || row_number() OVER w ELSE '' END AS key FROM k WINDOW w AS (PARTITION BY run_id, key0 ORDER BY n)),
c AS (SELECT run_id, count(*) AS total, count(*) FILTER (NOT bad) AS passed, count(*) FILTER (bad) AS failed FROM t GROUP BY run_id)
SELECT run_id, 'runner: pytest' || chr(10) || 'summary:' || chr(10) || ' total: ' || any_value(total) || chr(10) || ' passed: ' || any_value(passed) || chr(10) || ' failed: ' || any_value(failed) || chr(10) || ' skipped: 0' || chr(10) || ' duration_s: 0.5'
       || chr(10) || 'failures[' || count(*) || ']{id,loc,msg}:' || string_agg(chr(10) || ' "a.py::' || name || '","a.py:' || (line + 1) || '",bad ' || pos, '' ORDER BY n)
       || chr(10) || 'traces:' || string_agg(chr(10) || ' "' || key || '"[2]:' || chr(10) || '  - x = ' || pos || chr(10) || '  - E   boom', '' ORDER BY n) AS text
FROM k2 JOIN c USING (run_id) GROUP BY run_id HAVING count(*) > 1""")
def report_text(spark, sf_dir):
    """Reports as they are printed, with a trace for each failure under a key of its own."""
    p = V.table(spark, sf_dir, "part")
    name, bad = F.concat(F.lit("t"), (F.col("p_partkey") % 9).cast("string")), F.col("p_size") % 5 == 0
    pos = F.col("p_partkey").cast("string")
    body = F.when(bad, F.concat(F.lit('<failure message="bad '), pos, F.lit('">x = '), pos, F.lit("\nFile \"/x/site-packages/y.py\", line 3\n  lib()\nE   boom</failure>"))).otherwise("")
    case = F.concat(F.lit('<testcase classname="C" file="a.py" name="'), name, F.lit('" line="'), F.col("p_size").cast("string"), F.lit('">'), body, F.lit("</testcase>"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("pos"), case.alias("v")))), lambda x: x["v"]), "")
    runs = p.groupBy(F.col("p_brand").alias("run_id")).agg(F.concat(F.lit('<testsuite time="0.5">'), parts, F.lit("</testsuite>")).alias("text"), F.count_if(bad).alias("n")).where("n > 1")
    return render.render_reports(R.junit(runs.select("run_id", "text")))


@query(f"""WITH {V.DIAGNOSTICS_SQL}
SELECT doc_id AS run_id, 'runner: x' || chr(10) || 'summary:' || chr(10) || ' errors: ' || count(*) FILTER (severity = 'error') || chr(10) || ' warnings: ' || count(*) FILTER (severity = 'warning') || chr(10) || 'diagnostics[' || count(*) || ']{{loc,severity,rule,msg}}:'
       || string_agg(chr(10) || ' "' || file || ':' || "row" || ':' || "column" || '",' || severity || ',' || rule || ',' || msg, '' ORDER BY pos, "row", "column") AS text FROM diag GROUP BY doc_id HAVING count(*) = count(DISTINCT pos)""")
def diagnostics_text(spark, sf_dir):
    """Diagnostics as they are printed, with their counts."""
    d = V.diagnostics(spark, sf_dir)
    single = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("a"), F.count_distinct("pos").alias("b")).where("a = b").select("doc_id")
    d = d.join(single, "doc_id")
    found = d.select(F.col("doc_id").alias("run_id"), "pos", D.place(F.col("file"), F.col("row"), F.col("column")).alias("loc"), "severity", "rule", "msg")
    return render.render_diagnostics(found, D.summarise(found, found.select("run_id").distinct(), "x"))
