"""Inputs derived from the test tables by the same rule in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lines import to_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


DOC_LINES_SQL = """
  doc_lines AS (
    SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS pos, unnest(string_split(text, chr(10))) AS line
    FROM documents WHERE text <> ''
  )"""


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per user: time, level, user, and the number in props."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").when(kind == "view", "DEBUG").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" user="), F.col("user_id").cast("string"), F.lit(" k="), F.coalesce(F.get_json_object("props", "$.k"), F.lit("-")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), line.alias("line"), F.lit("\n").alias("term"))


EVENT_LINES_SQL = """
  event_lines AS (
    SELECT user_id AS doc_id, event_id AS pos,
           CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS lv,
           coalesce(json_extract_string(props, '$.k'), '-') AS k,
           strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || lv || ' user=' || user_id || ' k=' || k AS line
    FROM events
  )"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a ledger of runs, in order of event_id."""
    tokens = F.round(F.col("value") * 100).cast("long")
    adapters = F.when(F.col("user_id") % 3 == 0, "passthrough").when(F.col("user_id") % 3 == 1, "safe").otherwise("pytest")
    out = F.when(F.col("user_id") % 3 == 0, tokens).otherwise(F.expr("cast(round(value * 100) as bigint) * (user_id % 7) div 6"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("cmd"), adapters.alias("adapter"), tokens.alias("tokens_in"), out.cast("long").alias("tokens_out"),
        F.when(F.col("event_type") == "error", 1).otherwise(F.col("event_id") % 2).cast("int").alias("exit"),
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("tool"), (F.col("user_id") % 4).cast("string"))).alias("inner_cmd"),
    )
    return rows.withColumn("saved", F.col("tokens_in") - F.col("tokens_out"))


LEDGER_SQL = """
  ledger AS (
    SELECT *, tokens_in - tokens_out AS saved FROM (
      SELECT event_id AS seq, ts, event_type AS cmd,
             CASE user_id % 3 WHEN 0 THEN 'passthrough' WHEN 1 THEN 'safe' ELSE 'pytest' END AS adapter,
             round(value * 100)::BIGINT AS tokens_in,
             CASE WHEN user_id % 3 = 0 THEN round(value * 100)::BIGINT ELSE round(value * 100)::BIGINT * (user_id % 7) // 6 END AS tokens_out,
             CASE WHEN event_type = 'error' THEN 1 ELSE event_id % 2 END AS exit,
             CASE WHEN user_id % 5 = 0 THEN 'tool' || (user_id % 4) END AS inner_cmd
      FROM events)
  )"""


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as diagnostics: file, line, column, severity, rule, msg; per order."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("pos"),
        F.concat(F.lit("src/f"), (F.col("l_partkey") % 50).cast("string"), F.lit(".c")).alias("file"),
        (F.col("l_suppkey") + 1).alias("row"), (F.col("l_linenumber") + 0).cast("long").alias("column"),
        F.when(flag == "R", "error").otherwise("warning").alias("severity"),
        F.concat(F.lit("E"), (F.col("l_partkey") % 9 + 100).cast("string")).alias("rule"),
        F.concat(F.lit("part "), (F.col("l_partkey") % 20).cast("string"), F.lit(" of flag "), flag).alias("msg"),
    )


DIAGNOSTICS_SQL = """
  diag AS (
    SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS pos, 'src/f' || (l_partkey % 50) || '.c' AS file, l_suppkey + 1 AS "row", l_linenumber::BIGINT AS "column",
           CASE l_returnflag WHEN 'R' THEN 'error' ELSE 'warning' END AS severity, 'E' || (l_partkey % 9 + 100) AS rule,
           'part ' || (l_partkey % 20) || ' of flag ' || l_returnflag AS msg
    FROM lineitem
  )"""
