"""Exact dedup against a persistent digest index.

The index is a table bucketed by digest and sorted within each bucket. New
texts are reduced to one row per digest (map-side combine first, so a text
that a third of the rows share costs one row per task), anti-joined with the
index by sort-merge without moving the index, and appended. The text column
is read once and never shuffled: only (id, digest, length) rows move.

Defined results: a null text is the empty text; empty texts are equal to each
other and to texts of white space only; null ids sort last when ids break a
tie; repeated rows with the same id and text are one document and share one
decision (``group_size`` counts every row); an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh_name, join_skewed, materialise, new_path, shuffle_partitions, text_or_empty


def normalised(text: str | Column) -> Column:
    """The text without any white space, as compared by this operator."""
    return F.regexp_replace(text_or_empty(text), SPACE + "+", "")


class DigestIndex:
    """Digests seen so far: (digest, keep_id, keep_chars), one row per text."""

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int = 64):
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        writer = fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        if self.path:
            writer = writer.option("path", self.path)
        # one file for each bucket and batch
        writer.saveAsTable(self.table)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Decide on ``docs``, append unseen texts, return one row per row.

        Columns: the id, keep_id, group_size (rows of this batch with that
        text), kept, text_sha256. A text that the index already holds keeps
        the row that it held; else the row with the most code points, then
        the smallest id, stays.
        """
        text = text_or_empty(text_col)
        hashed = materialise(
            docs.select(
                F.col(id_col).alias("id"),
                F.char_length(text).cast("long").alias("chars"),
                F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("digest"),
            ),
            "exact-hashed",
        )
        best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("u"), F.col("id").alias("i")))
        groups = hashed.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.select("digest", F.col("b.i").alias("keep_id"), (-F.col("b.c")).alias("keep_chars"), "group_size")
        if self.exists():
            seen = self.rows()
            groups = materialise(groups, "exact-groups")
            fresh = materialise(groups.join(seen.hint("merge"), "digest", "left_anti").drop("group_size"), "exact-fresh")
        else:
            groups = fresh = materialise(groups, "exact-groups")
            fresh = fresh.drop("group_size")
        self.append(fresh.repartition(self.buckets, "digest"))
        decided = groups.select("digest", "group_size").join(self.rows().hint("merge"), "digest")
        decided = materialise(decided, "exact-decided")
        total = groups.agg(F.sum("group_size")).first()[0] or 0
        out = join_skewed(hashed, decided, ["digest"], "group_size", total)
        return out.select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """Exact dedup of ``docs`` against ``index``, by default a new one."""
    if index is not None:
        return index.ingest(docs, id_col, text_col)
    spark, name = docs.sparkSession, f"digest_index_{uuid.uuid4().hex}"
    out = DigestIndex(spark, name, new_path(spark, "digest-index"), shuffle_partitions(spark)).ingest(docs, id_col, text_col)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files have a path of their own
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are.

    Of rows with one id and text the one whose columns, as JSON, come first stays.
    """
    decided = exact_dedup(docs, id_col, text_col, index)
    own_id, own_digest = fresh_name(docs, "id"), fresh_name(docs, "digest")
    kept = materialise(decided.where("kept").select(F.col(id_col).alias(own_id), F.col("text_sha256").alias(own_digest)), "exact-kept")
    digest = F.sha2(normalised(text_col).cast("binary"), 256)
    rows = docs.join(kept.distinct(), F.col(id_col).eqNullSafe(F.col(own_id)) & (digest == F.col(own_digest)), "left_semi")
    if not kept.groupBy(own_id, own_digest).count().where("count > 1").limit(1).count():
        return rows
    # equal when normalised is not yet equal: the longest of one id's texts stays
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct((-F.char_length(text_or_empty(text_col))).alias("c"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("j"))
    best = rows.groupBy(F.col(id_col), digest).agg(F.min_by(whole, order).alias("row"))
    return best.select("row.*")
