"""What the operators share: tables in the shared folder, sizes, text blocks."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session of one process (a test) has none, a temporary folder is
    made and set; on a cluster other executors could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="runlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and lets several
    jobs use the rows without computing them again.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


_written: dict[int, tuple] = {}


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing will read again.

    For loops: the next round's table is written, so the last one's, and the
    shuffles behind it, are of no more use. Spark deletes shuffle files when
    the driver collects its garbage.
    """
    ref, path = _written.pop(id(df), (lambda: None, None))
    if ref() is not df:
        return
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    jvm.System.gc()


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def pieces_of(total: int, each: int, least: int = 1) -> int:
    """Number of partitions so that each gets about ``each`` bytes."""
    return max(least, -(-total // each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` (short) rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def expand(rows: DataFrame, step: int = 4096) -> DataFrame:
    """Each row as often as its ``copies`` say, without that column."""
    block = F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {step}"))
    rows = rows.withColumn("_block", F.explode(block))  # no list gets longer than ``step``, but for more than step ** 2 copies
    one = F.sequence(F.lit(1).cast("long"), F.least(F.lit(step), F.col("copies") - F.col("_block") * step))
    return rows.withColumn("_one", F.explode(one)).drop("copies", "_block", "_one")


#: A key is hot if it has more than one in so many of the rows.
HOT = 1024


def join_skewed(rows: DataFrame, table: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join with ``table``, one row per key, ``size`` the key's rows.

    Fewer than ``HOT`` keys can each have more than total / HOT of the rows, so
    the entries of hot keys are broadcast, whatever the data, and only rows of
    other keys are shuffled. Keys are compared with null equal to nothing.
    """
    hot = F.col(size) * HOT > total
    few = table.where(hot & (F.col(size) > 1)).collect()  # fewer than HOT
    if not few:
        return rows.join(table, on)
    few = F.broadcast(table.sparkSession.createDataFrame(few, table.schema))
    cold = rows.join(few.select(*on), on, "left_anti").join(table.join(few.select(*on), on, "left_anti"), on)
    return rows.join(few, on).unionByName(cold)
