"""Streams of ledger rows: hourly totals, and failures in a row, with state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import REPEATED, hourly
from ..sources.logs import LEDGER

FAILED = "cmd string, seq long"


def read_ledger(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON ledger files as a stream; ``seq`` must be among the fields."""
    return spark.readStream.schema("seq long, " + LEDGER).option("maxFilesPerTrigger", files_per_batch).json(path)


def _in_a_row(key, batches, state: GroupState):
    streak, told = state.get if state.exists else (0, False)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, code in zip(rows["seq"], rows["exit"]):
        streak = streak + 1 if code else 0
        if streak == REPEATED and not told:
            told = True
            out.append((key[0], int(seq)))
    state.update((streak, told))
    yield pd.DataFrame(out, columns=["cmd", "seq"])


def failing_commands(stream: DataFrame) -> DataFrame:
    """Commands whose own last three runs failed, once each.

    Kept per command, so runs of other commands in between do not count; the
    batch report over the whole ledger is ``operators.ledger.repeat_failures``.
    """
    return stream.groupBy("cmd").applyInPandasWithState(_in_a_row, FAILED, "streak int, told boolean", "append", GroupStateTimeout.NoTimeout)


__all__ = ["failing_commands", "hourly", "read_ledger"]
