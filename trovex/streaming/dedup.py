"""Dedup of a stream against the last accepted values of each group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Bytes at which a copied text is too long for the clipboard's history.
TOO_LONG = 100_000


def clipboard_texts(stream: DataFrame, text: str) -> DataFrame:
    """Rows whose text is neither null, empty nor too long for the history."""
    return stream.where(F.octet_length(text).between(1, TOO_LONG - 1))


def last_n_dedup(stream: DataFrame, group: str, order: list[str], value: str, n: int = 10, idle_seconds: int | None = None) -> DataFrame:
    """Rows whose value is not among the last n accepted ones of their group; the state of a group is these n values.

    Rows are taken in order within a micro-batch, and micro-batches in the order of their arrival.  With idle_seconds
    the state of a group that gets no row for so long is dropped, so that the state does not grow with all groups ever
    seen.  Spark then goes on with batches without data, so a query that takes what is available now only ends with
    spark.sql.streaming.noDataMicroBatches.enabled off.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")  # one micro-batch of one group
        keep = []
        for v in rows[value].tolist():
            keep.append(v not in window)
            if keep[-1]:
                window = [*window, v][-n:]
        state.update((window,))
        if idle_seconds:
            state.setTimeoutDuration(idle_seconds * 1000)
        yield rows[keep]

    kind = stream.schema[value].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout
    return stream.groupBy(group).applyInPandasWithState(run, stream.schema, f"window array<{kind}>", "append", timeout)
