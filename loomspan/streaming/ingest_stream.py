"""Resumable ingestion: every micro-batch is one transaction of a versioned store.

The transaction's id is the stream's name and the batch's number.  A run that stops between the write and Spark's own
commit repeats the batch, which is then a replay; one that stops before the store's commit leaves staged files
that no reader sees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sinks.versions import COMMITTED, REPLAYED, Store


def exactly_once(store: Store, name: str, tables: Callable[[DataFrame], dict[str, DataFrame]], before: Callable[[int], None] = lambda n: None, after: Callable[[int], None] = lambda n: None):
    """A foreachBatch function; `before` and `after` are called around the store's commit."""
    def put(batch: DataFrame, number: int) -> None:
        parts = [store.stage(df, table) for table, df in tables(batch).items()]
        before(number)
        told = store.commit(f"{name}:{number}", parts)
        if told.outcome not in (COMMITTED, REPLAYED):
            raise ValueError(f"batch {number}: {told.outcome}")
        after(number)

    return put
