"""Intermediate tables of operators, in the folder that driver and executors share.

Tables belong to the run that is current in this thread, so that what one run
drops is nothing that another one, beside it or around it, has staged.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..staging import Staging, lasting, shared_dir

__all__ = ["own_tables", "shared_dir", "staged"]

_current: ContextVar[Staging | None] = ContextVar("tables", default=None)


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[Staging]:
    """What is staged inside belongs to the run given back; close(keep) drops all but the last tables, the end of the process the rest."""
    run = lasting(spark)
    token = _current.set(run)
    try:
        yield run
    finally:
        _current.reset(token)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back: cuts the lineage and survives lost executors."""
    run = _current.get()
    if run is None or run.spark is not df.sparkSession:
        run = lasting(df.sparkSession)
    return run.table(df, name)
