"""Snapshots as micro-batches: each arriving batch is built and published as a whole, or nothing is."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.build import build
from ..plans.publish import publish
from ..plans.spec import SnapshotSpec
from ..staging import Staging


def follow(rows: DataFrame, spec: SnapshotSpec, root: str, checkpoint: str, build_date: Callable[[int], dt.date]) -> StreamingQuery:
    """A stream of raw rows -> published versions.  A batch that changes nothing publishes nothing, so replays are harmless."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        run = Staging(batch.sparkSession)
        try:
            publish(batch.sparkSession, root, build(batch, spec, build_date(number), run), partitions={"records": "shard"})
        finally:
            run.close()

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
