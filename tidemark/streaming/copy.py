"""Migration driven by arrivals: a file stream over hot, one run per trigger.

The stream only tells that files came in; which of them hold rows behind the mark of their table, and need to be
copied out of turn, the run knows from its own ledger of files.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.plans.migrate import migrate
from tidemark.plans.store import TierStore

log = logging.getLogger("tidemark.copy")


def arrivals(store: TierStore) -> DataFrame:
    """Rows of files added to hot."""
    store.prepare()
    return store.spark.readStream.schema(store.hot_schema).parquet(store.hot_path)


def copy_batch(store: TierStore, new_rows: DataFrame, now: datetime, migrate_after_days: int, **options: object) -> None:
    """One trigger: a regular run. Repeated after a failure it finishes what the first attempt left."""
    log.info("%d rows arrived", new_rows.count())  # from the files' footers
    migrate(store, now, migrate_after_days, **options)


def start_copy(
    store: TierStore, checkpoint: str, now: Callable[[], datetime], migrate_after_days: int, **options: object
) -> StreamingQuery:
    """Process everything that has arrived, then stop; run it again to go on."""

    def on_batch(new_rows: DataFrame, batch_id: int) -> None:
        copy_batch(store, new_rows, now(), migrate_after_days, **options)

    return (
        arrivals(store)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class ProgressLog(StreamingQueryListener):
    """Logs the rows read of what arrived, and their rate, for every trigger.

    Register it with ``spark.streams.addListener``. A trigger that has no need to look at
    the arrived rows, there being no marks yet, reports none; rows copied are logged by the run.
    """

    def __init__(self, log: logging.Logger | None = None) -> None:
        self.log = log or logging.getLogger("tidemark.copy")
        self.rows = 0

    def onQueryStarted(self, event) -> None:
        self.log.info("copy started: %s", event.id)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.rows += progress.numInputRows
        self.log.info(
            "copy batch %s: %s rows read, %.1f per second, %s in all",
            progress.batchId, progress.numInputRows, progress.processedRowsPerSecond or 0.0, self.rows,
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.log.info("copy ended: %s", event.exception or "all read")
