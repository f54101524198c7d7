"""Notes that arrive as a stream are remembered batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notewell.operators.memory import remembered
from notewell.sources.store import Store


def remembering(notes: DataFrame, store: Store, now: Column | int, checkpoint: str) -> StreamingQuery:
    """Starts a query that folds notes(seq, id, repo, type, note, tags) into the store's snapshots.

    A snapshot has the number of the last batch in it, so a batch that is run
    again after a failure is passed over if the store has it.
    """
    at = int(now) if not isinstance(now, Column) else None

    def fold(batch: DataFrame, number: int) -> None:
        if store.batches().get(checkpoint, -1) >= number:
            return
        moment = at if at is not None else batch.sparkSession.range(1).select(F.unix_timestamp()).first()[0]
        store.write((checkpoint, number), memories=remembered(store.read("memories"), batch, moment, F.to_date(F.timestamp_seconds(F.lit(moment)))))

    return notes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
