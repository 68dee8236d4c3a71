"""Continuous upkeep with Structured Streaming: late and repeated rows, running counts, and putting changes in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.operators import changes
from codelode.sources.store import Store


def first_rows(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The stream without rows whose keys came within the delay before; the state is dropped as time goes on."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def keep_in(store: Store, name: str, stream: DataFrame, keys: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Puts each batch of a stream into a table: the last row of a key wins. A batch that is repeated changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        store.upsert(name, changes.last_wins(batch, keys, order))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
