"""Linking of documents as they come: a stateless stream into the same cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.concepts import Indexes, cascade
from ..session import scratch


def link_stream(mentions: DataFrame, atoms: DataFrame | Indexes, path: str, checkpoint: str) -> StreamingQuery:
    """Links each micro-batch of mentions (sab, code, text ...) and appends it to a Parquet table; runs until what is there is done.

    The indexes over the atoms are written once, before the first batch, and serve all of them. A batch
    writes to a folder of its own number, so a batch that is repeated after a failure takes its own place again; its
    intermediate tables go when it is written.
    """
    index = (atoms if isinstance(atoms, Indexes) else Indexes(atoms)).ready()

    def batch(rows: DataFrame, number: int) -> None:
        with scratch(rows.sparkSession):
            cascade(rows, index).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return mentions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
