"""Keeping an index up to date from a stream of changes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import ReadDocs
from ..plans.index import Index

# The interval between commits, a setting of the job.
UPDATE_INTERVAL = "30 seconds"


def drain_batches(index: Index, changes: DataFrame,
                  read_docs: Callable[[], DataFrame | ReadDocs],
                  checkpoint: str, name: str = "feed", interval: str = UPDATE_INTERVAL,
                  available_now: bool = False,
                  prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Commit the stream ``changes`` to ``index``, one micro-batch per interval.

    ``read_docs`` is called at each commit, so contents are those of that moment; it gives
    the corpus, or a function that reads the documents of given paths. ``prepare`` maps a
    micro-batch to changes (volume, path, op, batch). A micro-batch delivered again after a
    failure carries the same token and is committed once. The token is made of the stream's
    own id, which its checkpoint keeps: another stream, or one with a new checkpoint, has
    other tokens, whatever its name.
    """
    stream_id: list[str] = []

    def commit(batch: DataFrame, epoch: int) -> None:
        if not stream_id:
            metadata = index.spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()
            stream_id.append(json.loads(metadata["value"])["id"])
        rows = prepare(batch) if prepare is not None else batch
        index.commit(rows, read_docs(), token=f"{stream_id[0]}:{epoch}")

    writer = (changes.writeStream.queryName(name).foreachBatch(commit)
              .option("checkpointLocation", checkpoint))
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
