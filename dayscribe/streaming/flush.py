"""A stream's rows into a table of versions, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources import versions


def flushed(stream: DataFrame, folder: str, checkpoint: str, writer: str = "flush") -> StreamingQuery:
    """Starts to append all that the stream has to the table in folder, a version a micro-batch, and ends when there is no more.

    The table's manifest holds the last batch of the writer in the same commit as its rows. A batch that is run again, since
    the stream ended between that commit and its own checkpoint, finds itself there and adds nothing."""
    add = lambda rows, batch: versions.append(rows, folder, writer, batch)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
