"""The control socket as a stream: commands in, replies out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.text import trimmed
from quillon.operators.ipc import decoded, reply

REPLIES = "conn_id long, command string, reply string"


def replies(reads: DataFrame) -> DataFrame:
    """A stream of ``reads`` (conn_id, data: binary) -> replies; empty reads get none. What a status line counts
    is the read's number, ``conn_id``."""
    out = reads.withColumn("raw", decoded(F.col("data"))).where(F.octet_length("data") > 0).withColumn("command", trimmed(F.col("raw")))
    return out.select("conn_id", "command", reply(F.col("command"), F.col("conn_id")).alias("reply"))


def serve(reads: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes replies to Parquet files in ``sink`` for what is there now, and ends."""
    return replies(reads).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
