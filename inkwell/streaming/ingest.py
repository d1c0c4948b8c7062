"""Streaming ingest: documents that arrive in a folder are indexed a batch at a time; searches are counted as they come."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators.suggest import log_key
from ..sources.documents import FIELDS

def ingest(engine: Engine, spark: SparkSession, folder: str, checkpoint: str) -> StreamingQuery:
    """Index JSON-lines files that appear in ``folder``, with ids of their own or new ones.

    Each micro-batch is one bulk insert.  A document whose id is stored replaces that one; of several with one id in a batch the
    last counts.  A refused document changes nothing: what is stored under its id stays.  Documents without an id get the next free
    ones of the index, like any others, so streams don't disturb one another.  The number of the stream's last batch is committed
    with its documents, so a batch that is delivered again after a failure adds nothing.  What came of each document is the job of the stream's
    id, without its dashes, ``batch`` and the batch's number.
    """
    stream = spark.readStream.schema(f"doc_id bigint, {FIELDS}").json(folder)

    def apply(batch: DataFrame, number: int) -> None:
        name = stream_id(spark, checkpoint)
        engine.add(batch, replace=True, key=f"{name}batch{number}", stream=(name, number))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave a stream when its checkpoint was made: a new checkpoint in the same place is another stream."""
    (row,) = spark.read.text(f"{checkpoint}/metadata").collect()
    return json.loads(row.value)["id"].replace("-", "")


def search_counts(searches: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Searches (query, total, at) of a stream by window and query; those later than ``late`` behind the newest are left out."""
    rows = searches.withWatermark("at", late).select(log_key(F.col("query")).alias("query"), "total", "at").where("query <> '' AND total > 0")
    return rows.groupBy(F.window("at", window).alias("w"), "query").agg(F.count("*").alias("count"), F.max("total").alias("most"))
