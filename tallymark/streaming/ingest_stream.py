"""Streaming ingest of the bank file: an extension, the reference's batches being finite.

New files are read as they come; each micro-batch is fingerprinted, deduplicated against what the store holds and appended, so a
batch that is replayed after a failure adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymark.sources import ingest
from tallymark.sources.store import Store


def stream_bank(spark: SparkSession, folder: str, store: Store, run_id: str, checkpoint: str) -> StreamingQuery:
    """CSV files with a header that appear in folder, to the store's tables bank and quarantine."""
    columns = list(ingest.SHAPES["bank"])
    schema = ", ".join(f"{c} string" for c in columns)
    source = spark.readStream.schema(schema).option("header", True).option("emptyValue", "").csv(folder)

    def load(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.lit(run_id).alias("run_id"), F.lit(folder).alias("file"), (F.lit(number << 40) + F.monotonically_increasing_id()).alias("file_seq"), F.concat_ws(",", *columns).alias("raw"), *columns)
        held = store.read("bank", run_id)
        found = ingest.ingest(rows, "bank", columns, None if held is None else held.select("run_id", "row_sha256"))
        store.append("bank", found["loaded"])
        store.append("quarantine", found["quarantine"])

    return source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
