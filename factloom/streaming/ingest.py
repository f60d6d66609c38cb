"""Structured Streaming: arriving documents and signals, with the batch operators applied to each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions import text as tx
from factloom.operators import graph


def documents(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (doc_name, text) of Markdown files as they arrive."""
    files = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.[^./]*$", 1).alias("doc_name"), F.col("value").alias("text"))


def chunked(docs: DataFrame, size: int = tx.CHUNK, overlap: int = tx.OVERLAP) -> DataFrame:
    """Chunks of each document; without state."""
    exploded = docs.select("doc_name", F.posexplode(tx.char_chunks(F.col("text"), size, overlap)).alias("chunk_no", "c"))
    return exploded.select("doc_name", "chunk_no", "c.start", "c.text")


def window_counts(signals: DataFrame, time_col: str, by: list[str], width: str, late: str | None = None) -> DataFrame:
    """Signals counted by window and the given columns; late: how far behind they may come, which bounds the state of a stream."""
    rows = signals.withWatermark(time_col, late) if late and signals.isStreaming else signals
    counted = rows.groupBy(F.window(time_col, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n")


def distinct_facts(facts: DataFrame, id_col: str, time_col: str, late: str) -> DataFrame:
    """Facts of an id only once, within the time they may be late."""
    return facts.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def write_nodes(facts: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """First writes of each batch under path/batch=<number>: a batch run again writes the same folder again."""

    def run(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        graph.first_write(batch, keys, order, rest).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return facts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_nodes(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The earliest batch's node of each key."""
    rows = spark.read.parquet(path)
    return graph.first_write(rows, keys, ["batch"], [c for c in rows.columns if c not in (*keys, "batch")])
