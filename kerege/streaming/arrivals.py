"""Files that arrive in a folder, checked as they come: stateless, each file once, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from kerege.operators import validation as V
from kerege.sources import files

_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """The folder's files as a stream of (path, suffix, kind, content), at most per_batch in a batch."""
    stream = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(path)
    return files.kinds(stream)


def checked_json(stream: DataFrame, as_of: str | None = None) -> DataFrame:
    """Rule results of a stream's JSON files: rows map to rows, so the plan is the batch one and needs no state."""
    texts = stream.where("kind = 'json'").select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("text"))
    return V.results(V.checked(files.json_documents(texts)[0], as_of))


def check_arrivals(stream: DataFrame, results_path: str, rejects_path: str, checkpoint: str, as_of: str | None = None) -> StreamingQuery:
    """Check all kinds of files batch by batch (sheets are joins of their cells) until those there are done; each batch replaces its own part if it is repeated."""

    def batch(rows: DataFrame, number: int) -> None:
        good, bad = files.documents(rows)
        V.results(V.checked(good, as_of)).write.mode("overwrite").parquet(f"{results_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
