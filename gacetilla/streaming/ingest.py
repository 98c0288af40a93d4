"""Cards as a stream: each micro-batch is checked against all stored addresses and appended once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gacetilla.operators.ingest import unseen


def append_unseen(stream: DataFrame, store: str, checkpoint: str, order: list[str], url: str = "url", every: str | None = None) -> StreamingQuery:
    """Starts a query that appends to ``store`` the rows of each micro-batch whose address neither the store nor the batch had.

    Deduplication has no time limit, so it is an anti-join with the stored table, not watermarked state. A batch is
    written under its number; one that is tried again after a failure overwrites itself. Everything that is there is read once,
    or what arrives ``every`` so often ("15 minutes")."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            held = spark.read.schema(f"{url} string, batch long").parquet(store).where(F.col("batch") != number)
        except AnalysisException as e:  # the first batch finds no store
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            held = spark.createDataFrame([], f"{url} string, batch long")
        stored = held.select(F.col(url).alias("url"))
        unseen(batch, stored, order, url).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def landed_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
