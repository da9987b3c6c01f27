"""Micro-batch ingest: new raw pages become cleaned pages by the batch transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelode.operators.dedupe import latest
from sitelode.plans.pipeline import clean
from sitelode.schemas import RAW_PAGES
from sitelode.sources.store import Store


def stream_pages(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of raw pages from parquet files as they come into ``folder``."""
    return spark.readStream.schema(RAW_PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_of_each(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Each (url, scraped_at) once; a watermark on the time of the scrape bounds the state."""
    timed = stream.withColumn("at", F.to_timestamp("scraped_at")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["url", "scraped_at"]).drop("at")


def ingest(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Clean and upsert every micro-batch; a batch that is run again gives the same table.

    Within a batch the newest scrape of a url wins, as in the batch path.
    """

    def save(batch: DataFrame, _: int) -> None:
        newest = latest(batch, ["url"], ["scraped_at", "id"])
        store.save_pages(newest)
        store.save_cleaned(clean(newest))

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
