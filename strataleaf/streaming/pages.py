"""Page rows as a stream: features as they arrive, contents for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strataleaf.operators import features
from strataleaf.plans import flows
from strataleaf.sources import pages as source


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Page rows of the JSON files that appear in a folder."""
    return spark.readStream.schema(source.PAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def feature_stream(pages: DataFrame) -> DataFrame:
    """Features of each page's first blocks; no state, so any output mode works."""
    return features.first_blocks(source.spans_from_pages(pages))


def write_contents(pages: DataFrame, out_path: str, checkpoint_path: str) -> StreamingQuery:
    """Appends the contents of the documents of each micro-batch; a batch that is run again replaces its own rows.

    A document's pages must arrive in one file.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        entries = flows.contents_without_inference(source.spans_from_pages(batch))
        entries.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
