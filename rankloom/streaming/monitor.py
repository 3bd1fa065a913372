"""Site monitor over crawl files as they arrive.

Each micro-batch is one complete crawl: it is compared with the latest snapshot, and the next snapshot is
written to a new folder named after the batch. A batch that is run again after a failure reads the
snapshot before it and overwrites its own folder, so the result is the same.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators import snapshots

CRAWL_SCHEMA = "site_id bigint, url string, crawled_at timestamp_ntz"
SNAPSHOT_SCHEMA = "site_id bigint, page_url string, first_seen timestamp_ntz, last_seen timestamp_ntz"


def _snapshot(spark: SparkSession, out: str, batch: int) -> DataFrame:
    """Snapshot of the newest batch before ``batch``; empty at the start."""
    if batch > 0:
        try:
            return spark.read.schema(SNAPSHOT_SCHEMA).parquet(f"{out}/snapshot/batch={batch - 1}")
        except AnalysisException as missing:
            raise ValueError(f"snapshot of batch {batch - 1} is missing in {out}") from missing
    return spark.createDataFrame([], SNAPSHOT_SCHEMA)


def apply_crawl(crawl: DataFrame, batch: int, out: str) -> None:
    """Write the changes of one crawl and the snapshot after it."""
    history = _snapshot(crawl.sparkSession, out, batch)
    moment = crawl.agg(F.max("crawled_at")).scalar()
    current = snapshots.current_pages(crawl)
    snapshots.changes(current, history).write.mode("overwrite").parquet(f"{out}/changes/batch={batch}")
    snapshots.applied(current, history, moment).write.mode("overwrite").parquet(f"{out}/snapshot/batch={batch}")


def watch_crawls(spark: SparkSession, crawls: str, out: str, progress: str) -> StreamingQuery:
    """Process every crawl file below ``crawls`` that has not been processed, one file per batch, then stop."""
    arriving = spark.readStream.schema(CRAWL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(crawls)
    return (
        arriving.writeStream.foreachBatch(lambda crawl, batch: apply_crawl(crawl, batch, out))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
