"""Session settings and the shared folder for stored intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "rankloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on; cluster settings stay with spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Above 8000 bytes of bytecode HotSpot interprets a method; wide rule tables are then better off
        # with Spark's split projections than with one huge generated loop.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Recording a Python call site per expression costs more than building the plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session, which every executor can reach.

    Without the setting it is a folder in the warehouse, never one that only this machine sees.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not wanted:
        wanted = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    sc.setCheckpointDir(wanted)
    return wanted


#: Rows of a file of a stored table. Spark packs files into a task by their size, which says little where columns pack well: a
#: task would sort some millions of rows, and spill.
ROWS_PER_FILE = 16_384


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Used where a result is read more than once or where the placement of rows must not change. The table
    outlives lost executors, and later reads prune columns and know its size.
    """
    spark = df.sparkSession
    location = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankloom-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(location)
    return spark.read.schema(df.schema).parquet(location)
