"""Input columns by exact name, and intermediate tables in the shared folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns ``wanted`` (new name -> name in ``df``) and nothing else.

    Columns are found by their exact name and by position, so further columns whose names differ only in case, or that
    repeat a name this library uses itself, cannot clash.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{df.columns.index(name)}").alias(new) for new, name in wanted.items()))


def row_key(text: Column) -> list[Column]:
    """Two independent 64-bit digests of a text: what tells rows with the same id apart."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(text, F.lit("second")).alias("key_b")]


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or a folder in the warehouse where that is not set."""
    from rankloom.session import CHECKPOINT_KEY

    conf = spark.sparkContext.getConf()
    named = spark.conf.get(CHECKPOINT_KEY, None) or conf.get(CHECKPOINT_KEY)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def store(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with these options of the writer, and read it back.

    The lineage ends there: a lost executor costs no earlier work, and every later read sees the same rows.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(place)
    return spark.read.schema(df.schema).parquet(place)
