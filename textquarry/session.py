"""Sessions and tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine's plans count on; a cluster's own values win if they are set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "textquarry", **conf: str) -> SparkSession:
    """A session with the engine's settings; further ones by keyword, dots written as two underscores."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores: a small compressed file is one task, however much each of its rows is worked on."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def parts(rows: DataFrame, most: int = 1 << 19) -> int:
    """How many partitions hold at most some ``most`` rows each, at least one for each core: a task's share doesn't grow with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def stored(rows: DataFrame) -> DataFrame:
    """Rows as a table below ``spark.checkpoint.dir``, of which each reader takes the columns that it needs; a local master gets a folder of its own.

    A cluster without that folder keeps the rows cached. The table stays until the folder is cleaned.
    """
    spark = rows.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local["):
        return rows.persist()
    path = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='textquarry-')).rstrip('/')}/stored/{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").option("parquet.block.size", 1 << 24).parquet(path)  # a writer holds a block
    return spark.read.schema(rows.schema).parquet(path)
