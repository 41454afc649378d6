"""Session settings, table loading and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest table (rows) that an operator may ship to every task by itself. Everything else is left
# to Catalyst, whose broadcast threshold is a size check of its own.
SMALL_ROWS = 4096
# folders of local sessions that name none
_OWN: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; leaves cluster sizing (shuffle partitions, memory) alone."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key even where that costs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # what streams have seen lies on disk, and a batch writes its changes only: its time does not follow the history
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: str = "8", app: str = "hearthgraph") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str, text_work: bool | None = None) -> DataFrame:
    """A table of the folder. Tables whose text is parsed are spread when they arrive in too few pieces."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if (name in ("documents", "pages", "conversations") if text_work is None else text_work) else df


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan that yields fewer pieces than there are cores (one large row group); else unchanged.

    On a table of many files this does nothing, so no shuffle is added where the scan is parallel already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. A local session may do without and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        named = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="hearthgraph-"))
    return named


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Cut lineage with a written table, so a lost executor re-reads files instead of recomputing.

    A folder that is given is overwritten, so that of tables that follow one another only the last is kept.
    """
    spark = df.sparkSession
    path = folder or new_folder(spark, label)
    (df.write.mode("overwrite").option("compression", "zstd") if folder else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """True when df has at most `rows` rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows
