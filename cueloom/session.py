"""Session defaults and lineage cuts.

The library never sets cluster-wide knobs itself: `local_session` is for tests and the bench, a cluster passes its own
session.  Shuffle width is left to AQE, which coalesces small partitions and splits skewed join partitions.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "cueloom", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CUELOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only where no such setting exists (tests)."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    fresh = tempfile.mkdtemp(prefix="cueloom-ckpt-")
    spark.conf.set(CHECKPOINT_KEY, fresh)
    return fresh


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one), so a lost executor only costs a re-read.

    Used where a computed table is read more than once further on: Spark would otherwise run everything before it once
    per reader, and chained ordered scans would double that work at every step.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def as_table(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again: for what is read more than once, in compressed columns, where `cut_lineage` writes plain rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package() -> None:
    """Send this package's functions to Python workers by value, so a cluster needs no extra files for them."""
    import cueloom
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(cueloom)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the session's shuffle width before CPU-heavy work.

    Edit distances cost far more than moving their rows, and a fixed width keeps AQE from folding small-but-slow
    partitions into one task.  Skewed text lengths end up evenly mixed as a side effect.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a few short values that may be broadcast: some 40 MB.
BROADCAST_ROWS = 1 << 18


def small_side(df: DataFrame) -> DataFrame:
    """The side of a join, marked for broadcast if it has at most `BROADCAST_ROWS` rows, else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
