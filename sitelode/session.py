"""Session helpers: tables, checkpoints, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "sitelode", cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    master = f"local[{cpus or os.cpu_count() or 2}]"
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SITELODE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """The parquet table ``name`` under ``root``.

    Without ``schema`` the parquet footer gives it: the columns are a file's
    own, nothing is guessed from data.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's own, else (tests) a local one.

    A cluster names a folder that all executors share in
    ``spark.checkpoint.dir``.  Only where that setting is absent, as in local
    tests, a temporary folder is made.
    """
    context = spark.sparkContext
    there = context.getCheckpointDir()
    if there:
        return there
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    if named:
        context.setCheckpointDir(named)
    else:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sitelode-ck-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable, eager checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the checkpoint folder and read back.

    Cuts the lineage as :func:`checkpointed` does, in columns and compressed, so
    that wide or long intermediate results cost less disk, and later reads prune
    columns.  The folder is removed when the application ends, or by
    :func:`release_materialised`.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[tuple[SparkSession, str]] = []


def release_materialised() -> None:
    """Remove every table that :func:`materialised` wrote; none may be in use."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone already  # noqa: BLE001
            return


atexit.register(release_materialised)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """``broadcast(df)`` where its counted rows prove it small, else ``df``.

    ``df`` should be cheap to count (checkpointed or a scan): its rows are
    counted, and the hint is only given when rows x ``row_bytes`` stay below
    ``limit`` (default: 32 MB).  Otherwise Spark's own shuffle join, with AQE's
    skew handling, is used.
    """
    limit = (32 << 20) if limit is None else limit
    most = max(1, limit // max(1, row_bytes))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
