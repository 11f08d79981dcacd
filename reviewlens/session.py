"""Session helpers: a local session for tests and the checkpoint folder rule.

On a cluster the session already exists and ``spark.checkpoint.dir`` names
a shared folder; we only read it.  A folder of our own is set only when the
setting is missing (local tests).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "reviewlens") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in _CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, set on the context once.

    Only a local master may go without the setting (tests); it gets a temp
    folder that is removed when Python ends.  Anywhere else executors could not
    share such a folder, so a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="reviewlens-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def write_table(df, path: str | None = None, partition_by=()):
    """Write ``df`` once as Parquet and read it back: a lineage cut that
    survives executor loss.  Default location: a fresh folder under the
    session's shared ``spark.checkpoint.dir`` (never a machine-local folder
    on a cluster; a temp folder is set only when the setting is missing)."""
    spark = df.sparkSession
    if path is None:
        path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)
