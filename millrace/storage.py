"""Durable intermediate tables in the folder that a cluster shares.

Lineage is cut by written Parquet tables, never by block-manager copies, so that a lost executor costs
a task and not the query.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SESSION_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used and set, but only with a local master (tests on one
    machine); on a cluster the absence is an error, since machines don't see each other's folders. The folder is
    removed when the Python driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _SESSION_DIRS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(base)
        path = f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"
        _SESSION_DIRS[app] = path
        atexit.register(_remove, spark, path)
    return _SESSION_DIRS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later uses read the table, with its statistics.

    Any frame is allowed, an empty one included; the schema is kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
