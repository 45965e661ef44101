"""Session defaults for local runs; a cluster brings its own settings."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from .storage import shared_dir


def local_session(cores: str | int | None = None, app: str = "millrace", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use. ``conf`` keys use ``__`` for dots."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that UDFs can import it wherever they run.

    The archive lies in the folder that the cluster shares, where executors that join later find it too.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/millrace.zip"
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(data.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)
