"""Session settings and the shared work folder."""

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(app="claimlens", master=None, shuffle_partitions=None, extra=None):
    """A session with the settings the operators are designed for.

    Broadcast joins are left to Spark's own size checks (static threshold plus
    AQE run-time sizes), and skewed join partitions are split at run time.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark):
    """Give this package to the Python workers, once per Spark context.

    Functions are sent to workers by module name, so the package must be importable
    there whatever folder the driver was started in.
    """
    sc = spark.sparkContext
    if getattr(sc, "_claimlens_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="claimlens-code-"), "claimlens.zip")
    with zipfile.ZipFile(name, "w") as z:
        for here, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(here, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(name)
    sc._claimlens_shipped = True


def shared_dir(spark, label):
    """A new folder under the cluster's checkpoint folder.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where that is
    unset in local mode (tests on one machine) a temporary folder is chosen and
    recorded, so that later calls agree; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="claimlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def write_once(df, path, partition_by=()):
    """Write a table and read it back: cuts lineage and survives lost executors."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
