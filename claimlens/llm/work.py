"""Intermediate tables in the folder the cluster shares."""

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import functions as F

#: Bits of a bitmap (a fixed 512 KB, whatever it is made from).
BITS = 1 << 22
#: Bytes of an Arrow batch in ``small_batches``, the row that passes them included; 10 000 rows (Spark's default) are some 30 MB of texts.
BATCH_BYTES = 1 << 20


@contextlib.contextmanager
def small_batches(spark):
    """What is run inside sends batches of some BATCH_BYTES to Python; then the session's own setting holds again.

    A task has a batch several times: as Arrow buffers outside the heap, which double as they grow, and in its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def folder(spark, label):
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def bitmap(hashes):
    """One row: the bitmap of a hash column as a full array of longs."""
    n = BITS // 64
    spark = hashes.sparkSession
    some = hashes.select(F.pmod("h", F.lit(BITS)).alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v"))
    full = spark.range(n).select(F.col("id").cast("int").alias("i")).join(some, "i", "left")
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("v", F.lit(0).cast("long")).alias("v")))),
                                lambda x: x["v"]).alias("bits"))


def in_bitmap(bits, h):
    bit = F.pmod(h, F.lit(BITS))
    return F.getbit(F.get(bits, (bit / 64).cast("int")), (bit % 64).cast("int")) == 1
