"""Claims arriving as a stream."""

from claimlens.operators import audit
from claimlens.session import shared_dir, write_once


def audit_stream(claims, secondaries_of, cat, month, out, checkpoint, facility_month=None):
    """Audit a stream of claims micro-batch by micro-batch with the batch audit.

    ``secondaries_of``: function of a batch of claims that gives its secondary
    procedures, or None. Each batch writes its own folder below ``out`` and writes
    it whole, so that a repeated batch after a failure leaves no duplicates. Rules and
    capacity of the month are written once, before the first batch, and read by all.
    The query stops when all input present at the start is processed.
    """
    base = shared_dir(claims.sparkSession, "audit-tables")
    tables = audit.audit_tables(cat, month, facility_month, keep=lambda name, df: write_once(df, f"{base}/{name}"))

    def one_batch(batch, batch_id):
        sec = secondaries_of(batch) if secondaries_of else None
        verdicts, _, _ = audit.audit(batch, sec, cat, month, facility_month, tables=tables)
        verdicts.write.mode("overwrite").parquet(f"{out}/lote={batch_id}")

    return (
        claims.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def audit_orders(b, month="202402"):
    """The test tables' orders as a stream of claims; returns all verdicts."""
    spark = b.spark
    base = shared_dir(spark, "stream-audit")
    schema = b.raw("orders").schema
    orders = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1).parquet(b.stream_path("orders"))
    )
    # the stream meets these on every batch: written once
    for name in ("order_parts", "first_lines"):
        b.__dict__[name] = write_once(b.table(name), f"{base}/{name}")
    secs = b.claim_secondaries
    q = audit_stream(
        b.claims_from(orders),
        lambda batch: secs.join(batch.select("claim_id"), "claim_id", "left_semi"),
        b, month, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("lote")
