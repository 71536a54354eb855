"""Documents arriving as a stream, replaced source by source."""

from functools import reduce

from pyspark.sql import functions as F

from claimlens.session import shared_dir, write_once
from claimlens.sources.sinks import overwrite_sources, source_key, table_at


def replace_stream(documents, table, checkpoint, source=None):
    """Replace, for every batch, the table partitions of the sources it contains.

    A batch must hold a source completely (one file per edition; else see
    ``replace_editions``). Rewriting whole partitions makes a repeated batch harmless.
    """
    def one_batch(batch, _batch_id):
        overwrite_sources(batch, table, source)

    return (
        documents.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def replace_editions(documents, table, stage, checkpoint, source=None, wait=None):
    """Replace sources by editions that may arrive over several batches, in any order.

    Rows carry ``edicao`` (larger is newer), ``parte`` and ``partes``, the number of parts of
    the edition. Rows wait below ``stage`` until their edition has all its parts; then the
    newest complete edition of a source replaces the source's partition, unless the table
    already holds a newer one. A part that comes again counts once, as it came last.
    Editions that are still incomplete ``wait`` batches after their first part go to
    ``stage/incompletas`` (``None``: they wait for ever).

    Every batch derives its waiting rows from the ones of the batch before and writes them
    whole, and partitions are rewritten whole, so a repeated batch changes nothing.
    """
    def one_batch(batch, batch_id):
        spark = batch.sparkSession
        key = source or source_key(batch)
        edition = [key, "edicao"]
        new = batch.withColumn("_lote", F.lit(batch_id)).withColumn("_desde", F.lit(batch_id))
        before = table_at(spark, f"{stage}/espera/lote={batch_id - 1}") if batch_id else []
        rows = before[0].unionByName(new) if before else new
        # of a repeated part the rows of its last batch; a window would bring all rows of a part to one task
        part = [*edition, "parte"]
        last = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in part]).agg(F.max("_lote").alias("_ultimo"))
        last = write_once(last, f"{stage}/partes/lote={batch_id}")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in part]) & (F.col("_lote") == F.col("_ultimo"))
        rows = write_once(rows.join(last, same, "left_semi"), f"{stage}/lidas/lote={batch_id}")
        state = rows.groupBy(*edition).agg(F.countDistinct("parte").alias("n"), F.max("partes").alias("partes"), F.min("_desde").alias("desde"))
        state = write_once(state.withColumn("completa", F.col("n") >= F.col("partes")), f"{stage}/edicoes/lote={batch_id}")
        ready = state.where("completa").groupBy(key).agg(F.max("edicao").alias("edicao"))
        for held in table_at(spark, table):
            # a row per source
            current = held.groupBy(key).agg(F.max("edicao").alias("_atual"))
            ready = ready.join(current, key, "left").where("_atual is null or edicao >= _atual").drop("_atual")
        ready = write_once(ready, f"{stage}/publicadas/lote={batch_id}")
        overwrite_sources(rows.join(ready, edition, "left_semi").drop("_lote", "_desde"), table, key)
        open_ = state.where("not completa").select(*edition, F.col("desde").alias("_inicio"))
        waiting = rows.join(open_, edition).withColumn("_desde", F.col("_inicio")).drop("_inicio")
        if wait is not None:
            late = F.col("_desde") + wait <= batch_id
            waiting.where(late).write.mode("overwrite").parquet(f"{stage}/incompletas/lote={batch_id}")
            waiting = waiting.where(~late)
        waiting.write.mode("overwrite").parquet(f"{stage}/espera/lote={batch_id}")

    return (
        documents.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def edition_documents(b, files=4):
    """The test documents as new editions, every source spread over several batches."""
    spark = b.spark
    base = shared_dir(spark, "stream-editions")
    view = b.raw("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("fonte"), F.col("text").alias("texto"), F.pmod("doc_id", F.lit(files)).alias("parte"))
    overwrite_sources(view.drop("parte").withColumns({"texto": F.lit("old edition"), "edicao": F.lit(1), "parte": F.lit(0).cast("long"), "partes": F.lit(1).cast("long")}), f"{base}/table")
    # written: a row per source, so that the documents need no exchange to meet it
    partes = write_once(view.groupBy("fonte").agg(F.countDistinct("parte").alias("partes")), f"{base}/partes")
    new = view.join(partes, "fonte").withColumn("edicao", F.lit(2)).select("id", "texto", "edicao", "parte", "partes", "fonte")
    # rows without a part come with the first
    new = write_once(new.withColumn("_p", F.coalesce("parte", F.lit(0))), f"{base}/parted", ["_p"])
    for p in range(files):
        # a part may be many files, and comes as one batch: each run of the stream takes what came since the last
        new.where(F.col("_p") == p).drop("_p").write.mode("append").parquet(f"{base}/in")
        come = spark.readStream.schema(new.drop("_p").schema).parquet(f"{base}/in")
        replace_editions(come, f"{base}/table", f"{base}/stage", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/table")


def replace_documents(b):
    """The test documents as a stream of editions over a table of older texts."""
    spark = b.spark
    base = shared_dir(spark, "stream-docs")
    view = lambda df: df.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("fonte"), F.col("text").alias("texto"))
    old = view(b.raw("documents")).withColumn("texto", F.lit("old edition"))
    overwrite_sources(old, f"{base}/table")
    new = view(spark.readStream.schema(b.raw("documents").schema).parquet(b.stream_path("documents")))
    replace_stream(new, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/table")
