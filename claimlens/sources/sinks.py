"""Table sinks of the document side."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


def write_corpus(chunks, sections, folder, fmt="parquet"):
    """Write chunks, sections and the child-to-parent map."""
    chunks.write.mode("overwrite").format(fmt).save(f"{folder}/chunks")
    sections.write.mode("overwrite").format(fmt).save(f"{folder}/secoes")
    parent_map(chunks).write.mode("overwrite").format(fmt).save(f"{folder}/parent_child_map")


def parent_map(chunks):
    return chunks.where(F.col("parent_id").isNotNull()).select("id", "parent_id")


def source_key(*frames):
    """The column that tells sources apart: ``fonte_id``, or ``fonte`` where no frame has that.

    Different files may share ``fonte``, so a side that alone lacks ``fonte_id`` is an error.
    """
    have = {"fonte_id" in f.columns for f in frames}
    if len(have) > 1:
        raise ValueError("fonte_id is missing on one side; add it there, or name the key with source=")
    return "fonte_id" if True in have else "fonte"


def table_at(spark, path):
    """The table at a path as a list of one frame; of none if nothing is there yet."""
    try:
        return [spark.read.parquet(path)]
    except AnalysisException:
        return []


def replace_by_source(existing, new, source=None):
    """Existing rows of the sources not in ``new``, plus all rows of ``new``."""
    source = source or source_key(existing, new)
    sources = new.select(source).distinct()
    return existing.join(sources, source, "left_anti").unionByName(new, allowMissingColumns=True)


def overwrite_sources(new, path, source=None):
    """The same in place: only the partitions of the new sources are rewritten."""
    source = source or source_key(new, *table_at(new.sparkSession, path))
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(source).parquet(path))


def vector_collection(chunks, vectors, path=None):
    """Children with their vectors and metadata; written over ``path`` if given."""
    meta = ["secao", "titulo", "pagina", "fonte", "ano", "tipo", *(["fonte_id"] if "fonte_id" in chunks.columns else [])]
    rows = (
        chunks.where(~F.coalesce(F.col("is_parent"), F.lit(False)))
        .select("id", F.col("contexto").alias("documento"), *meta)
        .join(vectors.select("id", "embedding"), "id")
    )
    if path:
        rows.write.mode("overwrite").parquet(path)
    return rows
