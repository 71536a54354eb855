"""Document corpus: file discovery and attributes read from file paths."""

from functools import reduce

from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv
from claimlens.functions.codes import as_col
from claimlens.functions.text import strip


def discover(spark, folder, extensions=None, with_content=True):
    """Files below a folder, by extension, hidden paths skipped.

    One row per file: path, its part below the folder, length and (on demand)
    content. Sorting is left to the reader of the table; rows are not gathered.
    """
    exts = extensions or fv.CORPUS_EXTENSIONS
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    base = folder.rstrip("/")
    relative = F.substring_index(F.col("path"), base + "/", -1)
    hidden = F.exists(F.split(relative, "/"), lambda p: p.startswith("."))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    cols = ["path", relative.alias("relative_path"), ext.alias("extension"), "length"]
    if with_content:
        cols.append("content")
    return files.where(ext.isin(exts) & ~hidden).select(*cols)


def spread(df, key):
    """Spread an input whose scan has fewer partitions than there are cores.

    Row-local text work is bound by the number of scan tasks, and a small table is
    often a single file. A large table has more scan partitions than cores and is
    left as it is: its texts are not shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def path_year(path):
    """Year 2000-2030 in the first path part that holds four digits in that range."""
    parts = F.split(as_col(path), "/")
    firsts = F.transform(parts, lambda p: F.regexp_extract(p, r"(\d{4})", 1))
    ok = F.filter(firsts, lambda y: (y != "") & y.try_cast("int").between(2000, 2030))
    return F.coalesce(F.try_element_at(ok, F.lit(1)), F.lit(""))


def file_name(path):
    return F.element_at(F.split(as_col(path), "/"), -1)


def is_annex(path):
    name = F.lower(file_name(path))
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(m)) for m in fv.ANNEX_NAME_MARKERS])


def source_name(path, year=""):
    """Readable source name: the file stem, separators to blanks, cut, year added."""
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    clean = F.translate(stem, fv.SOURCE_NAME_NOISE, "")
    # one pass over double blanks, as a literal replacement
    clean = strip(F.replace(F.translate(clean, "_-", "  "), F.lit("  "), F.lit(" ")))
    clean = F.substring(clean, 1, fv.SOURCE_NAME_CHARS)
    y = as_col(year) if not isinstance(year, str) else F.lit(year)
    return F.when(y != "", F.concat(clean, F.lit(" ("), y, F.lit(")"))).otherwise(clean)


def document_type(path):
    """Annex first (an annex of an ordinance is still an annex), then ordinance, else manual."""
    return (
        F.when(is_annex(path), "anexo_sigtap")
        .when(F.contains(F.lower(as_col(path)), F.lit("portaria")), "portaria")
        .otherwise("manual")
    )


def manual_source_name(path, name):
    """Canonical name of the known manual editions; other names stay."""
    p, n = as_col(path), as_col(name)
    has = lambda c, w: F.contains(c, F.lit(w))
    return (
        F.when(has(p, "2017") | has(n, "2017"), fv.MANUAL_2017)
        .when(has(F.lower(n), "sia") | has(p, "SIA"), fv.MANUAL_SIA)
        .when(has(F.lower(p), "manual_tecnico_sistema") | has(F.lower(n), "manual sih"), fv.MANUAL_2012)
        .otherwise(n)
    )


def with_path_attributes(df, path="path"):
    """Add ano, is_annex, tipo, fonte and fonte_id for a path column.

    ``fonte`` is cut for display, so files may share it; ``fonte_id``, a hash of the
    whole path, is the key to replace a file's rows by.
    """
    return (
        df.withColumn("ano", path_year(path))
        .withColumn("is_annex", is_annex(path))
        .withColumn("tipo", document_type(path))
        .withColumn("fonte", source_name(path, F.col("ano")))
        .withColumn("fonte_id", F.sha2(as_col(path).cast("binary"), 256))
    )


def cap_annex_pages(pages, annex="is_annex", page="pagina", cap=None):
    """Page rows, with annexes kept only up to the page cap if there is one."""
    if cap is None:
        return pages
    return pages.where(~F.col(annex) | (F.col(page) <= cap))


def cap_annex_page_array(pages, annex, cap=None):
    """The same for an ``array<struct<pagina,texto>>`` column."""
    if cap is None:
        return as_col(pages)
    return F.when(as_col(annex), F.filter(as_col(pages), lambda p: p["pagina"] <= cap)).otherwise(as_col(pages))
