"""Monthly snapshot tables on Parquet: ``{root}/{SIGTAP|CNES}/{YYYYMM}/{table}.parquet``."""

from pyspark.sql import functions as F

from claimlens.sources import schemas as S


def _fs(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_table(spark, root, table, months=None):
    """All snapshots of one table, or only the given months.

    The month is also part of the path, so naming months restricts which folders
    are listed and opened; the filter on the stored column is kept as well.
    """
    picked = normalise_months(months)
    folder = "{" + ",".join(picked) + "}" if picked else "*"
    path = f"{root}/{S.source_of(table)}/{folder}/{S.file_stem(table)}.parquet"
    df = spark.read.schema(S.schema(table)).parquet(path)
    return df.where(F.col(S.MONTH).isin(picked)) if picked else df


def register_views(spark, root, tables=None):
    """A temporary view per table that exists below the root."""
    done = []
    for table in tables or sorted(S.COLUMNS):
        pattern = f"{root}/{S.source_of(table)}/*/{S.file_stem(table)}.parquet"
        fs, p = _fs(spark, pattern)
        if fs.globStatus(p):
            read_table(spark, root, table).createOrReplaceTempView(table)
            done.append(table)
    return done


def list_months(spark, root, source=S.CATALOG_SOURCE):
    """Sorted six-digit snapshot folders of a source (folder names only, no data is read)."""
    fs, p = _fs(spark, f"{root}/{source}/*")
    names = {s.getPath().getName() for s in fs.globStatus(p) or [] if s.isDirectory()}
    return sorted(n for n in names if len(n) == 6 and n.isdigit())


def load_table(spark, root, table, month):
    """One snapshot of one table; None where the file is missing."""
    path = f"{root}/{S.source_of(table)}/{month}/{S.file_stem(table)}.parquet"
    fs, p = _fs(spark, path)
    return spark.read.schema(S.schema(table)).parquet(path) if fs.exists(p) else None


def write_snapshot(df, root, table):
    """Write a table in the snapshot layout, one folder per month found in the data."""
    months = [r[0] for r in df.select(S.MONTH).distinct().sort(S.MONTH).collect()]
    for m in months:
        out = df.where(F.col(S.MONTH) == m).select(*S.COLUMNS[table], S.MONTH)
        out.write.mode("overwrite").parquet(f"{root}/{S.source_of(table)}/{m}/{S.file_stem(table)}.parquet")
    return months


def write_partitioned(df, path):
    """Rewrite all snapshots as one table partitioned by month (for partition pruning)."""
    df.write.mode("overwrite").partitionBy(S.MONTH).parquet(path)


def normalise_months(months):
    """None, one month or many to a sorted list without repeats; empty means no filter."""
    if not months:
        return []
    return sorted({months} if isinstance(months, str) else set(months))


def at_months(df, months=None):
    """Rows of the given months; no filter when none are given."""
    picked = normalise_months(months)
    return df.where(F.col(S.MONTH).isin(picked)) if picked else df


def at_latest(df):
    """Rows of the table's newest month. An empty table gives an empty result."""
    return df.where(F.col(S.MONTH) == df.agg(F.max(S.MONTH)).scalar())


def latest_month(df):
    """The newest month as a one-row frame."""
    return df.agg(F.max(S.MONTH).alias(S.MONTH))
