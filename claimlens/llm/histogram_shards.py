"""Sharding by histogram sort: splitters from exact byte counts, then one exchange. DataFrame functions only.

Rows are ordered by (number from the text's MD5, number from the id's MD5, row), so
equal texts lie side by side and every key is spread evenly, whatever the ids. Shard
i begins at the first row with at least i/n of all bytes before it. To find it,
ranges of keys are cut by probes and the bytes between them counted across all
partitions; the range that holds a boundary is probed again, more finely, until the
boundary is one row (or within the tolerance). A number shared by many rows, such as
that of a text which a third of all rows hold, is cut by the next part of the key.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.session import write_once

from .work import folder

#: Ranges into which one round of probes cuts a range (one row each comes to the driver).
PROBES = 1024
KEY = ("h", "k", "row")


def number(text):
    """60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _counts(rows, ranges):
    """{range: [(rows, bytes, least, most) of each occupied part, in order]} of the given key ranges.

    A range is (fixed key values, from, to): the next key column lies in [from, to).
    """
    ranges = sorted(ranges)
    parts = []
    for fixed, lo, hi in ranges:
        col = F.col(KEY[len(fixed)])
        inside = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(KEY, fixed, strict=False)], (col >= lo) & (col < hi))
        step = -(-(hi - lo) // PROBES)
        parts.append((inside, F.expr(f"(`{KEY[len(fixed)]}` - {lo}L) div {step}L"), col))
    pick = lambda values: F.coalesce(*[F.when(inside, v) for (inside, *_), v in zip(parts, values, strict=True)])
    cut = rows.filter(reduce(lambda a, b: a | b, [p[0] for p in parts])).select(
        pick([F.lit(i) for i in range(len(parts))]).alias("r"), pick([p[1] for p in parts]).alias("b"), pick([p[2] for p in parts]).alias("v"), "size")
    out = {r: [] for r in ranges}
    # PROBES rows a range at most
    for r, _, *x in cut.groupBy("r", "b").agg(F.count("*"), F.sum("size"), F.min("v"), F.max("v")).orderBy("r", "b").collect():
        out[ranges[r]].append(tuple(x))
    return out


def splitters(rows, shards, tolerance=0):
    """The keys at which shards 1, 2, .. begin; ``None`` where no row is left for a shard.

    ``rows``: h, k, row and size. Boundaries are off by less than a row, or by
    ``tolerance`` bytes if that is more.
    """
    total, top = rows.agg(F.sum("size"), F.max("h")).first()
    found = [None] * (shards - 1)
    # target -> (bytes before the range, range)
    live = {} if total is None else {i: (0, ((), 0, top + 1)) for i in range(shards - 1)}
    while live:
        counts = _counts(rows, {r for _, r in live.values()})
        after = {}
        for i, (below, (fixed, lo, hi)) in live.items():
            target = -(-(i + 1) * total // shards)
            for n, size, least, most in counts[fixed, lo, hi]:
                if below + size < target:
                    below += size
                    continue
                edge = (*fixed, most + 1, 0, 0)[:3]
                if n == 1 or below + size - target <= tolerance:
                    found[i] = edge
                elif target - below <= tolerance:
                    found[i] = (*fixed, least, 0, 0)[:3]
                elif least == most:
                    # one value: its rows are told apart by the next column
                    after[i] = below, ((*fixed, least), 0, 1 << 62)
                else:
                    after[i] = below, (fixed, least, most + 1)
                break
        live = after
    return found


def _at_or_after(key):
    h, k, row = (F.lit(x) for x in key)
    return (F.col("h") > h) | ((F.col("h") == h) & ((F.col("k") > k) | ((F.col("k") == k) & (F.col("row") >= row))))


def histogram_shards(docs, shards=8, id_col="doc_id", text_col="text", tolerance=0, carry=()):
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row, and the columns of ``carry``.

    * Size is the text's UTF-8 bytes plus 1; a null text counts as an empty one.
    * Law ``bytes``: a shard's bytes differ from an equal share by less than its first
      and last row. Slots follow the key and have no gaps. ``grown_shard`` is null.
    * Equal texts are neighbours: only a group across one of the boundaries is in two
      shards. Rows that repeat id and text are told apart by their place in the input;
      a null id counts as an empty one. Other columns are ignored.
    * With fewer rows than shards some shards stay empty; no rows give no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = ["h", "k", "row", "doc_id", "size", "text_crc32"]
    rows = write_once(docs.select(
        number(text).alias("h"), number(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("k"), F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(c).alias(f"carry_{c}") for c in carry]), folder(spark, "op13-keys"))
    keys = [s for s in splitters(rows.select(*KEY, "size"), shards, tolerance) if s is not None]
    shard = sum((F.when(_at_or_after(s), 1).otherwise(0) for s in keys), F.lit(0)).cast("int")
    # the one exchange: ranges of the key, each sorted and numbered
    place = F.monotonically_increasing_id()
    placed = rows.withColumn("shard", shard).repartitionByRange("shard", *KEY).sortWithinPartitions("shard", *KEY)
    placed = write_once(placed.withColumn("place", place).withColumn("piece", F.shiftright("place", 33)), folder(spark, "op13-placed"))
    # one row per partition of the exchange and shard in it
    runs = placed.groupBy("piece", "shard").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")
    runs = runs.select("piece", "shard", (before - F.col("first")).alias("shift"))
    return placed.join(runs, ["piece", "shard"]).select(
        *names[3:], F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"carry_{c}").alias(c) for c in carry if c not in names[3:]])


def write_shards(docs, path, shards=8, id_col="doc_id", text_col="text", tolerance=0):
    """Writes the rows of ``docs`` with their slots, one folder ``shard=i`` each; within a file slots ascend."""
    out = histogram_shards(docs, shards, id_col, text_col, tolerance, carry=docs.columns)
    out = out.select(*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


#: A byte's CRC-32 step and the byte values of a text, since this SQL has no such function.
SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
rows AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size,
    CAST('0x' || md5(coalesce(text, ''))[1:15] AS BIGINT) AS h, CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) AS k
  FROM documents),
sums AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY h, k ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS below,
    CAST(sum(size) OVER () AS BIGINT) AS total FROM rows),
placed AS (SELECT *, CAST(8 * below // total AS INTEGER) AS shard FROM sums)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS BIGINT) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, k) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed, steps
"""
