"""Benchmark decontamination as a prefix-filtered set join; DataFrame functions only.

Item windows are sets of k-word shingles (k = 5, or the whole window if shorter).
A document holds a window only if it holds all its shingles, so one necessary token
is enough to find it: the window's shingle that is rarest in the corpus. The corpus
is read once: a bitmap of fixed size (one scalar) of the benchmark's shingles drops
almost all document shingles as they are made; the rest are kept with the words
around them. Counting those gives the rarity order; joined with the chosen tokens
they are candidates, which are bounded by position and length and then verified
word by word.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.session import write_once

from .work import bitmap, folder, in_bitmap

#: Fixed values of the word rule: A-Z become a-z, words are runs outside these characters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Longest shingle.
SHINGLE = 5


def _words(text):
    # lower() alone would also change letters beyond A-Z
    low = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), NO_WORD), "")


def _spots(rows, lengths, bits=None):
    """The shingles of every row (with set bits), as ``pos, k, h``; and one row with pos = -1 each.

    Rows are made from positions only; the hash is taken after that, in generated code.
    """
    w, n = F.col("w"), F.size("w")
    every = F.array(F.lit(-8))
    for k in lengths:
        every = F.concat(every, F.when(n >= k, F.sequence(F.lit(k), (n - k) * 8 + k, F.lit(8))).otherwise(F.array().cast("array<int>")))
    pos = F.floor(F.col("at") / 8).cast("int")
    h = F.lit(0).cast("long")
    for k in lengths:
        h = F.when(F.col("k") == k, F.xxhash64(*[F.get(w, F.col("pos") + j) for j in range(k)])).otherwise(h)
    out = (rows.select("*", F.explode(every).alias("at")).select(*rows.columns, pos.alias("pos"), F.pmod("at", F.lit(8)).alias("k"))
           .select(*rows.columns, "pos", "k", h.alias("h")))
    return out if bits is None else out.filter((F.col("pos") < 0) | in_bitmap(bits, F.col("h")))


def windows(items, id_col="item_id", text_col="text", width=13):
    """``item_id, wtext, len``: the distinct windows of every item."""
    w = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), _words(F.col(text_col).cast("string")).alias("w"))
    n = F.size("w")
    starts = F.when(n > width, F.sequence(F.lit(1), n - width + 1)).when(n > 0, F.array(F.lit(1)))
    return (w.select("item_id", "w", F.explode(starts).alias("s"))
            .select("item_id", F.array_join(F.slice("w", F.col("s"), width), " ").alias("wtext"),
                    F.least(F.size("w"), F.lit(width)).alias("len")).distinct())


def contamination(docs, items, id_col="doc_id", text_col="text", item_id="item_id", item_text="text",
                  width=13, part=20):
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row.

    * A null text has no words; a document without words is not contaminated.
    * A word is hit if any occurrence of a window covers it; every item with an
      occurring window counts, also items that share a window or repeat a text.
    * Items without id or without words have no windows. Rows repeating a document id,
      or without one, are judged each for itself. Other columns are ignored.
    * Empty tables: no documents give no rows, no items give rows without hits.
    """
    spark = docs.sparkSession
    item_windows = write_once(windows(items, item_id, item_text, width), folder(spark, "op4-windows"))
    distinct = item_windows.select("wtext", "len").distinct()
    k_of = F.least(F.col("len"), F.lit(SHINGLE))
    # at most SHINGLE values
    lengths = sorted(r[0] for r in distinct.select(k_of).distinct().collect())
    tokens = write_once(_spots(distinct.withColumn("w", F.split("wtext", " ")), lengths).filter("pos >= 0 and k = least(len, 5)")
                        .select("wtext", "len", "k", F.col("pos").alias("off"), "h"), folder(spark, "op4-tokens"))
    bits = bitmap(tokens.select("h").distinct()).scalar()
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                        _words(F.col(text_col).cast("string")).alias("w"))
    begin = F.greatest(F.col("pos") - width, F.lit(0))
    found = _spots(words, lengths, bits).select(
        "row", "doc_id", F.size("w").cast("long").alias("n_words"), "pos", "h", "k", begin.alias("from"),
        F.when(F.col("pos") >= 0, F.slice("w", begin + 1, 2 * width)).alias("ctx"))
    found = write_once(found, folder(spark, "op4-found"))
    counts = found.filter("pos >= 0").groupBy("h").agg(F.count("*").alias("n"))
    # a window with a shingle that no document has occurs nowhere
    rare = tokens.join(counts, "h", "left").groupBy("wtext", "len", "k").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("m"))
    chosen = rare.filter("m.n > 0").select("wtext", "len", "k", F.col("m.off").alias("off"), F.col("m.h").alias("h"))

    start = F.col("pos") - F.col("off")
    cand = (found.filter("pos >= 0").join(chosen, ["h", "k"]).withColumn("start", start)
            .filter("start >= 0 and start + len <= n_words")
            .filter(F.array_join(F.slice("ctx", F.col("start") - F.col("from") + 1, F.col("len")), " ") == F.col("wtext")))
    hit = write_once(cand.select("row", "start", (F.col("start") + F.col("len")).alias("end"), "wtext"), folder(spark, "op4-hits"))
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = (hit.select("row", "start", "end").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
               .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("n_hit")))
    per_item = (hit.select("row", "wtext").distinct().join(item_windows.select("wtext", "item_id"), "wtext")
                .select("row", "item_id").distinct().groupBy("row")
                .agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (found.filter("pos < 0").select("row", "doc_id", "n_words").join(covered, "row", "left").join(per_item, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (part * n_hit >= F.col("n_words"))).alias("contaminated")))


SQL = r"""
WITH lowered AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM documents),
items AS (
  SELECT cast(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM lowered, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, spots.n, item_id FROM spots JOIN win ON win.t = spots.t AND win.n = spots.n),
cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
