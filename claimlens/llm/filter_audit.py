"""Filter interaction audit: what five filters remove, in each of their 120 orders.

A document's failures are five bits. Documents are counted by part and bits first
(mask cells, 32 a part at most), so nothing after that depends on their number. A
recursive query starts from the masks that occur, extends filter prefixes by unused
letters and carries the applied bits; each level says for its step whether a mask is
removed, kept or redundant there. Joined with the cells this gives the metrics.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.session import write_once

from .work import folder

#: Fixed values of the filters.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 100, 80, 10, r"[#$%&*|]"

STEPS = """
WITH RECURSIVE steps (mask, taken, applied, step, letter, earlier) AS (
  SELECT mask, '', 0, 0, -1, 0 FROM {masks}
  UNION ALL
  SELECT mask, concat(taken, substring('{letters}', i + 1, 1)), applied | shiftleft(1, i), step + 1, i, applied
  FROM (SELECT mask, taken, applied, step, explode(filter(sequence(0, {n} - 1), i -> (applied & shiftleft(1, i)) = 0)) AS i
        FROM steps WHERE step < {n}))
SELECT mask, taken, step, letter,
  (mask & applied) = 0 AS kept,
  (mask & shiftleft(1, letter)) <> 0 AND (mask & earlier) = 0 AS removed,
  (mask & shiftleft(1, letter)) <> 0 AND (mask & earlier) <> 0 AS redundant,
  mask = shiftleft(1, letter) AS alone
FROM steps WHERE step > 0
"""


def failures(docs, id_col="doc_id", text_col="text", part_col="lang"):
    """``doc_id, part, mask, digest``: bits of the filters A to D, and what stands for the text (SHA-256)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("w", F.array_remove(F.split("text", SPACE), ""))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [F.size("w") < MIN_WORDS, 100 * F.size(F.array_distinct("w")) < MIN_DISTINCT * F.size("w"),
             100 * upper > MAX_UPPER * F.length("text"), F.col("text").rlike(SYMBOLS)]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_cells(docs, labels, id_col="doc_id", text_col="text", part_col="lang"):
    """``part, mask, n, good, toxic``: documents by part and failed filters, E included."""
    spark = docs.sparkSession
    rows = write_once(failures(docs, id_col, text_col, part_col), folder(spark, "op12-failures"))
    kind = dict(rows.dtypes)["doc_id"]
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast(kind).alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = rows.filter("doc_id is not null").join(marks, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # rows that repeat id and text first, so that the smallest id's rows can be counted
    known = known.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    nameless = rows.filter("doc_id is null").select("doc_id", "digest", "part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.lit(1).cast("long").alias("n"))
    # a text held by a third of all rows combines before the shuffle
    named = F.col("doc_id").isNotNull()
    texts = known.unionByName(nameless).groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(named, F.lit(0)).otherwise(F.col("n"))).alias("nameless"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("low"))
    # few rows a text: one for each part and label
    least = F.min("low.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("low.doc_id") == F.col("least"), F.col("low.n")).otherwise(F.lit(0)) + F.col("nameless")
    both = F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")),
                   F.struct((F.col("mask") + F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    cells = (texts.withColumn("least", least).withColumn("firsts", firsts)
             .select("part", "good", "toxic", F.explode(both).alias("x")).filter("x.n > 0"))
    return cells.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def prefix_steps(cells):
    """One row per mask that occurs and filter prefix: what its last filter does to the mask (32 * 325 rows at most)."""
    return cells.sparkSession.sql(STEPS.replace("{letters}", FILTERS).replace("{n}", str(len(FILTERS))), masks=cells.select("mask").distinct())


def filter_audit(docs, labels, id_col="doc_id", text_col="text", part_col="lang"):
    """``part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    * One row per part, order and step, zeros included. A null and an empty part are
      one part; a null text is an empty one, and equal to it for filter E.
    * A row without id is smaller or larger than none: it never fails E and has no
      labels. Rows that repeat an id are documents each for itself; of an id's label
      rows any that says 1 counts. Other columns are ignored.
    * No documents give no rows; no labels give rows without good or toxic losses.
    """
    spark = docs.sparkSession
    cells = write_once(mask_cells(docs, labels, id_col, text_col, part_col), folder(spark, "op12-cells"))
    steps = write_once(prefix_steps(cells), folder(spark, "op12-steps"))
    total = lambda flag, n="n": F.sum(F.when(F.col(flag), F.col(n)).otherwise(F.lit(0)))
    done = cells.join(steps, "mask").groupBy("part", "taken", "step", "letter").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"),
        total("alone").alias("unique_fails"), total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"))
    orders = steps.filter(F.col("step") == len(FILTERS)).select(F.col("taken").alias("filter_order")).distinct()
    orders = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    orders = orders.withColumn("taken", F.expr("substring(filter_order, 1, step)"))
    # a part's filter is removed in 120 places
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return done.drop("step").join(orders, "taken").select(
        "part", "filter_order", "step", F.expr("substring(filter_order, step, 1)").alias("filter"),
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM words LEFT JOIN marks ON marks.doc_id = words.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask),
steps AS (
  SELECT '' AS taken, 0 AS applied, 0 AS step, -1 AS letter, 0 AS earlier
  UNION ALL
  SELECT taken || substr('ABCDE', i + 1, 1), applied | (1 << i), step + 1, i, applied
  FROM steps, (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE step < 5 AND applied & (1 << i) = 0),
done AS (
  SELECT part, taken, step, letter,
    sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & (1 << letter) <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & (1 << letter) <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = 1 << letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & (1 << letter) <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & (1 << letter) <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps WHERE step > 0 GROUP BY part, taken, step, letter),
orders AS (SELECT taken AS filter_order, unnest([1, 2, 3, 4, 5]) AS k FROM steps WHERE step = 5)
SELECT part, filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS filter, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM orders JOIN done ON done.taken = substr(filter_order, 1, k)
"""
