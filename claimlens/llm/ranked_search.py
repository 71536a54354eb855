"""Ranked lexical search, term at a time, with limited accumulators.

Documents are read once: a forward table keeps of each its length and the terms that
the items may ask for (a bitmap of fixed size lets the others go). Term statistics,
with the largest share that any document gets from a term, come from that table.

Every item's terms are taken rarest first, in waves of growing postings. A wave makes
accumulators for the documents of its terms, unless what they got plus the bounds of
all terms still to come stays below the item's k-th score. Those made are updated by
all their terms exactly. Once the bounds of the terms to come cannot reach the k-th
score any more, the item makes no accumulators. Only k rows an item are kept between
waves: any other document has a final score that is lower.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.session import write_once

from .work import BITS, bitmap, folder, in_bitmap

#: Rows per item in the result.
TOP = 20
#: Postings of an item's first wave, and how many times more every next one has. They change no result.
FIRST, GROWTH = 1000, 8
#: The bytes of terms (A-Z as a-z), all others as blanks; what is outside ASCII belongs to terms.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Texts of so many bytes go into one batch of the forward table.
BATCH_BYTES = 4 << 20
FORWARD = "row long, doc_id %s, n long, terms array<struct<term: string, tf: long>>"
_TERM = pa.struct([("term", pa.string()), ("tf", pa.int64())])


def terms(text):
    """The terms of a UTF-8 text, with repeats."""
    return text.translate(TABLE).split()


def _forward(bits):
    """Length and wanted terms of every text; ``bits`` (broadcast) has the wanted terms, or is None for all."""
    def run(batches):
        wanted = None if bits is None else np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").tobytes()
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
            begin = size = 0
            ns, offsets, words, tfs = [], [0], [], []
            for r, text in enumerate(texts):
                text = text.as_py()
                all_terms = terms(text)
                ns.append(len(all_terms))
                for term, tf in Counter(all_terms).items():
                    if wanted is None or wanted[zlib.crc32(term) & (BITS - 1)]:
                        words.append(term)
                        tfs.append(tf)
                offsets.append(len(words))
                size += len(text)
                if size > BATCH_BYTES or r == batch.num_rows - 1:
                    part = batch.slice(begin, r + 1 - begin)
                    pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], fields=list(_TERM))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
                        ["row", "doc_id", "n", "terms"])
                    begin, size = r + 1, 0
                    ns, offsets, words, tfs = [], [0], [], []
    return run


def forward(docs, bits=None, id_col="doc_id", text_col="text"):
    """``row, doc_id, n, terms`` of every row; ``row`` numbers the rows."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_forward(bits), FORWARD % dict(src.dtypes)["doc_id"])


def item_terms(items, id_col="item_id", text_col="text"):
    """``item_id, term, q``: the distinct terms of every item and how often each occurs."""
    rows = forward(items.filter(F.col(id_col).isNotNull()), None, id_col, text_col)
    return (rows.select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("t"))
            .groupBy("item_id", F.col("t.term").alias("term")).agg(F.sum("t.tf").alias("q")))


def _share(n_docs, n_terms):
    """What one posting gives per unit of weight."""
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {n_terms}L")
    return F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)"), m


def _plan(wanted, fwd, share, n_docs, k):
    """``item_id, term, gain, wave, rest``: rarest terms first, in waves; ``rest`` bounds what the waves after it can add."""
    stats = (_postings(fwd, share).groupBy("term").agg(F.count("*").alias("df"), F.max("share").alias("most")))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    gains = wanted.join(stats, "term").withColumn("gain", F.col("q") * weight).filter("gain > 0")
    order = Window.partitionBy("item_id").orderBy("df", "term")
    gains = gains.withColumn("met", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = max(FIRST, k)
    wave = F.when(F.col("met") <= first, 0).otherwise(F.ceil(F.log(F.col("met") / first) / F.log(F.lit(float(GROWTH))))).cast("int")
    later = Window.partitionBy("item_id").orderBy("wave").rangeBetween(1, Window.unboundedFollowing)
    bound = F.sum(F.col("gain") * F.col("most"))
    return gains.withColumn("wave", wave).withColumn("rest", F.coalesce(bound.over(later), F.lit(0))).select(
        "item_id", "term", "gain", "most", "wave", "rest")


def _postings(fwd, share, bits=None):
    part, m = share
    rows = fwd.select("row", "n", F.explode("terms").alias("t")).select("row", F.col("t.term").alias("term"), F.col("t.tf").alias("tf"), "n")
    if bits is not None:
        rows = rows.filter(in_bitmap(bits, F.crc32(F.col("term").cast("binary"))))
    return rows.withColumn("m", m).select("row", "term", part.alias("share"))


def _best(scored, k):
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs, items, k=TOP, id_col="doc_id", text_col="text", item_id="item_id", item_text="text"):
    """``item_id, rank, doc_id, score``: the k documents with the highest scores above 0 of every item.

    * Equal scores go by ascending id, null ids last, then by place in the input; every
      row is a document, also one that repeats an id or a text.
    * A null or termless text is no document for the statistics and is never found.
      Items without id, or without a term that a document has, have no rows; rows that
      repeat an item's id are one item with all their terms. Other columns are ignored.
    * No documents or no items give no rows.
    """
    spark = docs.sparkSession
    kinds = dict(items.dtypes)[item_id], dict(docs.dtypes)[id_col]
    wanted = write_once(item_terms(items, item_id, item_text), folder(spark, "op11-items"))
    code = F.crc32(F.col("term").cast("binary"))
    longs = bitmap(wanted.select(code.alias("h")).distinct()).first()[0]
    bits = spark.sparkContext.broadcast(np.array(longs, "<i8").tobytes())
    fwd = write_once(forward(docs, bits, id_col, text_col), folder(spark, "op11-forward"))
    n_docs, n_terms = fwd.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = _share(n_docs, max(n_terms, 1))
    fwd = fwd.filter(F.size("terms") > 0)
    plan = write_once(_plan(wanted, fwd, share, n_docs, k), folder(spark, "op11-plan"))
    last = plan.agg(F.max("wave")).first()[0]
    best = spark.createDataFrame([], f"item_id {kinds[0]}, row long, doc_id {kinds[1]}, score long, rank int")
    # as many waves as the postings of one item have powers of GROWTH
    for wave in range(-1 if last is None else last + 1):
        floor = best.filter(F.col("rank") == k).select(F.col("item_id").alias("fi"), F.col("score").alias("floor"))
        now = plan.filter(F.col("wave") == wave)
        # what documents without any earlier term can reach: this wave's bounds and all later ones
        reach = now.groupBy("item_id").agg((F.sum(F.col("gain") * F.col("most")) + F.max("rest")).alias("reach"))
        open_ = (reach.join(floor, F.col("item_id") == F.col("fi"), "left").filter("floor is null or reach >= floor")
                 .select("item_id", F.coalesce("floor", F.lit(0)).alias("floor")))
        now = write_once(now.join(open_, "item_id"), folder(spark, "op11-wave"))
        if not now.limit(1).count():
            continue
        mark = bitmap(now.select(code.alias("h")).distinct()).scalar()
        made = (_postings(fwd, share, mark).join(now, "term").groupBy("item_id", "row")
                .agg(F.sum(F.col("gain") * F.col("share")).alias("part"), F.max("rest").alias("rest"), F.max("floor").alias("floor"))
                .filter("part + rest >= floor").select("item_id", "row"))
        made = write_once(made, folder(spark, "op11-made"))
        named = fwd.select("row", "doc_id", "n", "terms").join(made, "row")
        exact = (named.select("item_id", "row", "doc_id", "n", F.explode("terms").alias("t"))
                 .select("item_id", "row", "doc_id", "n", F.col("t.term").alias("term"), F.col("t.tf").alias("tf"))
                 .join(plan.select("item_id", "term", "gain"), ["item_id", "term"]).withColumn("m", share[1])
                 .groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("gain") * share[0]).alias("score")).filter("score > 0"))
        both = exact.unionByName(best.drop("rank")).distinct()
        best = write_once(_best(both, k), folder(spark, "op11-best"))
    return best.select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL)
  GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(q * CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id), corpus GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
