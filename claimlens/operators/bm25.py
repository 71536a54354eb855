"""BM25: a stored, segmented index and batch search with score bounds.

Sources are dealt into segments by a hash, each a folder of its own. ``docs`` holds every
document's term counts (texts are tokenised once); ``lists`` cuts a segment's documents into
blocks of bounded size and holds one posting list per block and term, with what bounds any
score in it: the largest frequency and the shortest document. Statistics add up over lists,
so replacing sources rewrites their segments only and tokenises new texts only.

A search bounds what every block can give a question. The most promising block of each
question is scored first; its k-th score then rules out all blocks whose bound is lower.
Within a block scores are exact, and only the k best per question leave it: a term that
a third of all documents hold costs its lists, not a row for every hit.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv
from claimlens.functions.arrays import at, indexes, let
from claimlens.functions.text import tokens
from claimlens.operators.blocks import scan_blocks
from claimlens.operators.catalog import top_n
from claimlens.operators.vector import _row_topk
from claimlens.session import shared_dir, write_once

#: Segments of an index, documents per block, questions that one task takes through a block.
SEGMENTS, BLOCK_DOCS, SLICE = 16, 2048, 50000
#: Scores are rounded; bounds have to reach a little less.
_SLACK = 1e-6
#: Cells and list entries that a task works on at once.
_STEP = 1_000_000


def term_counts(toks):
    """``array<struct<term,tf>>`` of a token array: sort, then measure the runs."""
    def runs(s):
        starts = F.filter(indexes(s), lambda i: (i == 0) | (at(s, i) != at(s, F.greatest(i - 1, F.lit(0)))))
        return let(starts, lambda b: F.transform(b, lambda i, k: F.struct(
            at(s, i).alias("term"), (F.coalesce(at(b, k + 1), F.size(s)) - i).alias("tf"))))
    return let(F.sort_array(toks), runs)


def _children(chunks):
    """Parents (``is_parent``, where the column exists) are context for their children and are not indexed."""
    return chunks.filter(~F.coalesce("is_parent", F.lit(False))) if "is_parent" in chunks.columns else chunks


def _counted(chunks, text, meta):
    docs = _children(chunks).select("id", *meta, tokens(text).alias("toks"))
    return docs.select("id", *meta, F.size("toks").alias("dl"), term_counts(F.col("toks")).alias("terms"))


def _exploded(docs, meta):
    return docs.select("id", *meta, "dl", F.explode("terms").alias("t")).select(
        F.col("t.term").alias("term"), "id", F.col("t.tf").alias("tf"), "dl", *meta)


def postings(chunks, text="contexto", meta=()):
    """(term, id, tf, dl, metadata) of all chunks that are no parents."""
    return _exploded(_counted(chunks, text, list(meta)), list(meta))


# --- index ------------------------------------------------------------------------------
def _docs(chunks, text, meta, source, segments):
    """Counted documents with their source and segment; without a source the id stands for it."""
    meta = list(meta)
    src = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.col("id").cast("string")
    named = _children(chunks).withColumn("_src", src)
    return _counted(named, text, [*meta, "_src"]).withColumn("segment", F.pmod(F.xxhash64("_src"), F.lit(segments)).cast("int"))


def _lists(docs, meta, block_docs):
    """One row per (segment, block, term); a list has as many entries as a block has documents at most.

    A source stays together, as its documents share words: it goes to one block of its
    segment, or in parts of ``block_docs`` documents to several.
    """
    sizes = F.broadcast(docs.groupBy("segment").agg(F.ceil(F.count("*") / block_docs).alias("blocks")))  # a row per segment
    # written, so that Spark knows its size: with few sources the documents need no exchange to meet it
    parts = write_once(docs.groupBy("segment", "_src").agg(F.ceil(F.count("*") / block_docs).alias("parts")),
                       shared_dir(docs.sparkSession, "bm25-parts"))
    placed = docs.join(sizes, "segment").join(parts, ["segment", "_src"]).withColumn(
        "block", F.pmod(F.xxhash64("_src", F.pmod(F.xxhash64("id"), F.col("parts"))), F.col("blocks")).cast("int"))
    # documents are shuffled whole, before they become a row per term: the grouping by block needs no other exchange
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = placed.select("segment", "block", "id", *meta, "dl", "terms").repartition(n, "segment", "block")
    rows = whole.select("segment", "block", "id", *meta, "dl", F.explode("terms").alias("t"))
    return rows.groupBy("segment", "block", F.col("t.term").alias("term")).agg(
        F.count("*").alias("df"), F.sum("t.tf").alias("cf"), F.max("t.tf").alias("tf_most"), F.min("dl").alias("dl_least"),
        F.collect_list(F.struct("id", F.col("t.tf").alias("tf"), "dl", *meta)).alias("entries"))


def _statistics(index, folder):
    """Term and corpus statistics: sums over the lists of all segments."""
    terms = write_once(index["lists"].groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), f"{folder}/terms")
    # documents without any token count too
    n = index["docs"].agg(F.count("*")).scalar()
    corpus = terms.agg(
        F.max(n).alias("n_docs"), (F.sum("cf") / F.max(n)).alias("avgdl"),
        (F.avg(_raw_idf(n)) * fv.BM25_NEGATIVE_IDF_SHARE).alias("idf_floor"))
    return {**index, "terms": terms, "corpus": write_once(corpus, f"{folder}/corpus")}


def build_index(chunks, text="contexto", meta=(), folder=None, source=None, segments=SEGMENTS, block_docs=BLOCK_DOCS):
    """Writes the index below ``folder`` (default: a new one in the shared folder) and returns its tables.

    ``source`` names the column by which documents are replaced later on.
    """
    folder, meta = folder or shared_dir(chunks.sparkSession, "bm25"), list(meta)
    docs = write_once(_docs(chunks, text, meta, source, segments), f"{folder}/docs", ["segment"])
    lists = write_once(_lists(docs, meta, block_docs), f"{folder}/lists", ["segment"])
    return _statistics({"docs": docs, "lists": lists}, folder)


def read_index(spark, folder):
    return {t: spark.read.parquet(f"{folder}/{t}") for t in ("docs", "lists", "terms", "corpus")}


def replace_sources(chunks, folder, text="contexto", meta=(), source="fonte", segments=SEGMENTS, block_docs=BLOCK_DOCS):
    """Replaces all documents of the sources in ``chunks`` in the index at ``folder``.

    Only the segments of these sources are rewritten, and only the texts of ``chunks`` are
    tokenised: other documents keep their counts. Segments are prepared aside and then
    overwritten as whole folders, so a repeated call gives the same index.
    """
    spark, meta = chunks.sparkSession, list(meta)
    aside = shared_dir(spark, "bm25-segments")
    new = write_once(_docs(chunks, text, meta, source, segments), f"{aside}/new")
    old = spark.read.parquet(f"{folder}/docs")
    touched = F.broadcast(new.select("segment").distinct())  # a row per segment
    kept = old.join(touched, "segment", "left_semi").join(new.select("_src").distinct(), "_src", "left_anti")
    docs = write_once(kept.unionByName(new), f"{aside}/docs")
    lists = write_once(_lists(docs, meta, block_docs), f"{aside}/lists")
    for table, df in (("docs", docs), ("lists", lists)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{folder}/{table}")
    # statistics are sums over all lists: written anew
    fresh = {t: spark.read.parquet(f"{folder}/{t}") for t in ("docs", "lists")}
    return _statistics(fresh, folder)


def _raw_idf(n):
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def term_idf(index):
    """(term, df, idf); a negative idf is replaced by a share of the mean over all terms."""
    c = index["corpus"].select(F.struct("n_docs", "idf_floor")).scalar()
    raw = index["terms"].select("term", "df", _raw_idf(c["n_docs"]).alias("raw"))
    return raw.select("term", "df", F.when(F.col("raw") < 0, c["idf_floor"]).otherwise(F.col("raw")).alias("idf"))


# --- filters ----------------------------------------------------------------------------
def match_filter(where):
    """Predicate for a metadata filter: ``{col: value}``, ``{"$and": [..]}`` or None.

    Values are compared as text; a missing value counts as empty.
    """
    if not where:
        return F.lit(True)
    if "$and" in where:
        return reduce(lambda a, b: a & b, [match_filter(w) for w in where["$and"]])
    return reduce(lambda a, b: a & b, [
        F.coalesce(F.col(k).cast("string"), F.lit("")) == str(v) for k, v in where.items()])


def _equalities(where):
    """The (column, text) pairs that a filter asks for."""
    if not where:
        return []
    if "$and" in where:
        return [pair for w in where["$and"] for pair in _equalities(w)]
    return [(k, str(v)) for k, v in where.items()]


# --- search -----------------------------------------------------------------------------
def _weights(questions, index, keys, text, filters):
    """(keys, filters, term, w): each question's terms with frequency times idf."""
    fcols = [f"f_{c}" for c in filters]
    asked = questions.select(*keys, *fcols, F.explode(tokens(text)).alias("term")).groupBy(*keys, *fcols, "term").agg(F.count("*").alias("q"))
    return asked.join(term_idf(index).select("term", "idf"), "term").select(*keys, *fcols, "term", (F.col("q") * F.col("idf")).alias("w"))


def _gain(tf, dl, avgdl):
    k1, b = fv.BM25_K1, fv.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def score(questions, index, keys=("query_id",), text="pergunta", digits=9):
    """Positive scores of all matching (question, document) pairs, without any cut."""
    avgdl = index["corpus"].select("avgdl").scalar()
    hits = _exploded(index["docs"], []).join(_weights(questions, index, list(keys), text, ()), "term")
    return hits.groupBy(*keys, "id").agg(F.round(F.sum(F.col("w") * _gain(F.col("tf"), F.col("dl"), avgdl)), digits).alias("score")).where("score > 0")


def _texts(column):
    return np.array([x or "" for x in column.cast(pa.string()).to_pylist()], object)


def _block_scores(keys, filters, fixed, avgdl, n, digits):
    """The scorer of ``scan_blocks``: the n best documents of a block for every question."""
    def block(parts):
        table = pa.Table.from_batches(parts).select(["term", "entries"])
        entries = table.column("entries").combine_chunks()
        size = pc.list_value_length(entries).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        where = {t: k for k, t in enumerate(table.column("term").to_pylist())}
        flat = entries.flatten()
        coded = flat.field("id").dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        ids = coded.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = rank[coded.indices.to_numpy(zero_copy_only=False)]
        gain = _gain(flat.field("tf").to_numpy(zero_copy_only=False).astype("float64"), flat.field("dl").to_numpy(zero_copy_only=False), avgdl)
        _, one = np.unique(doc, return_index=True)
        meta = {c: _texts(flat.field(c).take(pa.array(one))) for c in {*filters, *[c for c, _ in fixed]}}
        base = np.ones(len(ids), bool)
        for c, want in fixed:
            base &= meta[c] == want

        def ask(batch):
            terms = batch.column("terms")
            per = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            parts_ = terms.flatten()
            asked = np.array([where.get(t, -1) for t in parts_.field("term").to_pylist()], np.int64)
            weight, owner = parts_.field("w").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(per)), per)
            ok = asked >= 0
            asked, weight, owner = asked[ok], weight[ok], owner[ok]
            wants = [batch.column(f"f_{c}").to_pylist() for c in filters]
            rows, hits, got = [], [], []
            step = max(1, _STEP // len(ids))
            # list entries that the questions before each one bring
            before = np.concatenate(([0], np.cumsum(np.bincount(owner, size[asked], len(per)).astype(np.int64))))
            hi = 0
            while hi < len(per):
                # neither documents times questions nor list entries above _STEP, but one question at least
                lo = hi
                hi = min(len(per), lo + step, max(lo + 1, int(np.searchsorted(before, before[lo] + _STEP, side="right")) - 1))
                mine = slice(*np.searchsorted(owner, [lo, hi]))
                k, length = asked[mine], size[asked[mine]]
                spot = np.arange(length.sum()) + np.repeat(ends[k] - np.cumsum(length), length)
                cell = np.repeat(owner[mine] - lo, length) * len(ids) + doc[spot]
                s = np.bincount(cell, np.repeat(weight[mine], length) * gain[spot], (hi - lo) * len(ids)).reshape(hi - lo, -1)
                s = np.where(base[None, :], np.round(s, digits), 0.0)
                for c, values in zip(filters, wants, strict=True):
                    for i in range(lo, hi):
                        if values[i] is not None:
                            s[i - lo][meta[c] != values[i]] = 0.0
                r, c = _row_topk(s, n)
                plus = s[r, c] > 0
                rows.append(r[plus] + lo)
                hits.append(c[plus])
                got.append(s[r, c][plus])
            if not rows:
                return None
            at_ = pa.array(np.concatenate(rows))
            return pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at_) for c in keys], ids.take(pa.array(np.concatenate(hits))), pa.array(np.concatenate(got))],
                [*keys, "id", "score"])
        return ask
    return block


def search(questions, index, n=fv.CANDIDATES_PER_RETRIEVER, keys=("query_id",), text="pergunta",
           filters=(), where=None, digits=9, slice_rows=SLICE):
    """Best n documents per question: (keys, id, score, posicao).

    ``f_x`` of a question is NULL (any) or what metadata column ``x`` has to be, as text;
    filters come before the cut and leave the statistics as they are. Scores are rounded so
    that the order of summation cannot change the ranking; ties go to the smaller id.
    """
    spark, keys, filters = questions.sparkSession, list(keys), list(filters)
    fcols, folder = [f"f_{c}" for c in filters], shared_dir(spark, "bm25-search")
    asked = write_once(_weights(questions, index, keys, text, filters), f"{folder}/asked")
    q = write_once(asked.groupBy(*keys, *fcols).agg(F.collect_list(F.struct("term", "w")).alias("terms")), f"{folder}/questions")
    avgdl = index["corpus"].first()["avgdl"] or 1.0
    lists = index["lists"]
    most = F.greatest(F.col("w") * _gain(F.col("tf_most"), F.col("dl_least"), F.lit(avgdl)), F.lit(0.0))
    bounds = write_once(lists.select("segment", "block", "term", "tf_most", "dl_least").join(asked, "term")
                        .groupBy(*keys, "segment", "block").agg(F.sum(most).alias("bound")), f"{folder}/bounds")
    slices = max(1, math.ceil(q.count() / slice_rows))
    kinds = {**dict(q.dtypes), "id": lists.schema["entries"].dataType.elementType["id"].dataType.simpleString()}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"id {kinds['id']}", "score double"])
    wanted = lists.select("segment", "block", "term", "entries").join(asked.select("term").distinct(), "term", "left_semi")

    def scored(pairs):
        """The n best of every (question, block) pair."""
        stored = (wanted.join(pairs.select("segment", "block").distinct(), ["segment", "block"], "left_semi")
                  .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))
        asks = pairs.select(*keys, "segment", "block").join(q, keys).withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int"))
        place = {"segment": "_cell", "block": "_block"}
        return scan_blocks(stored.withColumnsRenamed(place), asks.withColumnsRenamed(place),
                           _block_scores(keys, filters, _equalities(where), avgdl, n, digits), schema)

    first = bounds.groupBy(*keys).agg(F.max_by(F.struct("segment", "block"), F.struct("bound", "segment", "block")).alias("b")).select(*keys, "b.*")
    hits = write_once(scored(first), f"{folder}/first")
    floor = hits.groupBy(*keys).agg(F.count("*").alias("found"), F.min("score").alias("floor")).where(F.col("found") >= n).select(*keys, "floor")
    rest = (bounds.join(first, [*keys, "segment", "block"], "left_anti").join(floor, keys, "left")
            .where(F.col("bound") + _SLACK >= F.coalesce("floor", F.lit(0.0))))
    return top_n(hits.unionByName(scored(rest)), keys, [F.desc("score"), "id"], n)
