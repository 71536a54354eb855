"""A training-data pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
All but the last return the columns of documents; the last encodes.
"""

from claimlens.llm.queries import table
from claimlens.llm.work import folder
from claimlens.session import ship_package, write_once


def language_id(spark, docs, sf_dir):
    """Documents without a language (null text, or no letter) go; a null ``lang`` becomes the predicted one.

    Without any labelled text nothing can be learned: then texts with a letter stay as they are.
    Rows that repeat an id or have none are judged each for itself; an empty table stays empty.
    """
    from pyspark.sql import functions as F

    from claimlens.llm.language_id import fit, identify

    ship_package(spark)
    model = fit(docs)
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = identify(docs, keep=True, model=model).filter("lang_pred <> 'und'")
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of documents that link, the one with the smallest id stays.

    Rows without an id link with nothing and all stay. Rows that repeat an id are one
    document as far as links go: if its group keeps that id, all its rows stay.
    """
    from claimlens.llm.jaccard_join import ngram_components

    ship_package(spark)
    stay = ngram_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))


def decontaminate(spark, docs, sf_dir):
    """Documents that hold passages of the benchmark, by the contamination rule, go.

    Rows without an id are told apart by their text, on which alone the verdict depends.
    """
    from pyspark.sql import functions as F

    from claimlens.llm.decontam import contamination

    kind = "bigint" if dict(docs.dtypes)["doc_id"] == "bigint" else "string"
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast(kind), F.xxhash64("text").cast(kind)))
    bad = contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="_key").filter("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(bad, "_key", "left_anti").select(*docs.columns)


def secret_scan(spark, docs, sf_dir):
    """Secrets are blanked out of the texts; every document stays."""
    from claimlens.llm.secret_cnn import redact

    ship_package(spark)
    return redact(docs).select(*docs.columns)


def bpe_encode(spark, docs, sf_dir):
    """Token counts and digests of every text that is left."""
    from claimlens.llm.bpe_words import encode_digests

    ship_package(spark)
    return encode_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encode),
]

#: The model of secrets and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), folder(spark, f"pipeline-{name}"))
    return docs
