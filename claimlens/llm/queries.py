"""One query per operator, over whole tables."""

from . import decontam, filter_audit, histogram_shards, quality_rules, ranked_search


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_tree(spark, sf_dir):
    from .html_tree import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark, sf_dir):
    from .jaccard_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark, sf_dir):
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_bpe_words(spark, sf_dir):
    from .bpe_words import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"))


def op8_quality_network(spark, sf_dir):
    from .quality_net import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_spans(spark, sf_dir):
    from .token_spans import section_tokens

    return section_tokens(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    from .secret_cnn import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark, sf_dir):
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_histogram_shards(spark, sf_dir):
    return histogram_shards.histogram_shards(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_html_tree, op2_ngram_jaccard_join, op3_language_id, op4_benchmark_decontamination, op5_quality_rules, op6_suffix_dedup, op7_bpe_words,
    op8_quality_network, op9_token_spans, op10_secret_scan, op11_ranked_search, op12_filter_audit, op13_histogram_shards)}
SQL = {"op4_benchmark_decontamination": decontam.SQL, "op5_quality_rules": quality_rules.SQL, "op11_ranked_search": ranked_search.SQL,
       "op12_filter_audit": filter_audit.SQL, "op13_histogram_shards": histogram_shards.SQL}
