"""Citations in answers: extraction, verification, grounding flags."""

from functools import reduce

from pyspark.sql import functions as F, Window as W

from claimlens.functions import fixed_values as fv
from claimlens.functions.codes import as_col
from claimlens.functions.text import contains_folded, first_line, fold, truncate
from claimlens.operators.catalog import first_by_key, top_n
from claimlens.operators.sections import count_of
from claimlens.session import shared_dir, write_once

SUMMARY_CHARS = 500
#: Chunks of a section that one task reads at once when a passage is looked for over their borders.
RANGE_CHUNKS = 4096


def _matches(text, pattern, order, has_page):
    """Matches of one pattern as ``array<struct<secao,pagina,padrao,texto_original>>``."""
    groups = {"secao": 1, "original": 0, **({"pagina": 2} if has_page else {})}
    spans = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()])
    no_page = F.lit(None).cast("int")
    return F.transform(spans, lambda z: F.struct(
        z["secao"].alias("secao"), (z["pagina"].try_cast("int") if has_page else no_page).alias("pagina"),
        F.lit(order).alias("padrao"), z["original"].alias("texto_original")))


def extract_citations(answers, key="answer_id", text="texto", every_pattern=False):
    """One row per cited (section, page), NULL page where none is given.

    A citation with a page also contains the plain form without it. By default the
    plain row of such a span is left out; ``every_pattern`` keeps it.
    """
    rest, found = as_col(text), []
    for order, pattern in enumerate(fv.CITATION_PATTERNS):
        has_page = order < 2
        found.append(_matches(rest, "(?Uiu)" + pattern, order, has_page))
        if has_page and not every_pattern:
            rest = F.regexp_replace(rest, F.lit("(?Uiu)" + pattern), F.lit(" "))
    rows = answers.select(key, F.explode(F.concat(*found)).alias("c")).select(key, "c.*")
    one = rows.groupBy(key, "secao", "pagina").agg(F.min(F.struct("padrao", "texto_original")).alias("_m"))
    return one.select(key, "secao", "pagina", F.col("_m.texto_original").alias("texto_original"))


def section_index(chunks):
    """One row per section: title and page of its first chunk, by id."""
    return first_by_key(chunks.select("secao", "id", "titulo", "pagina", "fonte"), "secao", ["id"])


def verify_citations(citations, chunks):
    """Does the cited section exist, and is the page right?

    The page is compared with the section's first chunk; ``alguma_pagina`` tells
    whether any chunk of the section has it.
    """
    idx = section_index(chunks).select("secao", first_line("titulo").alias("titulo"),
                                       F.col("pagina").cast("int").alias("pagina_real"))
    pages = chunks.select("secao", F.col("pagina").cast("int").alias("pagina")).distinct().withColumn(
        "alguma_pagina", F.lit(True))
    real, cited = F.col("pagina_real"), F.col("pagina")
    out = citations.join(idx, "secao", "left").join(pages, ["secao", "pagina"], "left")
    exists = F.col("titulo").isNotNull()
    return out.withColumn("existe", exists).withColumn(
        "pagina_confere", F.when(exists, cited.isNull() | real.isNull() | (cited == real))).withColumn(
        "alguma_pagina", F.when(exists, cited.isNull() | F.coalesce("alguma_pagina", F.lit(False))))


def section_summaries(chunks, chars=SUMMARY_CHARS, text="contexto"):
    """Per section: chunk count, head of the joined texts, data of the first chunk.

    The head needs at most ``chars`` characters, hence at most that many chunks;
    only those are brought together.
    """
    count = chunks.groupBy("secao").agg(F.count("*").alias("n_trechos"))
    lead = top_n(chunks.select("secao", "id", F.substring(text, 1, chars + 1).alias("t")), "secao", ["id"], chars + 1)
    joined = lead.groupBy("secao").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("posicao", "t"))), lambda x: x["t"]), "\n").alias("t"))
    head = section_index(chunks).select("secao", first_line("titulo").alias("titulo"), "pagina", "fonte")
    return head.join(count, "secao").join(joined.select("secao", truncate("t", chars).alias("resumo")), "secao")


def verify_sections(requests, chunks, text="contexto"):
    """Check requested sections; ``trecho`` (optional text) is looked for in the section.

    Case and accents are ignored. The texts of a section count as joined by line
    breaks: a passage without a line break lies within one chunk, so chunks are
    tested one by one and never gathered.
    """
    s = section_summaries(chunks, text=text)
    out = requests.join(s, "secao", "left").withColumn("encontrada", F.col("n_trechos").isNotNull())
    asked = requests.where(F.coalesce("trecho", F.lit("")) != "").select("secao", "trecho").distinct()
    hits = asked.join(chunks.select("secao", text), "secao").where(contains_folded(text, "trecho"))
    found = hits.select("secao", "trecho").distinct().unionByName(
        _across_chunks(asked, chunks, text)).distinct().withColumn("_ok", F.lit(True))
    return out.join(found, ["secao", "trecho"], "left").withColumn(
        "texto_encontrado", F.when(F.coalesce("trecho", F.lit("")) != "", F.coalesce("_ok", F.lit(False)))).drop("_ok")


def _across_chunks(asked, chunks, text, range_chunks=RANGE_CHUNKS):
    """Passages with line breaks may run over chunk borders.

    Every border uses up one line break of the passage, so a passage with m of
    them reaches at most m chunks further; m is read from the requests. Heads and
    tails of the longest passage's length are compared, not whole texts, and only
    for the requested sections. A section's chunks are cut into ranges, each with
    the first chunks of the next one, so a long section is read by many tasks.
    """
    multi = asked.where(F.contains("trecho", F.lit("\n"))).withColumn("f", fold("trecho"))
    reach, longest = multi.agg(F.max(count_of("f", "\n")).cast("int"), F.max(F.length("f"))).first()
    if not reach:
        return asked.limit(0)
    t = fold(text)
    edges = chunks.join(multi.select("secao").distinct(), "secao", "left_semi").select(
        "secao", "id", F.left(t, F.lit(longest)).alias("head"), F.right(t, F.lit(longest)).alias("tail"))
    rows = _in_ranges(edges, "secao", "id", max(range_chunks, reach), reach).join(multi, "secao")
    size = F.length("f")
    w = W.partitionBy("secao", "trecho", "_range").orderBy("_place").rowsBetween(1, reach)
    joined = F.concat_ws("\n", F.right(F.col("tail"), size), F.array_join(F.collect_list(F.left(F.col("head"), size)).over(w), "\n"))
    window = F.left(joined, F.least(F.length("tail"), size) + size)
    return rows.withColumn("j", window).where(F.contains("j", F.col("f"))).select("secao", "trecho")


def _in_ranges(rows, key, order, length, halo):
    """Rows with their place in the key's order and a range of ``length`` places.

    The first ``halo`` rows of a range are also rows of the range before. Places come
    from one exchange by range and the counts of its parts; no task holds a key's rows.
    """
    placed = write_once(rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()),
                        shared_dir(rows.sparkSession, "ranges"))
    before = F.sum("n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    first = placed.groupBy(key, "_part").agg(F.count("*").alias("n")).select(
        key, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy(key, "_part").orderBy(order)) - 1
    out = placed.withColumn("_place", place).join(first, [key, "_part"]).withColumn("_place", F.col("_place") + F.col("_before"))
    own = F.floor(F.col("_place") / length)
    early = (own > 0) & (F.col("_place") % length < halo)
    return out.withColumn("_range", F.explode(F.when(early, F.array(own - 1, own)).otherwise(F.array(own)))).drop("_part", "_before")


def grounding(labels, key="answer_id"):
    """Tallies of labelled statements per answer, and the share that is supported."""
    n = lambda k: F.count_if(F.col("classificacao") == k)
    g = labels.groupBy(key).agg(F.count("*").alias("n_total"), n(fv.SUPPORTED).alias("n_fundamentado"),
                                n(fv.INFERRED).alias("n_inferencia"), n(fv.UNSUPPORTED).alias("n_sem_fonte"))
    return g


def answer_flags(answers, verified, tallies, key="answer_id", score="score_geral"):
    """Problem flag per answer: a cited section is missing, the grounding score is
    known and below one half, or too many statements are unsupported."""
    missing = verified.groupBy(key).agg(F.count("*").alias("n_citacoes"), F.count_if(~F.col("existe")).alias("n_inexistentes"))
    df = answers.select(key, score).join(missing, key, "left").join(tallies, key, "left")
    low = (F.col(score) >= 0) & (F.col(score) < fv.MIN_GROUNDING_SCORE)
    tests = [F.col("n_inexistentes") > 0, low,
             F.col("n_sem_fonte") / F.col("n_total") > fv.MAX_UNSUPPORTED_SHARE]
    flag = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return df.select(key, zero("n_citacoes"), zero("n_inexistentes"), zero("n_total"), zero("n_sem_fonte"),
                     flag.alias("tem_problemas"))
