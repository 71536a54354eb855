"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Every rule is "metric above cutoff: reject". Per stratum (the document's language
tag) and metric, cutoffs are tested on labelled good documents from lenient to
strict. A cutoff is certified if the exact binomial tail says that, were its false
rejection rate above the metric's share of ALPHA, so few rejections would have been
seen with a chance of DELTA / (strata * metrics) at most - the Clopper-Pearson
bound, corrected over strata and metrics; along the cutoffs a fixed order of tests
that stops at the first failure needs no further correction. The strictest
certified cutoff holds; without one the rule does not apply in that stratum.
"""

from pyspark.sql import functions as F

from claimlens.session import write_once

from .work import folder

#: Allowed false rejections of good documents per stratum, and the chance that this fails.
ALPHA, DELTA = 0.05, 0.05
#: Cutoffs of each metric from lenient to strict.
CUTOFFS = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02],
    "repeat_share": [0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "long_words": [30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0],
    "short_words": [-1.1, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0],
}
SPACES = r"[\x20\x09-\x0D]+"


def base_statistics(docs, id_col="doc_id", text_col="text", lang_col="lang"):
    """``doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    Repeated windows are found inside the row: window hashes in order, equal
    neighbours, then the covered words - never quadratic, and only for texts in
    which the number of distinct windows differs from the number of windows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    w = F.filter(F.split("text", SPACES), lambda x: x != "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    a = src.select("doc_id", "lang", w.alias("w"), lines.alias("lines"),
                   F.char_length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
                   (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"))
    hashes = F.when(F.size("w") >= 5, F.transform(
        F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(5)])))
    b = a.select("doc_id", "lang", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("h"))
    ordered = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = F.array_sort(F.transform(F.filter(ordered_col := F.col("o"), lambda x, i: (
        (F.get(ordered_col, i - 1)["h"] == x["h"]) & (i > 0)) | F.coalesce(F.get(ordered_col, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
    c = b.withColumn("o", F.when(F.size("h") > F.size(F.array_distinct("h")), ordered)).withColumn("p", twice)
    covered = F.aggregate(F.transform(F.col("p"), lambda p, i: F.least(
        F.lit(5), F.coalesce(F.get(F.col("p"), i + 1) - p, F.lit(5)))), F.lit(0), lambda s, x: s + x)
    return c.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _metrics(df):
    n, c = F.col("n_words"), F.col("word_chars")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    mean = F.when(n > 0, c / n)
    return (df.withColumn("symbol_share", share("n_symbols", "word_chars")).withColumn("dup_line_share", share("n_dup_lines", "n_lines"))
            .withColumn("repeat_share", share("n_repeat_words", "n_words"))
            .withColumn("long_words", F.coalesce(mean, F.lit(5.0))).withColumn("short_words", -F.coalesce(mean, F.lit(5.0))))


def thresholds(stats, labels, id_col="doc_id", label_col="quality", alpha=ALPHA, delta=DELTA, cutoffs=None):
    """One row per stratum with a cutoff (or null) per metric; ``stats`` with metrics.

    Labels that contradict each other count as not good; labels of unknown documents
    and null labels are ignored.
    """
    cutoffs = cutoffs or CUTOFFS
    good = (labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
            .agg(F.min(label_col).alias("q")).filter("q = 1").select("doc_id"))
    # only what the base rules keep can be rejected by the method
    held = stats.filter("not base_failed").join(good, "doc_id", "left_semi")
    names = list(cutoffs)
    counted = held.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[F.array(*[F.sum((F.col(m) > c).cast("long")) for c in cutoffs[m]]).alias(m) for m in names])
    total = counted.select("stratum").groupBy().agg(F.count("*").alias("s")).scalar()
    a = alpha / len(names)
    level = F.lit(delta) / (F.lit(len(names)) * total)
    out = counted.withColumn("level", level)
    for m in names:
        # P(Bin(n, a) <= k) by the recurrence of its terms
        tail = lambda k: F.when(k <= F.col("n") * a, F.aggregate(
            F.sequence(F.lit(0).cast("long"), k),
            F.struct((F.col("n") * F.log(F.lit(1 - a))).alias("t"), F.lit(0.0).alias("s")),
            lambda acc, i: F.struct(
                (acc["t"] + F.log(F.greatest(F.col("n") - i, F.lit(1)).cast("double")) - F.log((i + 1).cast("double")) + F.log(F.lit(a / (1 - a)))).alias("t"),
                (acc["s"] + F.exp(acc["t"])).alias("s")), lambda acc: acc["s"])).otherwise(F.lit(1.0))
        passed = F.transform(F.col(m), lambda k: tail(k) <= F.col("level"))
        first_fail = F.array_position(passed, False)
        count = F.when(first_fail == 0, F.size(passed)).otherwise((first_fail - 1).cast("int"))
        out = out.withColumn(f"cut_{m}", F.when(count > 0, F.get(F.array(*[F.lit(c) for c in cutoffs[m]]), count - 1)))
    return out.select("stratum", *[f"cut_{m}" for m in names])


def quality_verdicts(docs, labels, id_col="doc_id", text_col="text", lang_col="lang", label_id="doc_id", label_col="quality"):
    """``doc_id``, base statistics, ``base_failed``, ``kept`` and the stratum of every row.

    A null text has no words and fails the base rule. Rows that repeat an id are
    judged each for itself; a row without language is in stratum ``und``; without
    (enough) labels only the base rules apply. An empty table gives an empty frame.
    """
    spark = docs.sparkSession
    stats = write_once(base_statistics(docs, id_col, text_col, lang_col), folder(spark, "op5-stats"))
    stats = _metrics(stats.withColumn("stratum", F.coalesce("lang", F.lit("und")))
                     .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    cuts = write_once(thresholds(stats, labels, label_id, label_col), folder(spark, "op5-cuts"))
    above = F.lit(False)
    for m in CUTOFFS:
        above = above | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    return stats.join(cuts, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~above).alias("kept"), "stratum")


def _sql():
    cases, cut_cols, above = [], [], []
    a = ALPHA / len(CUTOFFS)
    for m, cs in CUTOFFS.items():
        for i, c in enumerate(cs):
            cases.append(f"SELECT stratum, '{m}' AS m, {i} AS i, {c!r}::DOUBLE AS c, count(*) AS n, count(*) FILTER (WHERE {m} > {c!r}) AS k FROM held GROUP BY stratum")
        cut_cols.append(f"max(CASE WHEN m = '{m}' THEN cut END) AS cut_{m}")
        above.append(f"coalesce({m} > cut_{m}, false)")
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
spots AS (SELECT doc_id, s, array_to_string(w[s:s + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS s FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, s FROM spots QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + 4)) AS p FROM twice) GROUP BY doc_id),
st AS (
  SELECT doc_id, coalesce(lang, 'und') AS stratum, cast(len(w) AS BIGINT) AS n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(lines) AS n_lines, cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    cast(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
m AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 5 END AS long_words,
    CASE WHEN n_words > 0 THEN -(word_chars / n_words) ELSE -5 END AS short_words FROM st),
held AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN
  (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
counts AS ({" UNION ALL ".join(cases)}),
tested AS (
  SELECT stratum, m, i, c, k <= n * {a!r} AND (SELECT sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({a!r}) + (n - j) * ln({1 - a!r})))
    FROM (SELECT unnest(generate_series(0, k)) AS j)) <= {DELTA!r} / ({len(CUTOFFS)} * (SELECT count(DISTINCT stratum) FROM held)) AS ok FROM counts),
cuts AS (
  SELECT stratum, m, arg_max(c, i) FILTER (WHERE i < bad) AS cut
  FROM (SELECT *, coalesce(min(i) FILTER (WHERE NOT ok) OVER (PARTITION BY stratum, m), 1000) AS bad FROM tested) GROUP BY stratum, m),
wide AS (SELECT stratum, {", ".join(cut_cols)} FROM cuts GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(above)}) AS kept, stratum
FROM m LEFT JOIN wide USING (stratum)
"""


SQL = _sql()
