"""What a corpus holds: sources, counts, chunks of sections, rules by name."""

from pyspark.sql import functions as F

from claimlens.functions import text as T


def rules_named(rules, part=None):
    """Rules whose name contains ``part``, taken literally and in any case; all without it."""
    return rules if not part else rules.where(F.contains(F.lower("nome"), F.lower(F.lit(part))))


def chunks_of_sections(chunks, sections, max_chars=None):
    """Chunks of the wanted sections as they are shown: first title line, text without prefix.

    ``sections``: a frame with ``secao``; repeats do not multiply. ``max_chars`` cuts texts and
    marks the cut; whole texts without it.
    """
    hit = chunks.join(sections.select("secao"), "secao", "left_semi")
    text = T.drop_context_prefix("texto")
    return hit.select("secao", "id", T.first_line("titulo").alias("titulo"), "pagina", "fonte",
                      (T.truncate(text, max_chars) if max_chars else text).alias("texto"))


def sources(chunks):
    """Per source: chunks, and type and year of the one with the smallest id."""
    return chunks.groupBy("fonte").agg(F.count("*").alias("chunks"), F.min_by("tipo", "id").alias("tipo"), F.min_by("ano", "id").alias("ano"))


def counts_by(chunks, columns):
    """(por, valor, n): chunks per value of each column. The chunks are read once."""
    cells = F.array(*[F.struct(F.lit(c).alias("por"), F.col(c).cast("string").alias("valor")) for c in columns])
    return chunks.select(F.explode(cells).alias("x")).groupBy("x.por", "x.valor").agg(F.count("*").alias("n"))
