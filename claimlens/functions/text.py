"""Text helpers that stay inside the JVM (no UDFs)."""

import unicodedata
from functools import lru_cache

from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv
from claimlens.functions.codes import BLANKS, as_col

# Blocks whose letters may carry accents: Latin-1 to Latin Extended-B, Latin
# Extended Additional; combining marks are dropped.
_ACCENTED_BLOCKS = [(0x00C0, 0x0250), (0x1E00, 0x1F00)]
_COMBINING_MARKS = (0x0300, 0x0370)


@lru_cache(maxsize=1)
def _accent_table():
    """(accented, plain) strings for ``translate``, worked out from Unicode."""
    accented, plain = [], []
    for lo, hi in _ACCENTED_BLOCKS:
        for cp in range(lo, hi):
            ch = chr(cp)
            base = "".join(x for x in unicodedata.normalize("NFD", ch)
                           if unicodedata.category(x) != "Mn")
            if base != ch and len(base) == 1:
                accented.append(ch)
                plain.append(base)
    marks = [chr(cp) for cp in range(*_COMBINING_MARKS)]
    return "".join(accented + marks), "".join(plain)


def strip_accents(text):
    accented, plain = _accent_table()
    t = as_col(text)
    # one byte per character: plain ASCII, nothing to translate
    return F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(t, accented, plain))


def fold(text):
    """Lower case without accents."""
    return strip_accents(F.lower(as_col(text)))


def normalise_spaces(text):
    """``fold`` with runs of white space collapsed and the ends trimmed."""
    return F.trim(F.regexp_replace(fold(text), r"(?U)\s+", " "))


def contains_folded(text, needle):
    """Does the text contain the needle, ignoring case and accents?"""
    return F.contains(fold(text), fold(needle))


def tokens(text):
    """Search tokens: folded, only a-z and 0-9, at least two characters, no stopwords.

    Repeated tokens are kept, BM25 needs them.
    """
    return F.filter(
        F.split(fold(text), "[^a-z0-9]+"),
        lambda t: (F.length(t) >= fv.MIN_TOKEN_CHARS) & ~t.isin(fv.STOPWORDS_PT),
    )


def truncate(text, limit, mark=fv.TRUNCATION_MARK):
    t = as_col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(mark))).otherwise(t)


def drop_context_prefix(text):
    """Remove a leading ``[Manual ...]`` block and the blank line after it."""
    t = as_col(text)
    at = F.instr(t, fv.CONTEXT_END)
    cut = F.substr(t, at + F.lit(len(fv.CONTEXT_END)))
    return F.when(t.startswith(fv.CONTEXT_MARK) & (at > 1), cut).otherwise(t)


def first_line(text):
    return strip(F.element_at(F.split(as_col(text), "\n"), 1))


def strip(text):
    """Trim all white space (``trim`` without a set only removes blanks)."""
    return F.btrim(as_col(text), F.lit(BLANKS))


def page_number(value):
    return F.coalesce(as_col(value).try_cast("int"), F.lit(0))


def id_prefix(source, hash_of=None, hash_chars=6):
    """Slug of a source name plus ``hash_chars`` (32 at most) characters of an MD5: of the
    name, or of a more distinctive column such as the path, as different files may share
    a name. Six characters collide from some thousand like-named files on."""
    s = as_col(source)
    slug = F.regexp_replace(F.lower(s), "[^a-z0-9]", "_")
    return F.concat_ws("_", F.substring(slug, 1, 24), F.substring(F.md5(as_col(hash_of or s).cast("binary")), 1, hash_chars))


def verdict_line(analysis):
    """First line of an analysis that states a verdict, or ``?``."""
    hits = F.filter(
        F.split(as_col(analysis), "\n"),
        lambda l: F.contains(l, F.lit("Veredicto:")) | F.contains(F.upper(l), F.lit("CONFORME")),
    )
    return F.coalesce(strip(F.try_element_at(hits, F.lit(1))), F.lit("?"))


def section_sort_key(section):
    """Numeric path of a section number, so that 4.10 sorts after 4.9."""
    return F.transform(
        F.filter(F.split(as_col(section), r"\."), lambda p: p.rlike(r"^\d+$")),
        lambda p: p.cast("int"),
    )
