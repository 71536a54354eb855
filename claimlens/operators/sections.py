"""Section detection in page texts.

Input: one row per file with ``array<struct<pagina:int,texto:string>>``. A file
is read as a whole and is one row, so the running state (the open section) stays
inside the row: no shuffle, and a source with very many files is spread like any
other rows.
"""

from functools import reduce

from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv
from claimlens.functions.arrays import at, between, indexes, let
from claimlens.functions.codes import as_col
from claimlens.functions.text import strip

_NUMBER_LINE = rf"(?U)^{fv.SECTION_NUMBER}\s*\.?\s*$"
_TITLE_CLASS = rf"[{fv.UPPER_LETTERS}\s\-/,\(\)\.]"
_TITLE_LINE = rf"(?U)^[{fv.UPPER_LETTERS}]{_TITLE_CLASS}+$"
_HEAD = rf"(?Us)^({fv.SECTION_NUMBER})\s+([{fv.UPPER_LETTERS}]{_TITLE_CLASS}+)(.*)$"
_PAGE_NUMBER = r"^\d{1,3}$"


def count_of(text, needle):
    """Non-overlapping occurrences of a literal."""
    t = as_col(text)
    return (F.length(t) - F.length(F.replace(t, F.lit(needle)))) / len(needle)


def is_toc_page(text):
    return count_of(text, "...") > fv.TOC_DOTS_PER_PAGE


def _is_running_line(line):
    marks = [F.contains(line, F.lit(h)) for h in fv.RUNNING_HEADERS]
    return reduce(lambda a, b: a | b, marks) | line.rlike(rf"(?U)^\s*{fv.RUNNING_DATE_LINE}\s*$")


def clean_page(text):
    """Page text without running headers and page numbers; a number line followed by a
    title line becomes one line."""
    kept = F.filter(F.split(as_col(text), "\n"), lambda l: ~_is_running_line(l))

    def merge(lines):
        bare = F.transform(lines, strip)

        def line(b):
            is_num = lambda i: F.coalesce(at(b, i).rlike(_NUMBER_LINE), F.lit(False))
            is_title = lambda i: F.coalesce(at(b, i).rlike(_TITLE_LINE), F.lit(False))
            return F.array_compact(F.transform(lines, lambda l, i: (
                F.when((i > 0) & is_title(i) & is_num(F.greatest(i - 1, F.lit(0))), F.lit(None).cast("string"))
                .when(is_num(i) & is_title(i + 1), F.concat(F.rtrim(at(b, i), F.lit(".")), F.lit(" "), at(b, i + 1)))
                .when(at(b, i).rlike(_PAGE_NUMBER), F.lit(None).cast("string"))
                .otherwise(l))))
        return let(bare, line)

    return strip(F.array_join(let(kept, merge), "\n"))


def _segment(head, numero, titulo, pagina, texto):
    return F.struct(head.alias("head"), numero.alias("numero"), titulo.alias("titulo"),
                    pagina.alias("pagina"), texto.alias("texto"))


def _page_segments(page):
    """Text before the first heading, then one segment per heading."""
    none = F.lit(None).cast("string")

    def cut(lines):
        heads = F.filter(indexes(lines), lambda i: at(lines, i).rlike(_HEAD))

        def build(h):
            first = F.coalesce(at(h, F.lit(0)), F.size(lines))
            lead = strip(F.array_join(between(lines, F.lit(0), first), "\n"))
            before = F.when(lead != "", F.array(_segment(F.lit(False), none, none, page["pagina"], lead))).otherwise(
                F.array())
            own = F.transform(h, lambda i, k: let(at(lines, i), lambda l: _segment(
                F.lit(True), F.regexp_extract(l, _HEAD, 1),
                F.rtrim(strip(F.regexp_extract(l, _HEAD, 2)), F.lit(".")), page["pagina"],
                strip(F.array_join(F.concat(
                    F.array(F.regexp_extract(l, _HEAD, 3)),
                    between(lines, i + 1, F.coalesce(at(h, k + 1), F.size(lines)))), "\n")))))
            return F.concat(before, own)
        return let(heads, build)

    text = clean_page(page["texto"])
    return let(text, lambda t: F.when(t == "", F.array()).otherwise(let(F.split(t, "\n"), cut)))


def detect_sections(pages, preamble_after_page=fv.PREAMBLE_AFTER_PAGE):
    """``array<struct<numero,titulo,pagina_inicio,texto>>`` for an array of pages.

    Headings are matched line by line; the rest of a heading line belongs to the
    body. Sections without text are left out. Text before the first heading is
    kept (as section 0) only when it stands on the heading's page and that page
    lies beyond ``preamble_after_page``.
    """
    body_pages = F.filter(as_col(pages), lambda p: ~is_toc_page(p["texto"]))
    segments = F.flatten(F.transform(body_pages, _page_segments))

    def section(numero, titulo, pagina, texto):
        return F.struct(numero.alias("numero"), titulo.alias("titulo"),
                        pagina.alias("pagina_inicio"), texto.alias("texto"))

    def build(segs):
        heads = F.filter(indexes(segs), lambda i: at(segs, i)["head"])

        def assemble(h):
            rows = F.transform(h, lambda i, k: let(at(segs, i), lambda s: section(
                s["numero"], s["titulo"], s["pagina"],
                strip(F.array_join(F.filter(F.transform(
                    between(segs, i, F.coalesce(at(h, k + 1), F.size(segs))), lambda x: x["texto"]),
                    lambda t: t != ""), "\n")))))
            first = at(h, F.lit(0))
            lead = at(segs, F.greatest(first - 1, F.lit(0)))
            page = at(segs, first)["pagina"]
            has_lead = (first > 0) & (lead["pagina"] == page) & (page > preamble_after_page)
            preamble = F.when(has_lead, F.array(section(
                F.lit(fv.PREAMBLE_NUMBER), F.lit(fv.PREAMBLE_TITLE), page, lead["texto"]))).otherwise(F.array())
            return F.concat(preamble, F.filter(rows, lambda s: s["texto"] != ""))
        return let(heads, assemble)

    return let(segments, build)


def is_manual(pages, first=None):
    """At least two of the manual markers in the pages, or in so many of the ``first``."""
    read = as_col(pages) if first is None else F.slice(as_col(pages), 1, first)
    head = F.upper(F.array_join(F.transform(read, lambda p: p["texto"]), " "))
    return let(head, lambda t: reduce(lambda a, b: a + b, [
        F.contains(t, F.lit(m)).cast("int") for m in fv.MANUAL_MARKERS])) >= fv.MIN_MANUAL_MARKERS
