"""Parent and child chunks from sections or from plain pages.

Row-local like section detection: a file's row is cut by array expressions and
then exploded; texts are never shuffled. ``sep`` is the paragraph separator.
"""

from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv
from claimlens.functions.arrays import at, between, let, occurrence, pack, split_with_overlap
from claimlens.functions.codes import as_col
from claimlens.functions.text import id_prefix, strip
from claimlens.operators.sections import is_toc_page

CHUNK_COLUMNS = ["id", "secao", "titulo", "pagina", "fonte", "ano", "tipo", "texto", "contexto",
                 "is_parent", "parent_id"]


def _source_columns(files):
    """What names a file: fonte, ano, tipo, and fonte_id where the files have it."""
    return ["fonte", "ano", "tipo", *(["fonte_id"] if "fonte_id" in files.columns else [])]


def _prefix(files, hash_of, hash_chars):
    """Start of the ids: of ``fonte_id`` in full width where the files have it, if nothing else is asked for."""
    if hash_of is None and "fonte_id" in files.columns:
        return id_prefix("fonte", "fonte_id", hash_chars or 32)
    return id_prefix("fonte", hash_of or "fonte", hash_chars or 6)


def _snippet(text):
    cut = F.regexp_replace(F.substring(text, 1, fv.PARENT_SNIPPET_CHARS), r"(?U)\s+$", "")
    return F.when(F.length(text) > fv.PARENT_SNIPPET_CHARS, F.concat(cut, F.lit("..."))).otherwise(cut)


def _unique(base, n):
    return F.when(n > 0, F.concat(base, F.lit("_dup"), n.cast("string"))).otherwise(base)


def _row(id_, text, context, is_parent, parent_id):
    return F.struct(id_.alias("id"), text.alias("texto"), context.alias("contexto"),
                    F.lit(is_parent).alias("is_parent"), parent_id.alias("parent_id"))


def chunk_sections(files, sections="secoes", parents=True, sep="\n\n", max_chars=fv.FLAT_CHUNK_CHARS,
                   parent_chars=fv.PARENT_CHUNK_CHARS, child_chars=fv.CHILD_CHUNK_CHARS,
                   overlap=fv.OVERLAP_CHARS, hash_of=None, hash_chars=None):
    """Chunks of detected sections; needs fonte, ano, tipo and the sections array.

    ``hash_of`` names the column hashed into the ids, ``hash_chars`` how much of the
    hash they hold: all of fonte_id's where the files have that column (it is then
    carried to the chunks), else six characters of fonte's.

    Equal section numbers in one file would give equal ids: later ones get a
    ``_dupN`` suffix, counted from the earlier sections of the same number.
    """
    pieces = lambda s: split_with_overlap(s["texto"], parent_chars if parents else max_chars, overlap, sep)
    children = lambda t: split_with_overlap(t, child_chars, overlap, sep)

    def of_part(s, n, text, p):
        """A part, and its children with the head of its text; ``c`` is -1 for the part itself."""
        chunk = lambda c, t, snippet: F.struct(
            s["numero"].alias("numero"), s["titulo"].alias("titulo"), s["pagina_inicio"].alias("pagina"),
            n.alias("n_partes"), p.alias("p"), c.alias("c"), t.alias("texto"), snippet.alias("resumo"))
        part = F.array(chunk(F.lit(-1), text, F.lit(None).cast("string")))
        if not parents:
            return part
        return let(_snippet(text), lambda head: F.concat(part, F.transform(children(text), lambda t, c: chunk(c, t, head))))

    flat = F.flatten(F.transform(as_col(sections), lambda s: let(pieces(s), lambda ps: F.flatten(
        F.transform(ps, lambda t, p: of_part(s, F.size(ps), t, p))))))
    # equal (section number, part, child) of a file are told apart by how many came before; a part
    # stands c + 1 places before its child c
    key = lambda y: F.struct(y["numero"].alias("numero"), y["p"].alias("p"), y["c"].alias("c"))
    numbered = let(flat, lambda x: let(occurrence(F.transform(x, key)), lambda seen: F.transform(x, lambda y, k: F.struct(
        y.alias("y"), at(seen, k).alias("n"), at(seen, k - y["c"] - 1).alias("n_parte")))))
    own = _source_columns(files)
    rows = files.select(*own, _prefix(files, hash_of, hash_chars).alias("_pre"), F.explode(numbered).alias("z")).select(
        *own, "_pre", "z.y.*", "z.n", "z.n_parte")
    text, n, none = F.col("texto"), F.col("n"), F.lit(None).cast("string")
    pre = F.concat("_pre", F.lit("_secao_"), F.col("numero"))
    full_title = F.concat_ws(". ", "numero", "titulo")
    p = F.col("p").cast("string")
    if not parents:
        base = F.when(F.col("p") > 0, F.concat(pre, F.lit("_parte"), p)).otherwise(pre)
        label = F.when(F.col("n_partes") > 1, F.concat(F.lit(" (parte "), (F.col("p") + 1).cast("string"), F.lit(")"))).otherwise("")
        context = F.concat(F.lit("["), F.col("fonte"), F.lit(" - "), full_title, label, F.lit(" - Página "),
                           F.col("pagina").cast("string"), F.lit("]\n\n"), text)
        id_, is_parent, parent_id = _unique(base, n), F.lit(False), none
    else:
        is_parent = F.col("c") < 0
        head = F.concat(F.lit("["), F.col("fonte"), F.lit(" | Seção "), full_title, F.lit(" | Página "),
                        F.col("pagina").cast("string"), F.lit(" | Tipo: "), F.col("tipo"), F.lit("]"))
        whole = F.concat(pre, F.lit("_parent"), p)
        id_ = _unique(F.when(is_parent, whole).otherwise(
            F.concat(pre, F.lit("_p"), p, F.lit("_c"), F.col("c").cast("string"))), n)
        parent_id = F.when(~is_parent, _unique(whole, F.col("n_parte")))
        context = F.when(is_parent, F.concat(head, F.lit("\n\n"), text)).otherwise(
            F.concat(head, F.lit("\n\nContexto da seção: "), F.col("resumo"), F.lit("\n\n"), text))
    return rows.select(
        id_.alias("id"), F.col("numero").alias("secao"), "titulo", "pagina", "fonte", "ano", "tipo", "texto",
        context.alias("contexto"), is_parent.alias("is_parent"), parent_id.alias("parent_id"), *own[3:])


def page_blocks(pages, sep="\n\n", limit=fv.PARENT_CHUNK_CHARS):
    """Blocks ``array<struct<pagina,texto>>``: paragraphs of a file packed across pages.

    Contents pages and paragraphs under 20 characters are left out.
    """
    def paragraphs(p):
        t = strip(p["texto"])
        parts = F.filter(F.transform(F.split(t, sep), strip), lambda x: F.length(x) >= fv.MIN_PARAGRAPH_CHARS)
        return F.when(is_toc_page(t), F.array()).otherwise(
            F.transform(parts, lambda x: F.struct(p["pagina"].alias("pagina"), x.alias("texto"))))

    def build(paras):
        lens = F.transform(paras, lambda x: F.length(x["texto"]))
        return let(lens, lambda ls: F.transform(pack(ls, limit, glue=len(sep)), lambda q: F.struct(
            at(paras, q["s"])["pagina"].alias("pagina"),
            F.array_join(F.transform(between(paras, q["s"], q["e"]), lambda x: x["texto"]), sep).alias("texto"))))

    return let(F.flatten(F.transform(as_col(pages), paragraphs)), build)


def chunk_pages(files, pages="pages", parents=True, sep="\n\n", max_chars=fv.FLAT_CHUNK_CHARS,
                parent_chars=fv.PARENT_CHUNK_CHARS, child_chars=fv.CHILD_CHUNK_CHARS, overlap=fv.OVERLAP_CHARS,
                hash_of=None, hash_chars=None):
    """Chunks of files without sections; needs fonte, ano, tipo and the pages array. Ids as in ``chunk_sections``."""
    none = F.lit(None).cast("string")
    blocks = page_blocks(pages, sep, parent_chars)
    pre = F.col("_pre")
    own = _source_columns(files)
    files = files.withColumn("_pre", _prefix(files, hash_of, hash_chars))
    page = F.col("pagina").cast("string")
    if not parents:
        flat = let(blocks, lambda bs: F.flatten(F.transform(bs, lambda b: F.transform(
            split_with_overlap(b["texto"], max_chars, overlap, sep),
            lambda t: F.struct(b["pagina"].alias("pagina"), t.alias("texto"))))))
        rows = files.select(*own, "_pre", F.posexplode(flat).alias("i", "b")).select(
            *own, "_pre", "i", "b.pagina", "b.texto")
        text = F.col("texto")
        chunks = F.array(_row(
            F.concat(pre, F.lit("_p"), page, F.lit("_c"), F.col("i").cast("string")), text,
            F.concat(F.lit("["), F.col("fonte"), F.lit(" - Página "), page, F.lit("]\n\n"), text), False, none))
    else:
        shaped = F.transform(blocks, lambda b: F.struct(
            b["pagina"].alias("pagina"), b["texto"].alias("texto"),
            split_with_overlap(b["texto"], child_chars, overlap, sep).alias("filhos")))
        rows = files.select(*own, "_pre", F.posexplode(shaped).alias("i", "b")).select(
            *own, "_pre", "i", "b.pagina", "b.texto", "b.filhos")
        text, i = F.col("texto"), F.col("i").cast("string")
        head = F.concat(F.lit("["), F.col("fonte"), F.lit(" | Página "), page, F.lit(" | Tipo: "), F.col("tipo"), F.lit("]"))
        parent_id = F.concat(pre, F.lit("_p"), page, F.lit("_parent"), i)
        chunks = F.concat(
            F.array(_row(parent_id, text, F.concat(head, F.lit("\n\n"), text), True, none)),
            F.transform("filhos", lambda t, c: _row(
                F.concat(pre, F.lit("_p"), page, F.lit("_c"), i, F.lit("_"), c.cast("string")), t,
                F.concat(head, F.lit("\n\nContexto: "), _snippet(text), F.lit("\n\n"), t), False, parent_id)))
    out = rows.select(*own, "pagina", F.explode(chunks).alias("c"))
    return out.select("c.*", page.alias("secao"), F.concat(F.lit("Página "), page).alias("titulo"),
                      "pagina", *own).select(*CHUNK_COLUMNS, *own[3:])


def sections_of_chunks(chunks):
    """Section rows for files that were chunked without section detection."""
    return chunks.select(F.col("pagina").cast("string").alias("numero"), "titulo",
                         F.col("pagina").alias("pagina_inicio"), "texto", "fonte", *_source_columns(chunks)[3:])
