"""Registered queries: text functions, sections, chunks, claim texts, rules, citations."""

from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv, questions as Q, rules as R, text as T
from claimlens.operators import chunks as H, citations as Z, claim_text as P, html as M, sections as D, inventory as I
from claimlens.plans import text_views as V
from claimlens.plans.registry import query
from claimlens.sources import corpus, sinks

LF = "\n"


@query("tokens_by_doc", f"""
SELECT id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS h FROM (SELECT doc_id AS id, {V.tokens('text')} AS toks FROM documents)""")
def _(b):
    t = b.raw("documents").select(F.col("doc_id").alias("id"), T.tokens("text").alias("toks"))
    return t.select("id", F.size("toks").cast("long").alias("n_tokens"), F.md5(F.array_join("toks", " ").cast("binary")).alias("h"))


@query("text_normalise", f"""
SELECT doc_id, md5({V.fold('text')}) AS folded, md5(trim(regexp_replace({V.fold('text')}, '\\s+', ' ', 'g'))) AS spaced FROM documents""")
def _(b):
    return b.raw("documents").select("doc_id", F.md5(T.fold("text").cast("binary")).alias("folded"),
                                     F.md5(T.normalise_spaces("text").cast("binary")).alias("spaced"))


@query("text_shaping", """
SELECT id, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '[...truncado]' ELSE text END) AS curto, titulo, pagina FROM v_chunks""")
def _(b):
    plain = T.drop_context_prefix("texto")
    return b.chunks.select("id", F.md5(T.truncate(plain, 500).cast("binary")).alias("curto"),
                           T.first_line("titulo").alias("titulo"), T.page_number(F.col("pagina").cast("string")).alias("pagina"))


@query("source_attributes", """
SELECT doc_id, ano, is_annex, tipo, fonte, CASE WHEN contains(path, '2017') OR contains(fonte, '2017') THEN 'Manual SIH/SUS 2017'
  WHEN contains(lower(fonte), 'sia') OR contains(path, 'SIA') THEN 'Manual SIA/SUS'
  WHEN contains(lower(path), 'manual_tecnico_sistema') OR contains(lower(fonte), 'manual sih') THEN 'Manual SIH/SUS 2012' ELSE fonte END AS fonte_manual
FROM v_files""")
def _(b):
    return b.files.select("doc_id", "ano", "is_annex", "tipo", "fonte",
                          corpus.manual_source_name("path", "fonte").alias("fonte_manual"))


@query("url_attributes", """
SELECT page_id, coalesce(list_filter(list_transform(string_split(url, '/'), lambda p: regexp_extract(p, '(\\d{4})', 1)),
  lambda y: y <> '' AND TRY_CAST(y AS INTEGER) BETWEEN 2000 AND 2030)[1], '') AS ano,
  contains(lower(list_last(string_split(url, '/'))), 'anexo') OR contains(lower(list_last(string_split(url, '/'))), 'relatorio_grupo')
  OR contains(lower(list_last(string_split(url, '/'))), 'relatorio_analitico') AS is_annex,
  list_last(string_split(url, '/')) AS nome FROM pages""")
def _(b):
    return b.raw("pages").select("page_id", corpus.path_year("url").alias("ano"), corpus.is_annex("url").alias("is_annex"),
                                 corpus.file_name("url").alias("nome"))


@query("annex_page_cap", """
SELECT doc_id, pagina, md5(texto) AS h FROM v_pages WHERE NOT is_annex OR pagina <= 10""")
def _(b):
    pages = b.files.select("doc_id", "is_annex", F.explode("pages").alias("p")).select("doc_id", "is_annex", "p.pagina", "p.texto")
    return corpus.cap_annex_pages(pages, cap=fv.ANNEX_PAGE_CAP).select("doc_id", "pagina", F.md5(F.col("texto").cast("binary")).alias("h"))


@query("source_classify", "SELECT doc_id, eh_manual FROM v_is_manual")
def _(b):
    return b.files.select("doc_id", D.is_manual("pages", fv.CLASSIFY_PAGES).alias("eh_manual"))


def _sections(b):
    return b.files.withColumn("secoes", D.detect_sections("pages"))


@query("section_detect", """
SELECT doc_id, numero, titulo, pagina_inicio, md5(texto) AS h FROM v_sections""")
def _(b):
    s = _sections(b).select("doc_id", F.explode("secoes").alias("s")).select("doc_id", "s.*")
    return s.select("doc_id", "numero", "titulo", "pagina_inicio", F.md5(F.col("texto").cast("binary")).alias("h"))


@query("split_overlap", f"""
SELECT doc_id, unnest(range(0, len(ps))) AS i, md5(unnest(ps)) AS h FROM (SELECT doc_id, {V.split_pieces('text', 500, 200, V.SEP)} AS ps FROM documents)""")
def _(b):
    from claimlens.functions.arrays import split_with_overlap

    return b.raw("documents").select("doc_id", F.posexplode(
        split_with_overlap(F.col("text"), fv.CHILD_CHUNK_CHARS, fv.OVERLAP_CHARS, LF)).alias("i", "t")).select(
        "doc_id", F.col("i").cast("long").alias("i"), F.md5(F.col("t").cast("binary")).alias("h"))


@query("chunk_parent_child", f"""
SELECT {V.dup("pre || '_parent' || p", 'ord')} AS id, '' AS parent_id, numero AS secao, titulo, pagina_inicio AS pagina, fonte, tipo, true AS is_parent,
  md5(parte) AS h, md5(head || chr(10) || chr(10) || parte) AS hc FROM v_section_parents
UNION ALL SELECT {V.dup("pre || '_p' || p || '_c' || c", 'ord')}, pid, numero, titulo, pagina_inicio, fonte, tipo, false, md5(filho),
  md5(head || chr(10) || chr(10) || 'Contexto da seção: ' || {V.snippet('parte')} || chr(10) || chr(10) || filho)
FROM v_section_children JOIN (SELECT doc_id AS d2, ord AS o2, p AS p2, {V.dup("pre || '_parent' || p", 'ord')} AS pid FROM v_section_parents)
  ON d2 = doc_id AND o2 = ord AND p2 = p""")
def _(b):
    c = H.chunk_sections(_sections(b), sep=LF, hash_of="path", hash_chars=6)
    return c.select("id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "secao", "titulo", "pagina", "fonte", "tipo", "is_parent",
                    F.md5(F.col("texto").cast("binary")).alias("h"), F.md5(F.col("contexto").cast("binary")).alias("hc"))


@query("chunk_flat", f"""
SELECT {V.dup("pre || CASE WHEN i > 0 THEN '_parte' || i ELSE '' END", 'ord')} AS id, md5(parte) AS h,
  md5('[' || fonte || ' - ' || numero || '. ' || titulo || CASE WHEN n > 1 THEN ' (parte ' || (i + 1) || ')' ELSE '' END || ' - Página ' || pagina_inicio || ']' || chr(10) || chr(10) || parte) AS hc
FROM (SELECT s.*, f.fonte, {V.id_prefix('f.fonte', 'f.path')} || '_secao_' || numero AS pre, unnest(ps) AS parte, unnest(range(0, len(ps))) AS i, len(ps) AS n
  FROM (SELECT *, {V.split_pieces('texto', 1500, 200, V.SEP)} AS ps FROM v_sections) s JOIN v_files f USING (doc_id))""")
def _(b):
    c = H.chunk_sections(_sections(b), parents=False, sep=LF, hash_of="path", hash_chars=6)
    return c.select("id", F.md5(F.col("texto").cast("binary")).alias("h"), F.md5(F.col("contexto").cast("binary")).alias("hc"))


@query("chunk_generic", f"""
SELECT {V.id_prefix('fonte', 'path')} || '_p' || pagina || '_parent' || bloco AS id, '' AS parent_id, CAST(pagina AS VARCHAR) AS secao, pagina, md5(texto) AS h,
  md5('[' || fonte || ' | Página ' || pagina || ' | Tipo: ' || tipo || ']' || chr(10) || chr(10) || texto) AS hc
FROM v_blocks JOIN v_files USING (doc_id)
UNION ALL SELECT pre || '_p' || pagina || '_c' || bloco || '_' || c, pre || '_p' || pagina || '_parent' || bloco, CAST(pagina AS VARCHAR), pagina, md5(filho),
  md5(head || chr(10) || chr(10) || 'Contexto: ' || {V.snippet('texto')} || chr(10) || chr(10) || filho) FROM v_block_children""")
def _(b):
    c = H.chunk_pages(b.files, sep=LF, hash_of="path", hash_chars=6)
    return c.select("id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "secao", "pagina",
                    F.md5(F.col("texto").cast("binary")).alias("h"), F.md5(F.col("contexto").cast("binary")).alias("hc"))


@query("chunk_generic_flat", f"""
SELECT {V.id_prefix('fonte', 'path')} || '_p' || pagina || '_c' || (row_number() OVER (PARTITION BY doc_id ORDER BY bloco, i) - 1) AS id, md5(t) AS h
FROM (SELECT doc_id, bloco, pagina, unnest(ps) AS t, unnest(range(0, len(ps))) AS i FROM (SELECT *, {V.split_pieces('texto', 1500, 200, V.SEP)} AS ps FROM v_blocks))
JOIN v_files USING (doc_id)""")
def _(b):
    c = H.chunk_pages(b.files, parents=False, sep=LF, hash_of="path", hash_chars=6)
    return c.select("id", F.md5(F.col("texto").cast("binary")).alias("h"))


@query("sections_of_chunks", """
SELECT CAST(pagina AS VARCHAR) AS numero, 'Página ' || pagina AS titulo, pagina AS pagina_inicio, fonte, md5(texto) AS h FROM v_blocks JOIN v_files USING (doc_id)
UNION ALL SELECT CAST(pagina AS VARCHAR), 'Página ' || pagina, pagina, fonte, md5(filho) FROM v_block_children""")
def _(b):
    s = H.sections_of_chunks(H.chunk_pages(b.files, sep=LF))
    return s.withColumn("h", F.md5(F.col("texto").cast("binary"))).drop("texto", "fonte_id")


@query("html_to_text", r"""
SELECT page_id, length(t) AS n, md5(t) AS h FROM (
  SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(html, '(?is)(?:<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<![^>]*>|</?[a-z][^>]*>)+', chr(10), 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
    '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages) WHERE length(t) >= 50""")
def _(b):
    p = M.html_pages(b.raw("pages").select("page_id", "html")).select("page_id", F.col("pages")[0]["texto"].alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("h"))


# --- questions ---------------------------------------------------------------------------
@query("question_filters", f"""
SELECT query_id, coalesce({V.year_of('pergunta')}, '') AS ano, coalesce({V.type_of('pergunta')}, '') AS tipo,
  {V.words('pergunta')} <= 2 OR regexp_full_match(pergunta, '\\d+') AS curta FROM v_part_questions""")
def _(b):
    return b.part_questions.select("query_id", F.coalesce(Q.year_filter("pergunta"), F.lit("")).alias("ano"),
                                   F.coalesce(Q.type_filter("pergunta"), F.lit("")).alias("tipo"), Q.is_short("pergunta").alias("curta"))


@query("query_decompose", V.unrolled("v_part_questions", V.sub_list("pergunta")))
def _(b):
    return b.part_questions.select("query_id", F.posexplode(Q.sub_questions("pergunta")).alias("sub", "texto"))


@query("query_reformulate", V.unrolled("v_part_questions", V.reformulation_list("pergunta")))
def _(b):
    return b.part_questions.select("query_id", F.posexplode(Q.reformulations("pergunta")).alias("sub", "texto"))


# --- claim texts -------------------------------------------------------------------------
@query("claim_text_parse", """
SELECT claim_id, num_aih, tipo, coalesce(especialidade, '-') AS especialidade, coalesce(carater, '-') AS carater, motivo_saida, proc_codigo, proc_nome,
  cid, cid_nome, array_to_string(codigos, ',') AS codigos, array_to_string(cids, ',') AS cids FROM v_claims_parsed""")
def _(b):
    c = b.claim_texts.withColumn("c", P.parse_claim("texto"))
    return c.select("claim_id", "c.num_aih", "c.tipo", F.coalesce("c.especialidade", F.lit("-")).alias("especialidade"),
                    F.coalesce("c.carater", F.lit("-")).alias("carater"), "c.motivo_saida",
                    F.col("c.procedimento_principal.codigo").alias("proc_codigo"), F.col("c.procedimento_principal.nome").alias("proc_nome"),
                    F.col("c.diagnostico_principal.cid").alias("cid"), F.col("c.diagnostico_principal.nome").alias("cid_nome"),
                    F.array_join("c.procedimentos_unicos", ",").alias("codigos"),
                    F.array_join(F.sort_array("c.cids_secundarios"), ",").alias("cids"))


GROUPS = " ".join(f"WHEN '{k}' THEN {V.lit(v)}" for k, v in fv.PROCEDURE_GROUPS.items())


@query("claim_codes_by_group", f"""
SELECT claim_id, codigo, substr(codigo, 1, 2) AS grupo, CASE substr(codigo, 1, 2) {GROUPS} ELSE 'grupo ' || substr(codigo, 1, 2) END AS no_grupo
FROM (SELECT claim_id, unnest(codigos) AS codigo FROM v_claims_parsed)""")
def _(b):
    return P.codes_by_group(b.claim_texts.withColumn("aih", P.parse_claim("texto")), "claim_id")


CLAIM_Q = f"""[
  'procedimento principal ' || proc_nome || ' AIH regras', 'diagnostico ' || cid || ' ' || cid_nome || ' compatibilidade procedimento CID',
  'compatibilidade ' || proc_nome || ' com ' || cid || ' ' || cid_nome, 'especialidade ' || especialidade || ' AIH regras validacao internacao',
  'carater atendimento ' || carater || ' AIH regras', 'motivo saida ' || motivo_saida || ' AIH regras',
  'procedimentos ' || CASE substr(codigos[1], 1, 2) {GROUPS} END || ' grupo ' || substr(codigos[1], 1, 2) || ' SIGTAP AIH regras quantidade limite',
  CASE WHEN len(cids) > 0 THEN 'CID secundario ' || 'A' || lpad(CAST(claim_id % 1000 AS VARCHAR), 3, '0') || ' A' || lpad(CAST((claim_id + 1) % 1000 AS VARCHAR), 3, '0') || ' causas externas politraumatismo' END]"""


@query("claim_questions", V.unrolled("v_claims_parsed", CLAIM_Q, "claim_id"))
def _(b):
    return b.claim_texts.select("claim_id", F.posexplode(Q.claim_questions(P.parse_claim("texto"), fv.QUESTION_SECONDARIES)).alias("sub", "texto"))


# --- rules -------------------------------------------------------------------------------
@query("rule_defs", "SELECT CAST(numero AS INTEGER) AS numero, codigo, nome, campos FROM v_rules")
def _(b):
    return R.rule_definitions(b.rule_texts, "texto").withColumn("campos", F.array_join("campos", "|"))


ENRICH = " ".join(f"WHEN contains(lower(nome), lower({V.lit(k)})) THEN nome || ' ' || {V.lit(v)}" for k, v in fv.RULE_NAME_ENRICHMENT.items())


@query("rule_enrichment", f"SELECT CAST(numero AS INTEGER) AS numero, CASE {ENRICH} ELSE nome END AS consulta FROM v_rules")
def _(b):
    return R.rule_definitions(b.rule_texts, "texto").select("numero", R.enriched_name("nome").alias("consulta"))


TERMS = ", ".join(
    "CASE WHEN " + " OR ".join([f"contains(codigo_fonte, {V.lit(w)})" for w in ex] + [f"contains(lower(codigo_fonte), {V.lit(w)})" for w in an])
    + f" THEN {V.lit(t)} END" for t, ex, an in fv.SOURCE_KEYWORD_TERMS)


@query("rule_search_terms", f"""
SELECT text_id, CAST(row_number() OVER (PARTITION BY text_id ORDER BY i) - 1 AS INTEGER) AS ordem, t AS termo FROM (
  SELECT text_id, unnest(l) AS t, unnest(range(0, len(l))) AS i FROM (SELECT text_id, [{TERMS}, nome] AS l FROM v_rule_code)) WHERE t IS NOT NULL""")
def _(b):
    names = b.raw("part").select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("nome"))
    return b.rule_texts.join(names, "text_id").select("text_id", F.posexplode(
        R.source_search_terms("codigo_fonte", "nome")).alias("ordem", "termo"))


@query("rule_list_filter", "SELECT CAST(numero AS INTEGER) AS numero, codigo, nome FROM v_rules WHERE contains(lower(nome), 'sexo')")
def _(b):
    return I.rules_named(R.rule_definitions(b.rule_texts, "texto"), "Sexo").select("numero", "codigo", "nome")


@query("verdict_lines", """
SELECT answer_id, CASE WHEN answer_id % 3 = 0 THEN 'Veredicto: PARCIAL' WHEN answer_id % 3 = 1 THEN 'nao conforme aqui' ELSE '?' END AS veredicto FROM v_answers""")
def _(b):
    k = F.col("answer_id")
    doc = F.concat(F.replace(F.replace("texto", F.lit("onforme"), F.lit("")), F.lit("ONFORME"), F.lit("")),
                   F.when(k % 3 == 0, "\n Veredicto: PARCIAL \nCONFORME").when(k % 3 == 1, "\n nao conforme aqui\nVeredicto: x").otherwise("\nfim"))
    return b.answers.select("answer_id", T.verdict_line(doc).alias("veredicto"))


# --- inventory of the corpus ---------------------------------------------------------------
@query("source_inventory", """
SELECT fonte, count(*) AS chunks, min_by(tipo, id) AS tipo, min_by(ano, id) AS ano FROM v_chunks GROUP BY fonte""")
def _(b):
    return I.sources(b.chunks)


@query("chunk_counts", """
SELECT 'tipo' AS por, tipo AS valor, count(*) AS n FROM v_chunks GROUP BY tipo UNION ALL SELECT 'fonte', fonte, count(*) FROM v_chunks GROUP BY fonte""")
def _(b):
    return I.counts_by(b.chunks, ["tipo", "fonte"])


@query("section_list", """
SELECT secao, min_by(titulo, id) AS titulo, min_by(pagina, id) AS pagina,
  array_to_string(list_transform(string_split(secao, '.'), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), '/') AS ordem FROM v_chunks GROUP BY secao""")
def _(b):
    idx = Z.section_index(b.chunks)
    return idx.select("secao", T.first_line("titulo").alias("titulo"), "pagina",
                      F.array_join(T.section_sort_key("secao").cast("array<string>"), "/").alias("ordem")).orderBy(T.section_sort_key("secao"))


@query("chunks_by_section", """
SELECT c.secao, c.id, titulo, pagina, fonte, md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '[...truncado]' ELSE text END) AS h
FROM v_chunks c WHERE secao IN (SELECT secao FROM v_citations)""")
def _(b):
    shown = I.chunks_of_sections(b.chunks, Z.extract_citations(b.answers), 2000)
    return shown.select("secao", "id", "titulo", "pagina", "fonte", F.md5(F.col("texto").cast("binary")).alias("h"))


# --- citations -----------------------------------------------------------------------------
@query("citations", "SELECT answer_id, secao, coalesce(pagina, -1) AS pagina FROM v_citations")
def _(b):
    return Z.extract_citations(b.answers).select("answer_id", "secao", F.coalesce("pagina", F.lit(-1)).alias("pagina"))


@query("citations_every_pattern", """
SELECT answer_id, secao, coalesce(pagina, -1) AS pagina FROM v_citations UNION SELECT answer_id, secao, -1 FROM v_citations""")
def _(b):
    return Z.extract_citations(b.answers, every_pattern=True).select("answer_id", "secao", F.coalesce("pagina", F.lit(-1)).alias("pagina"))


CHECKED = """
SELECT c.answer_id, c.secao, coalesce(c.pagina, -1) AS pagina, s.secao IS NOT NULL AS existe, coalesce(s.titulo, '') AS titulo,
  coalesce(s.secao IS NOT NULL AND (c.pagina IS NULL OR c.pagina = s.pagina), false) AS pagina_confere,
  s.secao IS NOT NULL AND (c.pagina IS NULL OR EXISTS (SELECT 1 FROM v_chunks x WHERE x.secao = c.secao AND x.pagina = c.pagina)) AS alguma_pagina
FROM v_citations c LEFT JOIN (SELECT secao, min_by(titulo, id) AS titulo, min_by(pagina, id) AS pagina FROM v_chunks GROUP BY secao) s ON s.secao = c.secao"""


@query("citation_check", CHECKED)
def _(b):
    v = Z.verify_citations(Z.extract_citations(b.answers), b.chunks)
    f = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return v.select("answer_id", "secao", F.coalesce("pagina", F.lit(-1)).alias("pagina"), "existe",
                    F.coalesce("titulo", F.lit("")).alias("titulo"), f("pagina_confere"), f("alguma_pagina"))


@query("section_verify", f"""
WITH req AS (SELECT DISTINCT secao, 'THE' AS trecho FROM v_citations)
SELECT r.secao, s.secao IS NOT NULL AS encontrada, coalesce(s.titulo, '') AS titulo, coalesce(n, 0) AS n_trechos,
  md5(coalesce(CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || chr(10) || '[...truncado]' ELSE t END, '')) AS resumo,
  EXISTS (SELECT 1 FROM v_chunks x WHERE x.secao = r.secao AND contains({V.fold('x.contexto')}, 'the')) AS texto_encontrado
FROM req r LEFT JOIN (SELECT secao, min_by(titulo, id) AS titulo, count(*) AS n, string_agg(contexto, chr(10) ORDER BY id) AS t FROM v_chunks GROUP BY secao) s
  ON s.secao = r.secao""")
def _(b):
    asked = Z.extract_citations(b.answers).select("secao", F.lit("THÉ").alias("trecho")).distinct()
    v = Z.verify_sections(asked, b.chunks)
    return v.select("secao", "encontrada", F.coalesce("titulo", F.lit("")).alias("titulo"),
                    F.coalesce("n_trechos", F.lit(0).cast("long")).alias("n_trechos"),
                    F.md5(F.coalesce("resumo", F.lit("")).cast("binary")).alias("resumo"), "texto_encontrado")


@query("grounding_tallies", """
SELECT answer_id, count(*) AS n_total, count(*) FILTER (x = 0) AS n_fundamentado, count(*) FILTER (x = 1) AS n_inferencia, count(*) FILTER (x = 2) AS n_sem_fonte
FROM (SELECT answer_id, (answer_id + i * i) % 3 AS x FROM (SELECT answer_id, unnest(range(0, len(string_split(texto, '.')))) AS i FROM v_answers)) GROUP BY answer_id""")
def _(b):
    return Z.grounding(b.grounding_labels)


@query("answer_flags", f"""
WITH chk AS ({CHECKED}), g AS (
  SELECT answer_id, count(*) AS n_total, count(*) FILTER ((answer_id + i * i) % 3 = 2) AS n_sem FROM (
    SELECT answer_id, unnest(range(0, len(string_split(texto, '.')))) AS i FROM v_answers) GROUP BY answer_id),
c AS (SELECT answer_id, count(*) AS n, count(*) FILTER (NOT existe) AS bad FROM chk GROUP BY answer_id)
SELECT answer_id, coalesce(c.n, 0) AS n_citacoes, coalesce(bad, 0) AS n_inexistentes, n_total, n_sem AS n_sem_fonte,
  coalesce(bad, 0) > 0 OR (score_geral >= 0 AND score_geral < 0.5) OR n_sem / n_total > 0.3 AS tem_problemas
FROM v_answers LEFT JOIN c USING (answer_id) LEFT JOIN g USING (answer_id)""")
def _(b):
    v = Z.verify_citations(Z.extract_citations(b.answers), b.chunks)
    return Z.answer_flags(b.answers, v, Z.grounding(b.grounding_labels))


# --- sinks ------------------------------------------------------------------------------------
@query("replace_by_source", """
WITH novo AS (SELECT d.* FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT id, fonte, length(contexto) AS n FROM v_chunks WHERE fonte NOT IN (SELECT source FROM novo)
UNION ALL SELECT 'd' || doc_id || '_novo', source, length(text) FROM novo""")
def _(b):
    # the new edition: the documents labelled toxic, with new ids; their sources are replaced
    toxic = b.raw("labels").where("toxic = 1").select("doc_id")
    new = b.raw("documents").join(toxic, "doc_id").select(
        F.concat(F.lit("d"), "doc_id", F.lit("_novo")).alias("id"), F.col("source").alias("fonte"), F.col("text").alias("contexto"))
    return sinks.replace_by_source(b.chunks.select("id", "fonte", "contexto"), new).select(
        "id", "fonte", F.length("contexto").cast("long").alias("n"))


@query("vector_collection", """
SELECT c.id, secao, c.pagina, fonte, c.ano, c.tipo, md5(contexto) AS h, len(v.v) AS dims FROM v_chunks c JOIN v_vectors v ON v.id = c.id""")
def _(b):
    rows = sinks.vector_collection(b.chunks, b.vectors)
    return rows.select("id", "secao", "pagina", "fonte", "ano", "tipo", F.md5(F.col("documento").cast("binary")).alias("h"),
                       F.size("embedding").cast("long").alias("dims"))
