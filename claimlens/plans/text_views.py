"""Oracle views of the document side, in DuckDB SQL."""

from claimlens.functions import fixed_values as fv
from claimlens.plans.oracle_views import pad, view


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def fold(x):
    return f"strip_accents(lower({x}))"


STOP = "[" + ", ".join(lit(w) for w in fv.STOPWORDS_PT) + "]"


def tokens(x):
    return (f"list_filter(string_split_regex({fold(x)}, '[^a-z0-9]+'), "
            f"lambda t: length(t) >= 2 AND NOT list_contains({STOP}, t))")


def id_prefix(fonte, hashed):
    return (f"(substr(regexp_replace(lower({fonte}), '[^a-z0-9]', '_', 'g'), 1, 24) || '_' || substr(md5({hashed}), 1, 6))")


def split_pieces(text, limit, overlap, sep):
    """List of pieces: a fold over paragraph positions, overlap found through prefix sums."""
    paras = f"string_split({text}, {sep})"
    return f"""(CASE WHEN length({text}) <= {limit} THEN [{text}] ELSE
  (SELECT list_transform(acc.p || [{{s: acc.s, e: len(ps)}}], lambda q: array_to_string(ps[q.s + 1 : q.e], {sep})) FROM (
    SELECT ps, list_reduce(list_transform(range(0, len(ps)), lambda i: {{s: i, p: CAST([] AS STRUCT(s BIGINT, e BIGINT)[])}}),
      lambda a, x: CASE WHEN x.s > a.s AND c[x.s + 2] - c[a.s + 1] > {limit}
        THEN {{s: list_filter(range(a.s, x.s + 1), lambda j: c[x.s + 1] - c[j + 1] <= {overlap})[1], p: a.p || [{{s: a.s, e: x.s}}]}}
        ELSE {{s: a.s, p: a.p}} END, {{s: CAST(0 AS BIGINT), p: CAST([] AS STRUCT(s BIGINT, e BIGINT)[])}}) AS acc
    FROM (SELECT ps, list_transform(range(0, len(ps) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda z: length(z))), 0)) AS c
      FROM (SELECT {paras} AS ps)))) END)"""


view("v_files", """
SELECT doc_id, path, ano, is_annex, CASE WHEN is_annex THEN 'anexo_sigtap' WHEN contains(lower(path), 'portaria') THEN 'portaria' ELSE 'manual' END AS tipo,
  CASE WHEN ano <> '' THEN nm || ' (' || ano || ')' ELSE nm END AS fonte, lines
FROM (SELECT doc_id, path, lines, coalesce(list_filter(list_transform(string_split(path, '/'), lambda p: regexp_extract(p, '(\\d{4})', 1)),
    lambda y: y <> '' AND TRY_CAST(y AS INTEGER) BETWEEN 2000 AND 2030)[1], '') AS ano,
  contains(lower(split_part(path, '/', 4)), 'anexo') AS is_annex,
  substr(trim(replace(replace(replace(regexp_replace(split_part(path, '/', 4), '\\.[^.]*$', ''), '_', ' '), '-', ' '), '  ', ' ')), 1, 60) AS nm
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines,
    'corpus/' || CASE doc_id % 3 WHEN 0 THEN 'portaria' WHEN 1 THEN 'manuais' ELSE 'outros' END
    || CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 20 + 2005 AS VARCHAR) ELSE '' END || '/' || source || '/'
    || CASE doc_id % 5 WHEN 0 THEN 'Anexo_I-' WHEN 1 THEN 'manual_sih_' WHEN 2 THEN 'SIA-' ELSE 'texto__' END || doc_id || '.pdf' AS path
    FROM documents))""")
view("v_pages", """
SELECT doc_id, path, fonte, ano, tipo, is_annex, CAST(p AS INTEGER) AS pagina,
  CASE WHEN (doc_id + p) % 5 = 0 THEN p || '.' || (doc_id % 9 + 1) || ' CAPÍTULO DE REGRAS gerais' || chr(10)
    WHEN (doc_id + p) % 5 = 1 THEN p || chr(10) || 'TÍTULO DA SEÇÃO (OPM)' || chr(10)
    WHEN (doc_id + p) % 5 = 2 THEN 'MANUAL TÉCNICO OPERACIONAL - SIH/SUS' || chr(10) || p || chr(10)
    WHEN (doc_id + p) % 5 = 3 AND doc_id % 4 = 0 THEN repeat('Item ...... 1' || chr(10), 3) ELSE '' END
  || array_to_string(lines[(p - 1) * 10 + 1 : p * 10], chr(10)) AS texto
FROM v_files, range(1, CAST(ceil(len(lines) / 10.0) AS BIGINT) + 1) AS r(p)""")
view("v_good_pages", "SELECT * FROM v_pages WHERE (length(texto) - length(replace(texto, '...', ''))) / 3 <= 5")

U = "A-ZÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ"
NUM = r"\d{1,2}(?:\.\d{1,2})?(?:\.\d{1,2})?"
TITLE = rf"[{U}][{U}\s\-/,\(\)\.]+"
view("v_clean", f"""
SELECT doc_id, pagina, {strip("string_agg(line, chr(10) ORDER BY ln)")} AS texto FROM (
  SELECT doc_id, pagina, ln, CASE WHEN is_title AND lag(is_num) OVER w THEN NULL
    WHEN is_num AND lead(is_title) OVER w THEN rtrim(bare, '.') || ' ' || lead(bare) OVER w
    WHEN regexp_full_match(bare, '\\d{{1,3}}') THEN NULL ELSE line END AS line
  FROM (SELECT doc_id, pagina, ln, line, {strip('line')} AS bare,
      regexp_full_match({strip('line')}, '{NUM}\\s*\\.?\\s*') AS is_num, regexp_full_match({strip('line')}, '{TITLE}') AS is_title
    FROM (SELECT doc_id, pagina, unnest(string_split(texto, chr(10))) AS line, unnest(range(0, len(string_split(texto, chr(10))))) AS ln FROM v_good_pages)
    WHERE NOT contains(line, 'MANUAL TÉCNICO OPERACIONAL') AND NOT contains(line, 'SISTEMA DE INFORMAÇÃO HOSPITALAR')
      AND NOT regexp_full_match(line, '\\s*SETEMBRO 2012\\s*'))
  WINDOW w AS (PARTITION BY doc_id, pagina ORDER BY ln)) WHERE line IS NOT NULL GROUP BY doc_id, pagina""")
view("v_section_lines", f"""
SELECT doc_id, pagina, ln, line, regexp_matches(line, '^{NUM}\\s+{TITLE}') AS head,
  regexp_extract(line, '^({NUM})\\s+({TITLE})', ['n', 't']) AS h,
  substr(line, length(regexp_extract(line, '^{NUM}\\s+{TITLE}')) + 1) AS rest,
  CAST(sum(CASE WHEN regexp_matches(line, '^{NUM}\\s+{TITLE}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pagina, ln) AS BIGINT) AS sec
FROM (SELECT doc_id, pagina, unnest(string_split(texto, chr(10))) AS line, unnest(range(0, len(string_split(texto, chr(10))))) AS ln
  FROM v_clean WHERE texto <> '')""")
view("v_segments", f"""
SELECT doc_id, sec, pagina, {strip("string_agg(CASE WHEN head THEN rest ELSE line END, chr(10) ORDER BY ln)")} AS texto
FROM v_section_lines GROUP BY doc_id, sec, pagina""")
view("v_sections", f"""
SELECT doc_id, sec AS ord, h.n AS numero, rtrim({strip('h.t')}, '.') AS titulo, hd.pagina AS pagina_inicio, s.texto FROM
  (SELECT doc_id, sec, {strip("string_agg(texto, chr(10) ORDER BY pagina) FILTER (texto <> '')")} AS texto FROM v_segments GROUP BY doc_id, sec) s
  JOIN (SELECT * FROM v_section_lines WHERE head) hd USING (doc_id, sec) WHERE s.texto <> ''
UNION ALL SELECT g.doc_id, 0, '0', 'PREÂMBULO', g.pagina, g.texto FROM v_segments g
  JOIN (SELECT doc_id, pagina FROM v_section_lines WHERE head AND sec = 1) f USING (doc_id, pagina)
  WHERE g.sec = 0 AND g.texto <> '' AND g.pagina > 8""")
view("v_is_manual", """
SELECT doc_id, contains(t, 'SISTEMA DE INFORMAÇÃO HOSPITALAR')::INT + contains(t, 'MANUAL TÉCNICO OPERACIONAL')::INT
  + contains(t, 'SIH/SUS')::INT + contains(t, 'AIH')::INT >= 2 AS eh_manual
FROM (SELECT doc_id, upper(string_agg(texto, ' ' ORDER BY pagina)) AS t FROM v_pages WHERE pagina <= 10 GROUP BY doc_id)""")

SEP = "chr(10)"
view("v_section_parents", f"""
SELECT *, {id_prefix('fonte', 'path')} || '_secao_' || numero AS pre,
  '[' || fonte || ' | Seção ' || numero || '. ' || titulo || ' | Página ' || pagina_inicio || ' | Tipo: ' || tipo || ']' AS head
FROM (SELECT s.*, f.path, f.fonte, f.tipo, unnest(ps) AS parte, unnest(range(0, len(ps))) AS p
  FROM (SELECT *, {split_pieces('texto', 3000, 200, SEP)} AS ps FROM v_sections) s JOIN v_files f USING (doc_id))""")
view("v_section_children", f"""
SELECT *, unnest(cs) AS filho, unnest(range(0, len(cs))) AS c FROM (SELECT *, {split_pieces('parte', 500, 200, SEP)} AS cs FROM v_section_parents)""")


def dup(base, order):
    return (f"{base} || CASE WHEN row_number() OVER (PARTITION BY {base} ORDER BY {order}) > 1 "
            f"THEN '_dup' || (row_number() OVER (PARTITION BY {base} ORDER BY {order}) - 1) ELSE '' END")


def snippet(t):
    return f"(CASE WHEN length({t}) > 200 THEN regexp_replace(substr({t}, 1, 200), '\\s+$', '') || '...' ELSE {t} END)"


view("v_paragraphs", f"""
SELECT doc_id, pagina, x, row_number() OVER (PARTITION BY doc_id ORDER BY pagina, k) - 1 AS i FROM (
  SELECT doc_id, pagina, k, {strip('x')} AS x FROM (SELECT doc_id, pagina, unnest(string_split({strip('texto')}, chr(10))) AS x,
    unnest(range(0, len(string_split({strip('texto')}, chr(10))))) AS k FROM v_good_pages)) WHERE length(x) >= 20""")
view("v_blocks", """
SELECT doc_id, b - 1 AS bloco, pgs[q.s + 1] AS pagina, array_to_string(ps[q.s + 1 : q.e], chr(10)) AS texto FROM (
  SELECT doc_id, ps, pgs, unnest(acc.p || [{s: acc.s, e: len(ps)}]) AS q, unnest(range(1, len(acc.p) + 2)) AS b FROM (
    SELECT doc_id, ps, pgs, list_reduce(
      list_transform(range(0, len(ps)), lambda i: {s: i, cur: CAST(length(ps[i + 1]) AS BIGINT), p: CAST([] AS STRUCT(s BIGINT, e BIGINT)[])}),
      lambda a, x: CASE WHEN x.s > a.s AND a.cur + x.cur > 3000 THEN {s: x.s, cur: x.cur + 1, p: a.p || [{s: a.s, e: x.s}]}
        ELSE {s: a.s, cur: a.cur + x.cur + 1, p: a.p} END, {s: CAST(0 AS BIGINT), cur: CAST(0 AS BIGINT), p: CAST([] AS STRUCT(s BIGINT, e BIGINT)[])}) AS acc
    FROM (SELECT doc_id, list(x ORDER BY i) AS ps, list(pagina ORDER BY i) AS pgs FROM v_paragraphs GROUP BY doc_id)))""")
view("v_block_children", f"""
SELECT doc_id, bloco, pagina, texto, fonte, tipo, {id_prefix('fonte', 'path')} AS pre, unnest(cs) AS filho, unnest(range(0, len(cs))) AS c,
  '[' || fonte || ' | Página ' || pagina || ' | Tipo: ' || tipo || ']' AS head
FROM (SELECT b.*, f.fonte, f.tipo, f.path, {split_pieces('b.texto', 500, 200, SEP)} AS cs FROM v_blocks b JOIN v_files f USING (doc_id))""")

# --- questions -----------------------------------------------------------------------
view("v_part_questions", f"""
SELECT p_partkey AS query_id, CASE p_partkey % 8
  WHEN 0 THEN 'Critica ' || p_size || ' do manual 20' || {pad('p_size', 2)} || ' ' || p_name
  WHEN 1 THEN 'diferença entre ' || p_name || ' e ' || p_type
  WHEN 2 THEN 'como preencher AIH para ' || p_name
  WHEN 3 THEN 'portaria de 20' || {pad('p_size', 2)} || ' sobre OPM e ' || p_name || ' eletiva'
  WHEN 4 THEN p_name
  WHEN 5 THEN 'tabela sigtap ' || p_brand || ' e regras de ' || p_type
  WHEN 6 THEN '050046 ' || p_name ELSE CAST(p_partkey AS VARCHAR) END AS pergunta FROM part""")


def words(x):
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"


def first_rule(q, rules):
    return "CASE " + " ".join(
        f"WHEN regexp_matches(lower({q}), {lit(chr(92) + 'b' + k + chr(92) + 'b')}) THEN {q} || ' ' || {lit(v)}" for k, v in rules.items()) + " END"


def sub_list(q):
    left, right = f"substr({q}, 1, strpos({q}, ' e ') - 1)", f"substr({q}, strpos({q}, ' e ') + 3)"
    ok = f"strpos({q}, ' e ') > 0 AND {words(left)} >= 2 AND {words(right)} >= 2"
    diff = f"'(?i)diferen[cç]a\\s+entre\\s+(.+?)\\s+e\\s+(.+)'"
    return (f"[{q}, {first_rule(q, fv.RULE_HINTS)}, CASE WHEN {ok} THEN {left} END, CASE WHEN {ok} THEN {right} END, "
            f"nullif(regexp_extract({q}, {diff}, 1), ''), nullif(regexp_extract({q}, {diff}, 2), ''), {first_rule(q, fv.ACRONYM_EXPANSIONS)}]")


def reformulation_list(q):
    stop = "[" + ", ".join(lit(w) for w in fv.REFORMULATION_STOPWORDS) + "]"
    ws = f"list_filter(string_split_regex(lower({q}), '\\s+'), lambda w: w <> '')"
    kept = f"list_filter({ws}, lambda w: length(w) >= 3 AND NOT list_contains({stop}, w))"
    dom = " OR ".join(f"contains(lower({q}), {lit(t.lower())})" for t in fv.DOMAIN_TERMS)
    return (f"[{q}, CASE WHEN NOT ({dom}) THEN {q} || ' {fv.DOMAIN_SUFFIX}' END, {first_rule(q, fv.REFORMULATION_EXPANSIONS)}, "
            f"CASE WHEN len({kept}) >= 2 AND len({kept}) <> len({ws}) THEN array_to_string({kept}, ' ') END]")


def unrolled(table, lists, keys="query_id"):
    """(keys, sub, texto): list items without NULLs and repeats, in order of first appearance."""
    return f"""
SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY mn) - 1 AS INTEGER) AS sub, texto FROM (
  SELECT {keys}, texto, min(i) AS mn FROM (SELECT {keys}, {strip('t')} AS texto, i FROM (
    SELECT {keys}, unnest(l) AS t, unnest(range(0, len(l))) AS i FROM (SELECT {keys}, {lists} AS l FROM {table})))
  WHERE texto <> '' GROUP BY {keys}, texto)"""


def year_of(q):
    return f"nullif(regexp_extract({q}, '\\b(20\\d{{2}})\\b', 1), '')"


def type_of(q):
    p, m = f"regexp_matches(lower({q}), '\\bportaria\\b')", f"regexp_matches(lower({q}), '\\bmanual\\b')"
    return (f"CASE WHEN regexp_matches(lower({q}), '\\b(anexo\\s+sigtap|tabela\\s+sigtap)\\b') THEN 'anexo_sigtap' "
            f"WHEN {p} AND NOT {m} THEN 'portaria' WHEN {m} AND NOT {p} THEN 'manual' END")


# --- claim texts, rules, answers --------------------------------------------------------
view("v_claim_texts", f"""
SELECT claim_id, 'Num AIH : ' || claim_id || '-' || claim_id % 10
  || CASE WHEN claim_id % 3 = 0 THEN chr(10) || 'Tipo: 1-NORMAL' ELSE chr(10) || 'Tipo: 5-LONGA PERMANENCIA' END
  || chr(10) || 'Procedimento principal : ' || substr(codigo_procedimento, 1, 2) || '.' || substr(codigo_procedimento, 3, 2) || '.'
  || substr(codigo_procedimento, 5, 2) || '.' || substr(codigo_procedimento, 7, 3) || '-' || substr(codigo_procedimento, 10, 1) || ' - PROC ' || codigo_procedimento
  || chr(10) || 'Diag. principal: ' || codigo_cid || ' - Doença do grupo ' || codigo_cid
  || CASE WHEN claim_id % 7 <> 0 THEN chr(10) || 'Especialidade : 01 - CIRURGIA  ' ELSE '' END
  || CASE WHEN claim_id % 5 <> 0 THEN chr(10) || 'Carater atendimento : 2 - URGENCIA' ELSE '' END
  || chr(10) || 'Mot saida: 12 - ALTA MELHORADO' || chr(10) || outro || ' x ' || outro || chr(10)
  || CASE WHEN claim_id % 4 <> 0 THEN 'CID SECUNDÁRIO' || chr(10) || a || ' ' || b || ' ' || a || chr(10) || 'MS-DATASUS' || chr(10) || 'Z999' ELSE '' END AS texto
FROM (SELECT *, '0' || (claim_id % 8 + 1) || {pad('claim_id % 100000000', 8)} AS outro, 'A' || {pad('claim_id % 1000', 3)} AS a,
  'A' || {pad('(claim_id + 1) % 1000', 3)} AS b FROM v_claims)""")


def field(pattern, group=1):
    p = lit(pattern)
    return f"CASE WHEN regexp_matches(texto, {p}) THEN {strip(f'regexp_extract(texto, {p}, {group})')} END"


view("v_claims_parsed", f"""
SELECT claim_id, {", ".join(f"{field(p)} AS {n}" for n, p in fv.CLAIM_FIELD_PATTERNS.items())},
  regexp_replace({field(fv.CLAIM_PROCEDURE_PATTERN)}, '[.\\-]', '', 'g') AS proc_codigo, {field(fv.CLAIM_PROCEDURE_PATTERN, 2)} AS proc_nome,
  {field(fv.CLAIM_DIAGNOSIS_PATTERN)} AS cid, {field(fv.CLAIM_DIAGNOSIS_PATTERN, 2)} AS cid_nome,
  list_distinct(regexp_extract_all(texto, {lit(fv.CLAIM_CODE_PATTERN)}, 1)) AS codigos,
  list_sort(list_distinct(regexp_extract_all(regexp_extract(texto, {lit('(?is)' + fv.CLAIM_SECONDARY_BLOCK)}, 1), {lit(fv.CLAIM_SECONDARY_CODE)}, 1))) AS cids
FROM v_claim_texts""")

KW = [*fv.RULE_NAME_ENRICHMENT, "outra regra"]
view("v_rules", f"""
SELECT p_partkey AS numero, '05' || {pad('p_partkey % 10000', 4)} AS codigo,
  [{", ".join(map(lit, KW))}][CAST(p_partkey % {len(KW)} AS INTEGER) + 1] || ' ' || p_name AS nome, p_type || '|idade' AS campos FROM part
UNION ALL SELECT p_partkey + 1000000000, '05' || {pad('(p_partkey + 1000000000) % 10000', 4)}, p_brand, p_type || '|idade' FROM part WHERE p_size % 2 = 0""")
view("v_rule_code", """
SELECT p_partkey AS text_id, ['const r = await rlProcedimentoCid(x); if (cbo) { leito }', 'calcularIdade(aih) // OPM permanencia',
  'quantidadeRealizada > 1 && DIARIA', 'return duplici + transfus', 'no keyword here'][CAST(p_partkey % 5 AS INTEGER) + 1] AS codigo_fonte, p_name AS nome FROM part""")

view("v_answers", """
SELECT answer_id, text || ' Conforme [Seção ' || ((k % 70) + 1) || '.' || (k % 7 + 1) || ', p. ' || (k % 50 + 1) || '] e seção '
  || ((k + 3) % 70 + 1) || '.' || ((k + 3) % 7 + 1) || ' (página ' || ((k + 4) % 50 + 1) || '), ver SECAO ' || ((k + 5) % 70 + 1) || '.' || ((k + 5) % 7 + 1) || '. '
  || CASE WHEN k % 3 = 0 THEN '[Secao ' || (k % 70 + 1) || '.' || (k % 7 + 1) || ',p' || (k % 50 + 1) || ']' ELSE '' END AS texto,
  CASE WHEN k % 4 = 0 THEN -1.0 ELSE (k % 10) / 10.0 END AS score_geral
FROM (SELECT conv_id * 100 + turn AS answer_id, conv_id * 100 + turn AS k, text FROM conversations WHERE role = 'assistant')""")
view("v_citations", """
SELECT DISTINCT answer_id, secao, pagina FROM (
SELECT answer_id, CAST((answer_id % 70) + 1 AS VARCHAR) || '.' || (answer_id % 7 + 1) AS secao, CAST(answer_id % 50 + 1 AS INTEGER) AS pagina FROM v_answers
UNION ALL SELECT answer_id, CAST((answer_id + 3) % 70 + 1 AS VARCHAR) || '.' || ((answer_id + 3) % 7 + 1), CAST((answer_id + 4) % 50 + 1 AS INTEGER) FROM v_answers
UNION ALL SELECT answer_id, CAST((answer_id + 5) % 70 + 1 AS VARCHAR) || '.' || ((answer_id + 5) % 7 + 1), NULL FROM v_answers)""")

# --- search ------------------------------------------------------------------------------
view("v_chunks", """
SELECT 'd' || doc_id AS id, doc_id, (doc_id % 60 + 1) || '.' || (doc_id % 7 + 1) AS secao, CAST(doc_id % 50 + 1 AS INTEGER) AS pagina, source AS fonte,
  CAST(doc_id % 10 + 2005 AS VARCHAR) AS ano, CASE WHEN doc_id % 2 = 0 THEN 'manual' ELSE 'portaria' END AS tipo, text,
  '[Manual ' || source || ']' || chr(10) || chr(10) || text AS contexto,
  CASE WHEN doc_id % 5 <> 0 THEN 'd' || (doc_id // 4 * 4) END AS parent_id,
  'Titulo ' || (doc_id % 60 + 1) || '.' || (doc_id % 7 + 1) AS titulo FROM documents""")
view("v_vectors", """
SELECT 'd' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(vec_id % 10 + 2005 AS VARCHAR) AS ano,
  CASE WHEN vec_id % 2 = 0 THEN 'manual' ELSE 'portaria' END AS tipo, label FROM embeddings""")
view("v_centroids", """
SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label""")
view("v_questions", """
SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'portaria sobre OPM e regras de ' || text WHEN 1 THEN text ELSE 'manual de 2010 ' || text END AS pergunta
FROM benchmark""")
view("v_doc_tokens", f"SELECT id, ano, tipo, {tokens('contexto')} AS toks FROM v_chunks")
view("v_tf", """
SELECT id, ano, tipo, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, ano, tipo, len(toks) AS dl, unnest(toks) AS term FROM v_doc_tokens) GROUP BY id, ano, tipo, term""")
view("v_corpus", "SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM v_doc_tokens")
view("v_terms_raw", """
SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM v_tf GROUP BY term), v_corpus""")
view("v_terms", """
SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM v_terms_raw""")


def bm25(questions, keys, filters=False):
    """Ranked BM25 candidates of a table (keys, texto[, f_ano, f_tipo])."""
    f = ("AND (q.f_ano IS NULL OR q.f_ano = t.ano) AND (q.f_tipo IS NULL OR q.f_tipo = t.tipo)" if filters else "")
    extra = ", f_ano, f_tipo" if filters else ""
    return f"""
SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, id) AS posicao FROM (
  SELECT {keys}, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM (SELECT {keys}{extra}, term, count(*) AS qtf FROM (SELECT {keys}{extra}, unnest({tokens('texto')}) AS term FROM {questions}) GROUP BY ALL) q
  JOIN v_tf t USING (term) JOIN v_terms USING (term), v_corpus WHERE true {f} GROUP BY {keys}, id) WHERE score > 0
QUALIFY posicao <= 20"""


def vector_top(questions, keys, n=20, filters=False):
    """Ranked cosine candidates of a table (keys, v[, f_ano, f_tipo])."""
    f = ("WHERE (q.f_ano IS NULL OR q.f_ano = d.ano) AND (q.f_tipo IS NULL OR q.f_tipo = d.tipo)" if filters else "")
    return f"""
SELECT {keys}, id, score, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, id) AS posicao FROM (
  SELECT {keys}, d.id, round(list_cosine_similarity(q.v, d.v), 12) AS score FROM {questions} q, v_vectors d {f}) QUALIFY posicao <= {n}"""


view("v_subs_text", unrolled("v_questions", sub_list("pergunta")))
view("v_subs", f"""
SELECT s.query_id, s.sub, s.texto, {year_of('pergunta')} AS f_ano, {type_of('pergunta')} AS f_tipo, c.v
FROM v_subs_text s JOIN v_questions q USING (query_id) JOIN v_centroids c ON c.label = length(s.texto) % 10""")
view("v_bm25", bm25("v_subs", "query_id, sub", True))
view("v_near", vector_top("v_subs", "query_id, sub", filters=True))
view("v_fused", """
SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rk)), 12) AS score FROM (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id, lista ORDER BY sub, score DESC, id) AS rk FROM (
    SELECT 'b' AS lista, query_id, sub, id, score FROM v_bm25 UNION ALL SELECT 'v', query_id, sub, id, score FROM v_near)) GROUP BY query_id, id""")


def rerank_of(q="query_id"):
    return f"(({q} * 31 + CAST(substr(id, 2) AS BIGINT) * 17) % 1000) / 1000.0::DOUBLE"


def hybrid(n=5, rerank=True):
    """The hybrid flow for long questions: pool, rerank, keep 2n, parents, known chunks, first n."""
    pool = max(20, 3 * n)
    score = rerank_of() if rerank else "score"
    join = "JOIN v_chunks USING (id)" if rerank else ""
    return f"""
SELECT query_id, id, score, CAST(posicao AS INTEGER) AS posicao FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS posicao FROM (
    SELECT query_id, coalesce(c.parent_id, k.id) AS id, max(score) AS score FROM (
      SELECT query_id, id, {score} AS score FROM (
        SELECT query_id, id, score FROM v_fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {pool}) {join}
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) <= {2 * n}) k
    LEFT JOIN v_chunks c ON c.id = k.id GROUP BY 1, 2)
  WHERE id IN (SELECT id FROM v_chunks)) WHERE posicao <= {n}"""


view("v_hybrid", hybrid(5))
view("v_hybrid10", hybrid(10))
view("v_qrels", """
WITH b AS (SELECT DISTINCT item_id, trim(unnest(string_split_regex(text, '[.\\n]+'))) AS s FROM benchmark),
d AS (SELECT DISTINCT doc_id, trim(unnest(string_split_regex(text, '[.\\n]+'))) AS s FROM documents)
SELECT DISTINCT item_id AS query_id, (doc_id % 60 + 1) || '.' || (doc_id % 7 + 1) AS secao FROM b JOIN d USING (s) WHERE length(s) >= 20""")
