"""Fixed values of the domain.

Everything in this module is data that results depend on: word lists, lookup
tables, thresholds, text patterns and message formats. They are written out
plainly and kept in one place; the code that uses them lives elsewhere.
"""

# --- fixed values: tokeniser -------------------------------------------------
STOPWORDS_PT = (
    "a o e de do da dos das em no na nos nas um uma uns umas para por com como "
    "que se ou ao aos as os seu sua seus suas este esta esse essa isso isto "
    "aquele aquela ser ter estar foi sao nao mais muito bem ja so entre ate "
    "sobre quando qual quais cada todo toda todos todas pode deve tambem mesmo "
    "ainda pela pelo pelos pelas num numa"
).split()

MIN_TOKEN_CHARS = 2

# shorter list, used when a weak question is reformulated
REFORMULATION_STOPWORDS = (
    "a o e de do da dos das em no na nos nas um uma uns umas para por com como "
    "que se ou ao aos as os seu sua seus suas qual quais"
).split()

# --- fixed values: question hints and expansions ------------------------------
RULE_HINTS = {
    "critica 7": "procedimento principal incompativel com diagnostico principal CID compatibilidade",
    "critica 12": "diagnostico principal incompativel com sexo do paciente",
    "critica 13": "procedimento principal incompativel com idade do paciente",
    "critica 14": "sexo do paciente incompativel com procedimento principal",
    "critica 15": "procedimento principal nao permite permanencia",
    "050009": "numero da AIH nao informado",
    "050046": "procedimento principal incompativel com diagnostico principal",
    "050081": "diagnostico principal incompativel com sexo",
    "050083": "procedimento incompativel com idade",
    "050084": "sexo incompativel com procedimento",
    "050097": "procedimento nao permite permanencia",
}

ACRONYM_EXPANSIONS = {
    "opm": "orteses proteses materiais especiais OPM",
    "cid": "classificacao internacional doencas CID diagnostico",
    "cbo": "classificacao brasileira ocupacoes CBO profissional",
    "cnes": "cadastro nacional estabelecimentos saude CNES",
    "uti": "unidade terapia intensiva UTI leito",
    "aih": "autorizacao internacao hospitalar AIH",
}

REFORMULATION_EXPANSIONS = {
    "opm": "orteses proteses materiais especiais",
    "cid": "classificacao internacional doencas diagnostico",
    "cbo": "classificacao brasileira ocupacoes profissional",
    "cnes": "cadastro nacional estabelecimentos saude",
    "uti": "unidade terapia intensiva",
    "aih": "autorizacao internacao hospitalar",
}

DOMAIN_TERMS = ["SIH", "SUS", "manual", "AIH", "internacao"]
DOMAIN_SUFFIX = "SIH/SUS regras manual"

PROCEDURE_GROUPS = {
    "01": "acoes de promocao e prevencao",
    "02": "procedimentos diagnosticos (exames)",
    "03": "procedimentos clinicos (consultas, fisioterapia)",
    "04": "procedimentos cirurgicos",
    "05": "transplantes de orgaos tecidos e celulas",
    "06": "medicamentos",
    "07": "orteses proteses e materiais especiais (OPM)",
    "08": "acoes complementares (UTI, diarias)",
}

# --- fixed values: rule enrichment and rule-source keywords --------------------
# The first keyword found in the rule name wins.
RULE_NAME_ENRICHMENT = {
    "incompatível com diagnóstico": "compatibilidade CID procedimento SIGTAP",
    "incompatível com sexo": "sexo paciente compatibilidade procedimento diagnóstico",
    "incompatível com idade": "idade paciente compatibilidade procedimento faixa etária",
    "permanência": "dias permanência média diárias SIGTAP",
    "duplicidade": "duplicidade AIH mesmo paciente reinternação 03 dias",
    "AIH não informado": "número AIH numeração emissão",
    "data da saída": "data saída internação alta competência",
    "data da internação": "data internação autorização emissão AIH",
    "procedimento solicitado": "procedimento solicitado realizado mudança",
    "procedimento realizado": "procedimento principal realizado SIGTAP",
    "CNS": "cartão nacional saúde CNS paciente",
    "CBO": "classificação brasileira ocupações CBO médico CNES",
    "OPM": "órteses próteses materiais especiais OPM compatibilidade",
    "leito": "especialidade leito CNES cadastro",
    "diária": "diária acompanhante UTI UCI permanência",
    "anestesia": "anestesia regional geral sedação cirurgião",
    "hemoterapia": "hemoterapia transfusão sangue agência",
    "transplante": "transplante órgãos doação retirada",
    "politraumatizado": "politraumatizado cirurgia múltipla tratamento",
    "obstetrícia": "obstetrícia parto cesariana gestante",
    "recém-nascido": "recém-nascido RN parto pediatria",
    "habilitação": "habilitação estabelecimento CNES",
    "autorizador": "profissional autorizador solicitante executante",
    "diretor clínico": "diretor clínico assinatura responsável",
    "município": "município UF endereço paciente IBGE",
    "raça": "raça cor etnia indígena",
    "caráter": "caráter atendimento eletivo urgência",
    "mudança": "mudança procedimento clínica cirurgia",
}

# (search terms, words matched as written, words matched in any case)
SOURCE_KEYWORD_TERMS = [
    ("fisioterapia atendimento fisioterapeutico quantidade maxima por dia internacao",
     ["PROCEDIMENTOS_FISIOTERAPIA"], []),
    ("dias de internacao permanencia calculo por competencia",
     ["calcularDiasInternacao"], []),
    ("compatibilidade CID diagnostico procedimento SIGTAP CID-10",
     ["rlProcedimentoCid"], []),
    # "sexoPaciente" and the other mixed-case words in the last column are
    # compared with lowered source text, so they never match; kept as they are.
    ("sexo paciente incompativel procedimento diagnostico",
     ["rlProcedimentoSexo"], ["sexoPaciente"]),
    ("idade paciente minima maxima procedimento faixa etaria",
     ["idadeMinima", "idadeMaxima", "calcularIdade"], []),
    ("media permanencia dias SIGTAP liberacao critica",
     [], ["permanencia", "mediaPermanencia"]),
    ("duplicidade AIH mesmo paciente reinternacao 03 dias bloqueio",
     [], ["duplici"]),
    ("OPM orteses proteses materiais especiais compatibilidade quantidade",
     ["OPM"], ["opm"]),
    ("CBO classificacao brasileira ocupacoes medico profissional CNES",
     [], ["cbo"]),
    ("CNES cadastro nacional estabelecimentos habilitacao",
     [], ["cnes"]),
    ("anestesia regional geral sedacao cirurgiao obstetrica",
     [], ["anestesia"]),
    ("hemoterapia transfusao sangue agencia transfusional",
     [], ["hemoterapia", "transfus"]),
    ("especialidade leito UTI UCI CNES cadastro",
     [], ["leito"]),
    ("diaria acompanhante idoso gestante UTI",
     [], ["acompanhante", "diaria"]),
    ("transplante orgaos doacao retirada intercorrencia",
     [], ["transplante"]),
    ("politraumatizado cirurgia multipla tratamento",
     [], ["politraumatizado", "cirurgiaMultipla"]),
    ("motivo apresentacao alta permanencia transferencia obito",
     ["motivoSaida"], ["motivoApresentacao"]),
    ("quantidade maxima procedimentos AIH limite SIGTAP",
     ["quantidadeRealizada"], ["quantidadeMaxima"]),
    ("competencia execucao processamento apresentacao AIH",
     [], ["competencia"]),
]

# --- fixed values: document layout --------------------------------------------
CORPUS_EXTENSIONS = ["pdf", "htm", "html", "doc", "zip"]
ANNEX_PAGE_CAP = 10
HTML_CHAR_CAP = 50000
HTML_CAP_MARKER = "\n\n[... conteudo truncado ...]"
MIN_DOCUMENT_CHARS = 50
MIN_PARAGRAPH_CHARS = 20
PREAMBLE_AFTER_PAGE = 8
TOC_DOTS_PER_PAGE = 5
CLASSIFY_PAGES = 10
#: Secondary diagnoses that a claim's question names.
QUESTION_SECONDARIES = 4
MIN_MANUAL_MARKERS = 2
SOURCE_NAME_CHARS = 60

MANUAL_MARKERS = [
    "SISTEMA DE INFORMAÇÃO HOSPITALAR",
    "MANUAL TÉCNICO OPERACIONAL",
    "SIH/SUS",
    "AIH",
]
RUNNING_HEADERS = ["MANUAL TÉCNICO OPERACIONAL", "SISTEMA DE INFORMAÇÃO HOSPITALAR"]
RUNNING_DATE_LINE = "SETEMBRO 2012"
ANNEX_NAME_MARKERS = ["anexo", "relatorio_grupo", "relatorio_analitico"]
SOURCE_NAME_NOISE = "╓╟αΘσ"
PREAMBLE_NUMBER = "0"
PREAMBLE_TITLE = "PREÂMBULO"

MANUAL_2017 = "Manual SIH/SUS 2017"
MANUAL_SIA = "Manual SIA/SUS"
MANUAL_2012 = "Manual SIH/SUS 2012"

UPPER_LETTERS = "A-ZÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ"
SECTION_NUMBER = r"\d{1,2}(?:\.\d{1,2})?(?:\.\d{1,2})?"

FLAT_CHUNK_CHARS = 1500
PARENT_CHUNK_CHARS = 3000
CHILD_CHUNK_CHARS = 500
OVERLAP_CHARS = 200
PARENT_SNIPPET_CHARS = 200

# --- fixed values: retrieval ---------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
BM25_NEGATIVE_IDF_SHARE = 0.25
RRF_K = 60
CANDIDATES_PER_RETRIEVER = 20
MIN_RERANK_POOL = 20
KEEP_RELEVANCE = 0.35
RETRY_RELEVANCE = 0.40
CONTEXT_MARK = "[Manual"
CONTEXT_END = "]\n\n"
TRUNCATION_MARK = "\n[...truncado]"
ORIGIN_QUERY_CHARS = 60
WARN_LOW = ("[AVISO: Resultados de baixa relevancia (melhor score: %d%%). "
            "A informacao pode ser imprecisa ou incompleta.]")
WARN_FEW = "[AVISO: Poucos trechos relevantes encontrados para esta consulta.]"

# --- fixed values: claim mirror fields ------------------------------------------
CLAIM_FIELD_PATTERNS = {
    "num_aih": r"Num\s+AIH\s*:\s*([\d-]+)",
    "tipo": r"Tipo\s*:\s*\d+-(\S+)",
    "especialidade": r"[Ee]specialidade\s*:\s*\d+\s*-\s*(.+)",
    "carater": r"[Cc]arater\s+atendimento\s*:\s*\d+\s*-\s*(.+)",
    "motivo_saida": r"[Mm]ot\s*saida\s*:\s*\d+\s*-\s*(.+)",
}
CLAIM_PROCEDURE_PATTERN = r"[Pp]rocedimento\s+principal\s*:\s*([\d.]+\d-\d)\s*-\s*(.+)"
CLAIM_DIAGNOSIS_PATTERN = r"[Dd]iag\.\s*principal\s*:\s*([A-Z]\d{2,4})\s*-?\s*(.*)"
CLAIM_CODE_PATTERN = r"\b(0[1-8]\d{8})\b"
CLAIM_SECONDARY_BLOCK = r"CID\s+SECUND[ÁA]RIO(.*?)(?:CNPJ\s+Fabricante|MS-DATASUS|$)"
CLAIM_SECONDARY_CODE = r"\b([A-Z]\d{3})\b"

RULE_DEFINITION_PATTERN = (
    r"CRITICA_(\d+):\s*\{\s*codigo:\s*'(\d+)'\s*,\s*nome:\s*'([^']+)'\s*,"
    r"\s*campos:\s*\[([^\]]*)\]"
)

# --- fixed values: citations in answers -----------------------------------------
CITATION_PATTERNS = [
    r"\[Se[cç][aã]o\s+(\d+(?:\.\d+)*)\s*,\s*p\.?\s*(\d+)\]",
    r"Se[cç][aã]o\s+(\d+(?:\.\d+)*)\s*(?:,\s*|\()p[aá]gina\s+(\d+)\)?",
    r"Se[cç][aã]o\s+(\d+(?:\.\d+)*)",
]
SUPPORTED, INFERRED, UNSUPPORTED = "fundamentado", "inferencia", "sem_fonte"
MIN_GROUNDING_SCORE = 0.5
MAX_UNSUPPORTED_SHARE = 0.3

# --- fixed values: claim queries and audit messages -------------------------------
CLAIM_QUERY_FORMATS = {
    "procedure": "procedimento principal %s AIH regras",
    "diagnosis": "diagnostico %s %s compatibilidade procedimento CID",
    "pair": "compatibilidade %s com %s %s",
    "specialty": "especialidade %s AIH regras validacao internacao",
    "admission": "carater atendimento %s AIH regras",
    "discharge": "motivo saida %s AIH regras",
    "group": "procedimentos %s grupo %s SIGTAP AIH regras quantidade limite",
    "secondary": "CID secundario %s causas externas politraumatismo",
}

ALERT_FORMATS = {
    "procedimento": "Procedimento %s inexistente na competencia %s.",
    "cid": "CID %s NAO e permitido para o procedimento %s.",
    "sexo": "CID %s restrito ao sexo '%s', paciente e '%s'.",
    "idade": "Idade %s fora da faixa permitida (%s-%s).",
    "habilitacao": "CNES %s sem habilitacoes exigidas: %s.",
    "servico": "CNES %s sem servicos exigidos.",
    "leito": "CNES %s sem tipos de leito exigidos: %s.",
    "ocupacao_executante": "CBO %s nao autorizado. Permitidos: %s.",
    "compatibilidade_secundario": "Secundario %s incompativel com %s.",
}
DIAGNOSIS_NOT_FOUND = "CID nao encontrado"
AGE_UNBOUNDED = 999
