"""The engine's domain tables, derived from the TPC-H-like test tables.

Orders become claims, parts procedures, suppliers facilities, documents the
corpus. ``plans.oracle_views`` states the same derivations in SQL.
"""

from functools import cached_property

from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv
from claimlens.functions.codes import pad_code
from claimlens.functions.text import fold
from claimlens.operators.catalog import growing
from claimlens.operators.vector import centroids
from claimlens.sources import corpus
from claimlens.sources.schemas import MONTH

M1, M2 = "202401", "202402"


def _proc(key):
    return pad_code(key, 9)


def _cnes(key):
    return pad_code(key, 7)


def _hab(key):
    return pad_code(key, 2)


class Bound:
    """Lazily derived tables for one data folder."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir, self._read = spark, sf_dir, {}

    TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}

    def raw(self, name):
        if name not in self._read:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            self._read[name] = corpus.spread(df, self.TEXT_KEYS[name]) if name in self.TEXT_KEYS else df
        return self._read[name]

    def stream_path(self, name):
        """A table as the path of a file stream, be it one file or a folder of files: a pattern
        that matches both, as a stream takes no single file."""
        return f"{self.dir}/{name}.parque[t]"

    def table(self, name):
        return getattr(self, name)

    def __getitem__(self, name):
        return getattr(self, name)

    def _both_months(self, df):
        """The same rows in both months (one pass over the input)."""
        return df.withColumn(MONTH, F.explode(F.array(F.lit(M1), F.lit(M2))))

    # --- claims -----------------------------------------------------------------
    @cached_property
    def order_parts(self):
        """Number of lines per order and part."""
        return self.raw("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n_lines"))

    @cached_property
    def first_lines(self):
        """The first line of every order in full column order (combines on the map side)."""
        first = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                         "l_shipdate", "l_returnflag")
        return self.raw("lineitem").groupBy("l_orderkey").agg(F.min(first).alias("first"))

    def claims_from(self, orders):
        """Claims for a batch (or stream) of orders."""
        lines = self.first_lines
        return (
            orders.join(growing(lines), orders.o_orderkey == lines.l_orderkey)
            .select(
                F.col("o_orderkey").alias("claim_id"),
                F.concat(F.lit("0"), _proc("first.l_partkey")).alias("codigo_procedimento"),
                F.concat("first.l_returnflag", pad_code("first.l_linenumber", 2)).alias("codigo_cid"),
                _cnes("first.l_suppkey").alias("codigo_cnes"),
                F.substring("o_orderpriority", 1, 1).alias("co_ocupacao_executante"),
                F.when(F.col("o_custkey") % 2 == 0, "M").otherwise("F").alias("sexo_paciente"),
                (F.col("o_custkey") % 90).cast("int").alias("idade_paciente"),
            )
        )

    @cached_property
    def claims(self):
        return self.claims_from(self.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority"))

    @cached_property
    def claim_secondaries(self):
        """Parts of the lines after the first; the first line's part only if repeated."""
        op, fl = self.order_parts, self.first_lines
        return (
            op.join(growing(fl.withColumnRenamed("first", "f")), "l_orderkey")
            .join(growing(self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
            .where((F.col("l_partkey") != F.col("f.l_partkey")) | (F.col("n_lines") > 1))
            .select(F.col("l_orderkey").alias("claim_id"),
                    F.concat(F.lit("0"), _proc("l_partkey")).alias("co_secundario"))
        )

    # --- catalog ----------------------------------------------------------------
    @cached_property
    def tb_procedimento(self):
        p = self._dealt_parts
        base = F.col("p_retailprice").cast("decimal(14,2)")
        rows = self._both_months(p).where(
            ((F.col(MONTH) == M1) & (F.col("p_partkey") % 20 != 0))
            | ((F.col(MONTH) == M2) & (F.col("p_partkey") % 20 != 1)))
        factor = F.when((F.col(MONTH) == M2) & (F.col("p_partkey") % 7 == 0),
                        F.lit("1.10").cast("decimal(3,2)")).otherwise(F.lit("1.00").cast("decimal(3,2)"))
        name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Ação "), F.col("p_name"))).otherwise(F.col("p_name"))
        dec = lambda c: c.cast("decimal(14,2)").cast("string")
        return rows.select(
            _proc("p_partkey").alias("co_procedimento"),
            name.alias("no_procedimento"),
            (F.col("p_size") % 3).cast("string").alias("tp_complexidade"),
            F.lit("I").alias("tp_sexo"),
            (F.col("p_size") % 4 + 1).cast("string").alias("qt_maxima_execucao"),
            (F.col("p_size") % 12).cast("string").alias("qt_dias_permanencia"),
            F.lit("0").alias("qt_pontos"),
            (F.col("p_size") % 20).cast("string").alias("vl_idade_minima"),
            (F.col("p_size") % 20 + 60).cast("string").alias("vl_idade_maxima"),
            dec(base * factor).alias("vl_sh"),
            dec(base * F.lit("0.10").cast("decimal(3,2)")).alias("vl_sa"),
            dec(base * F.lit("0.25").cast("decimal(3,2)")).alias("vl_sp"),
            F.lit("01").alias("co_financiamento"),
            F.lit("").alias("co_rubrica"),
            F.lit("").alias("qt_tempo_permanencia"),
            dec(base * F.lit("1.25").cast("decimal(3,2)")).alias("vl_total_hospitalar"),
            fold(name).alias("no_procedimento_normalizado"),
            MONTH,
        )

    @cached_property
    def tb_descricao(self):
        text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
        return self._both_months(self.raw("part").select(
            _proc("p_partkey").alias("co_procedimento"), text.alias("ds_procedimento"),
            fold(text).alias("ds_procedimento_normalizada")))

    def _nation_domain(self, code, name, below=None, width=2):
        n = self.raw("nation")
        n = n.where(F.col("n_nationkey") < below) if below else n
        return self._both_months(n.select(pad_code("n_nationkey", width).alias(code), F.col("n_name").alias(name)))

    @cached_property
    def tb_cid(self):
        n, k = self.raw("nation").where("n_nationkey < 21"), F.col("n_nationkey")
        letter = F.element_at(F.array(*map(F.lit, "ANR")), (k / 7).cast("int") + 1)
        number = k % 7 + 1
        sex = F.element_at(F.array(*map(F.lit, "IFM")), (k / 7).cast("int") + 1)
        return self._both_months(n.select(
            F.concat(letter, pad_code(number, 2)).alias("co_cid"),
            F.concat(F.lit("Doença "), F.col("n_name")).alias("no_cid"),
            F.lit("0").alias("tp_agravo"), sex.alias("tp_sexo"),
            F.lit("").alias("tp_estadio"), F.lit("").alias("vl_campos_irradiados")))

    @cached_property
    def tb_habilitacao(self):
        return self._nation_domain("co_habilitacao", "no_habilitacao")

    @cached_property
    def tb_grupo_habilitacao(self):
        # every second group has a row, so that name lookups also miss
        n = self.raw("nation").where("n_nationkey % 2 = 0")
        return self._both_months(n.select(
            _hab("n_nationkey").alias("nu_grupo_habilitacao"),
            F.col("n_name").alias("no_grupo_habilitacao"),
            F.concat(F.lit("regiao "), F.col("n_regionkey")).alias("ds_grupo_habilitacao")))

    @cached_property
    def tb_servico(self):
        return self._nation_domain("co_servico", "no_servico", below=10, width=3)

    @cached_property
    def tb_servico_classificacao(self):
        n = self.raw("nation").where("n_nationkey < 10")
        cls = F.explode(F.array(F.lit("000"), F.lit("001"), F.lit(None).cast("string"))).alias("co_classificacao")
        return self._both_months(
            n.select(pad_code("n_nationkey", 3).alias("co_servico"), cls, "n_name")
            .select("co_servico", "co_classificacao",
                    F.concat_ws(" ", "n_name", F.coalesce("co_classificacao", F.lit("geral"))).alias("no_classificacao")))

    @cached_property
    def tb_tipo_leito(self):
        return self._nation_domain("co_tipo_leito", "no_tipo_leito", below=6)

    @cached_property
    def tb_ocupacao(self):
        return self._both_months(self.raw("region").select(
            (F.col("r_regionkey") + 1).cast("string").alias("co_ocupacao"), F.col("r_name").alias("no_ocupacao")))

    @cached_property
    def tb_regra_condicionada(self):
        n = self.raw("nation").where("n_nationkey < 4")
        return self._both_months(n.select(
            pad_code("n_nationkey", 4).alias("co_regra_condicionada"),
            F.col("n_name").alias("no_regra_condicionada"),
            F.concat(F.lit("regra da regiao "), F.col("n_regionkey")).alias("ds_regra_condicionada")))

    @cached_property
    def tb_grupo(self):
        return self._both_months(self.raw("region").select(
            pad_code("r_regionkey", 2).alias("co_grupo"), F.col("r_name").alias("no_grupo")))

    @cached_property
    def tb_sub_grupo(self):
        return self._both_months(self.raw("nation").select(
            pad_code("n_regionkey", 2).alias("co_grupo"), pad_code("n_nationkey", 2).alias("co_sub_grupo"),
            F.col("n_name").alias("no_sub_grupo")))

    @cached_property
    def tb_forma_organizacao(self):
        s, n = self.raw("supplier"), self.raw("nation")
        return self._both_months(s.join(n, s.s_nationkey == n.n_nationkey).select(
            pad_code("n_regionkey", 2).alias("co_grupo"), pad_code("n_nationkey", 2).alias("co_sub_grupo"),
            _cnes("s_suppkey").alias("co_forma_organizacao"), F.col("s_name").alias("no_forma_organizacao")))

    # --- catalog relations ---------------------------------------------------------
    @cached_property
    def _dealt_parts(self):
        """Parts dealt over all shuffle partitions: a part becomes up to 42 rows, and a scan of
        the small file puts them in few tasks, whose aggregates would hold them all."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.raw("part").repartition(n, "p_partkey")

    @cached_property
    def rl_procedimento_cid(self):
        grid = F.explode(F.expr(
            "flatten(transform(array('A','N','R'), l -> transform(sequence(1,7), n -> struct(l, n))))")).alias("d")
        k, n = F.col("p_partkey"), F.col("d.n")
        alt = (F.col(MONTH) == M2) & (k % 10 == 0)
        return (
            self._both_months(self._dealt_parts.select("p_partkey", grid))
            .where(F.when(alt, (k + n) % 4 != 0).otherwise((k + n) % 3 != 0))
            .select(_proc("p_partkey").alias("co_procedimento"),
                    F.concat("d.l", pad_code("d.n", 2)).alias("co_cid"),
                    F.when(n <= 3, "S").otherwise("N").alias("st_principal"), MONTH)
        )

    @cached_property
    def rl_procedimento_habilitacao(self):
        brand = F.substring_index("p_brand", "#", -1).cast("int") - 1
        p = self._both_months(self._dealt_parts.where("p_size % 2 = 0"))
        drop = (F.col(MONTH) == M2) & (F.col("p_partkey") % 11 == 0)
        codes = F.when(drop, F.array(brand)).otherwise(F.array_distinct(F.array(brand, F.col("p_size") % 25)))
        return p.select(_proc("p_partkey").alias("co_procedimento"), F.explode(codes).alias("h"), MONTH).select(
            "co_procedimento", _hab("h").alias("co_habilitacao"), _hab("h").alias("nu_grupo_habilitacao"), MONTH)

    @cached_property
    def rl_procedimento_servico(self):
        p = self._both_months(self._dealt_parts.where("p_size % 5 = 0"))
        shift = F.when((F.col(MONTH) == M2) & (F.col("p_partkey") % 13 == 0), 1).otherwise(0)
        return p.select(_proc("p_partkey").alias("co_procedimento"),
                        pad_code(F.col("p_size") % 10, 3).alias("co_servico"),
                        self._service_class((F.col("p_partkey") % 3 + shift) % 3), MONTH)

    @staticmethod
    def _service_class(n):
        """Class 2 is stored as NULL, so that null-safe matching is exercised."""
        return F.when(n != 2, pad_code(n, 3)).alias("co_classificacao")

    @cached_property
    def rl_procedimento_leito(self):
        return self._both_months(self.raw("part").where("p_size % 4 = 0").select(
            _proc("p_partkey").alias("co_procedimento"), pad_code(F.col("p_partkey") % 6, 2).alias("co_tipo_leito")))

    @cached_property
    def rl_procedimento_ocupacao(self):
        k = F.col("p_partkey")
        codes = F.explode(F.array_distinct(F.array(
            (k % 5 + 1).cast("string"), ((k + 2) % 5 + 1).cast("string")))).alias("co_ocupacao")
        return self._both_months(self.raw("part").where("p_partkey % 3 = 0").select(
            _proc("p_partkey").alias("co_procedimento"), codes))

    @cached_property
    def rl_procedimento_compativel(self):
        op, fl = self.order_parts, self.first_lines
        pairs = (
            op.join(growing(fl.withColumnRenamed("first", "f")), "l_orderkey")
            .where((F.col("l_partkey") != F.col("f.l_partkey"))
                   & ((F.col("l_partkey") + F.col("f.l_partkey")) % 2 == 0))
            .select(F.col("f.l_partkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
        )
        return self._both_months(pairs.select(
            _proc("a").alias("co_procedimento_principal"), F.lit("03").alias("co_registro_principal"),
            _proc("b").alias("co_procedimento_compativel"), F.lit("03").alias("co_registro_compativel"),
            F.lit("1").alias("tp_compatibilidade"), F.lit("1").alias("qt_permitida")))

    @cached_property
    def rl_procedimento_incremento(self):
        p = self.raw("part").where("p_partkey % 5 = 0")
        dec = lambda e: F.expr(e).cast("decimal(7,2)").cast("string")
        return self._both_months(p.select(
            _proc("p_partkey").alias("co_procedimento"), _hab(F.col("p_partkey") % 25).alias("co_habilitacao"),
            dec("(p_size % 10) * 5").alias("vl_percentual_sh"), dec("p_size % 4").alias("vl_percentual_sa"),
            dec("(p_size % 6) * 2.5").alias("vl_percentual_sp")))

    @cached_property
    def rl_procedimento_regra_cond(self):
        return self._both_months(self.raw("part").where("p_partkey % 6 = 0").select(
            _proc("p_partkey").alias("co_procedimento"),
            pad_code(F.col("p_size") % 5, 4).alias("co_regra_condicionada")))

    # --- facilities ------------------------------------------------------------------
    def _facility_months(self, df):
        """Month 1 lacks the facilities whose key ends in 3."""
        return self._both_months(df).where((F.col(MONTH) == M2) | (F.col("k") % 10 != 3))

    @cached_property
    def tb_habilitacao_cnes(self):
        s = self._facility_months(self.raw("supplier").withColumn("k", F.col("s_suppkey")))
        return s.select(_cnes("k").alias("cnes"), _hab("s_nationkey").alias("cod_sub_grupo_habilitacao"), MONTH)

    @cached_property
    def tb_servico_cnes(self):
        s = self.raw("supplier").select(F.col("s_suppkey").alias("k"))
        s = s.withColumn("v", F.explode(F.array_distinct(F.array(F.col("k") % 10, (F.col("k") * 7) % 10))))
        return self._facility_months(s).select(
            _cnes("k").alias("cnes"), pad_code("v", 3).alias("co_servico"),
            self._service_class(F.col("k") % 3), F.lit("1").alias("tp_caracteristica"),
            F.lit("").alias("co_cnpjcpf"), MONTH)

    @cached_property
    def tb_leito_cnes(self):
        s = self.raw("supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
        q = (F.col("k") * (F.col("j") + 1)) % 20
        return self._facility_months(s).select(
            _cnes("k").alias("cnes"), pad_code(F.col("j") + 1, 2).alias("co_leito"),
            pad_code((F.col("k") + F.col("j")) % 6, 2).alias("co_tipo_leito"),
            F.when(q % 7 == 0, "").otherwise(q.cast("string")).alias("quantidade_sus"), MONTH)

    @cached_property
    def _staff(self):
        li, o = self.raw("lineitem"), self.raw("orders")
        return li.join(growing(o), li.l_orderkey == o.o_orderkey).select(
            F.col("l_suppkey").alias("k"), F.substring("o_orderpriority", 1, 1).alias("cbo"),
            F.col("o_custkey").alias("c")).distinct()

    @cached_property
    def tb_profissional_cnes(self):
        hours = F.when(F.col("c") % 5 != 0, (F.col("c") % 40).cast("string"))
        return self._staff.select(
            _cnes("k").alias("cnes"), F.col("cbo").alias("co_ocupacao"),
            F.col("c").cast("string").alias("co_profissional_sus"), F.lit("1").alias("co_vinculacao"),
            F.lit(None).cast("string").alias("qt_vinculos_publicos_profissional"),
            hours.alias("qt_carga_horaria_total_profissional"), F.lit(M2).alias(MONTH))

    @cached_property
    def tb_dados_profissionais_cnes(self):
        return self._staff.select("k", "c").distinct().select(
            _cnes("k").alias("cnes"), F.col("c").cast("string").alias("co_profissional_sus"),
            pad_code("c", 11).alias("co_cpf"), pad_code("c", 15).alias("co_cns"), F.lit(M2).alias(MONTH))

    # --- documents ---------------------------------------------------------------------
    PAGE_LINES = 10

    @cached_property
    def files(self):
        """Documents as files: a path, its attributes, and pages of ten lines with headings."""
        k = F.col("doc_id")
        cs = F.concat
        s = lambda c: c.cast("string")
        year = F.when(k % 7 != 0, s(k % 20 + 2005)).otherwise("")
        folder = F.element_at(F.array(*map(F.lit, ["portaria", "manuais", "outros"])), (k % 3).cast("int") + 1)
        stem = F.when(k % 5 == 0, "Anexo_I-").when(k % 5 == 1, "manual_sih_").when(k % 5 == 2, "SIA-").otherwise("texto__")
        path = cs(F.lit("corpus/"), folder, year, F.lit("/"), "source", F.lit("/"), stem, s(k), F.lit(".pdf"))
        lines = F.split("text", "\n")

        def extra(p):
            n = (k + p) % 5
            return (
                F.when(n == 0, cs(s(p), F.lit("."), s(k % 9 + 1), F.lit(" CAPÍTULO DE REGRAS gerais\n")))
                .when(n == 1, cs(s(p), F.lit("\nTÍTULO DA SEÇÃO (OPM)\n")))
                .when(n == 2, cs(F.lit("MANUAL TÉCNICO OPERACIONAL - SIH/SUS\n"), s(p), F.lit("\n")))
                .when((n == 3) & (k % 4 == 0), F.repeat(F.lit("Item ...... 1\n"), F.lit(3)))
                .otherwise(""))

        per = self.PAGE_LINES
        last = F.ceil(F.size("lines") / per).cast("int")
        pages = F.transform(F.sequence(F.lit(1), last), lambda p: F.struct(
            p.alias("pagina"),
            cs(extra(p), F.array_join(F.slice("lines", (p - 1) * per + 1, F.lit(per)), "\n")).alias("texto")))
        d = self.raw("documents").select("doc_id", "source", lines.alias("lines"), path.alias("path"))
        return corpus.with_path_attributes(d.select("doc_id", "path", pages.alias("pages")))

    @cached_property
    def chunks(self):
        """Search chunks: one per document."""
        k = F.col("doc_id")
        prefix = F.concat(F.lit("[Manual "), "source", F.lit("]\n\n"))
        secao = F.concat_ws(".", k % 60 + 1, k % 7 + 1)
        return self.raw("documents").select(
            F.concat(F.lit("d"), k).alias("id"), secao.alias("secao"),
            F.concat(F.lit(" Titulo "), secao, F.lit("\nresto")).alias("titulo"),
            (k % 50 + 1).cast("int").alias("pagina"), F.col("source").alias("fonte"),
            self._year(k), self._kind(k),
            F.when(k % 2 == 0, F.concat(prefix, "text")).otherwise(F.col("text")).alias("texto"),
            F.concat(prefix, "text").alias("contexto"), F.lit(False).alias("is_parent"),
            F.when(k % 5 != 0, F.concat(F.lit("d"), F.floor(k / 4) * 4)).alias("parent_id"))

    @staticmethod
    def _year(k):
        return (k % 10 + 2005).cast("string").alias("ano")

    @staticmethod
    def _kind(k):
        return F.when(k % 2 == 0, "manual").otherwise("portaria").alias("tipo")

    @cached_property
    def parent_map(self):
        return self.chunks.where(F.col("parent_id").isNotNull()).select("id", "parent_id")

    @cached_property
    def vectors(self):
        k = F.col("vec_id")
        return self.raw("embeddings").select(
            F.concat(F.lit("d"), k).alias("id"), "embedding", self._year(k), self._kind(k), "label")

    @cached_property
    def label_centroids(self):
        return centroids(self.raw("embeddings"), "label")

    def embed(self, questions):
        """Stand-in for an embedding model: the length of a question picks a label's centroid."""
        return questions.withColumn("_label", F.length("pergunta") % 10).join(
            self.label_centroids.withColumnRenamed("label", "_label"), "_label").drop("_label")

    @staticmethod
    def rerank_scores(candidates):
        """Stand-in for a reranker: a fixed function of question and chunk."""
        n = F.col("query_id") * 31 + F.expr("cast(substring(id, 2) as bigint)") * 17
        return candidates.withColumn("rerank", (n % 1000) / 1000.0)

    @cached_property
    def questions(self):
        k = F.col("item_id")
        q = (F.when(k % 3 == 0, F.concat(F.lit("portaria sobre OPM e regras de "), "text"))
             .when(k % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("manual de 2010 "), "text")))
        return self.raw("benchmark").select(k.alias("query_id"), q.alias("pergunta"))

    @cached_property
    def qrels(self):
        """Sections of documents that share a sentence of at least 20 characters with the question."""
        sent = lambda df, key: df.select(key, F.explode(F.split("text", r"[.\n]+")).alias("s")).select(
            key, F.trim("s").alias("s")).where(F.length("s") >= 20).distinct()
        b, d = sent(self.raw("benchmark"), "item_id"), sent(self.raw("documents"), "doc_id")
        return b.join(d, "s").select(
            F.col("item_id").alias("query_id"),
            F.concat_ws(".", F.col("doc_id") % 60 + 1, F.col("doc_id") % 7 + 1).alias("secao")).distinct()

    @cached_property
    def part_questions(self):
        """Short questions made from parts, one pattern per residue."""
        k, name, typ = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
        size = F.col("p_size").cast("string")
        yr = F.concat(F.lit("20"), pad_code("p_size", 2))
        cs = F.concat
        q = (F.when(k % 8 == 0, cs(F.lit("Critica "), size, F.lit(" do manual "), yr, F.lit(" "), name))
             .when(k % 8 == 1, cs(F.lit("diferença entre "), name, F.lit(" e "), typ))
             .when(k % 8 == 2, cs(F.lit("como preencher AIH para "), name))
             .when(k % 8 == 3, cs(F.lit("portaria de "), yr, F.lit(" sobre OPM e "), name, F.lit(" eletiva")))
             .when(k % 8 == 4, name)
             .when(k % 8 == 5, cs(F.lit("tabela sigtap "), F.col("p_brand"), F.lit(" e regras de "), typ))
             .when(k % 8 == 6, cs(F.lit("050046 "), name))
             .otherwise(k.cast("string")))
        return self.raw("part").select(k.alias("query_id"), q.alias("pergunta"))

    @cached_property
    def rule_texts(self):
        """Source texts with one or two rule definitions each."""
        k, kw = F.col("p_partkey"), [*fv.RULE_NAME_ENRICHMENT, "outra regra"]
        word = F.element_at(F.array(*map(F.lit, kw)), (k % len(kw)).cast("int") + 1)

        def block(number, name):
            return F.concat(F.lit("  CRITICA_"), number.cast("string"), F.lit(": {\n    codigo: '05"), pad_code(k % 10000, 4),
                            F.lit("',\n    nome: '"), name, F.lit("',\n    campos: ['"), F.col("p_type"),
                            F.lit("', \"idade\" , ],\n  },\n"))

        text = F.concat(F.lit("export const criticas = {\n"), block(k, F.concat_ws(" ", word, "p_name")),
                        F.when(F.col("p_size") % 2 == 0, block(k + 1000000000, F.col("p_brand"))).otherwise(""), F.lit("}\n"))
        code = F.element_at(F.array(*map(F.lit, [
            "const r = await rlProcedimentoCid(x); if (cbo) { leito }", "calcularIdade(aih) // OPM permanencia",
            "quantidadeRealizada > 1 && DIARIA", "return duplici + transfus", "no keyword here"])), (k % 5).cast("int") + 1)
        return self.raw("part").select(k.alias("text_id"), text.alias("texto"), code.alias("codigo_fonte"))

    @cached_property
    def claim_texts(self):
        """Claims printed as mirror texts; some lines are missing for some claims."""
        k, code = F.col("claim_id"), F.col("codigo_procedimento")
        cs, sub = F.concat, lambda a, n: F.substring(code, a, n)
        dotted = cs(sub(1, 2), F.lit("."), sub(3, 2), F.lit("."), sub(5, 2), F.lit("."), sub(7, 3), F.lit("-"), sub(10, 1))
        other = cs(F.lit("0"), (k % 8 + 1).cast("string"), pad_code(k % 100000000, 8))
        sec = lambda d: cs(F.lit("A"), pad_code((k + d) % 1000, 3))
        text = cs(
            F.lit("Num AIH : "), k.cast("string"), F.lit("-"), (k % 10).cast("string"),
            F.when(k % 3 == 0, "\nTipo: 1-NORMAL").otherwise("\nTipo: 5-LONGA PERMANENCIA"),
            F.lit("\nProcedimento principal : "), dotted, F.lit(" - PROC "), code,
            F.lit("\nDiag. principal: "), F.col("codigo_cid"), F.lit(" - Doença do grupo "), F.col("codigo_cid"),
            F.when(k % 7 != 0, "\nEspecialidade : 01 - CIRURGIA  ").otherwise(""),
            F.when(k % 5 != 0, "\nCarater atendimento : 2 - URGENCIA").otherwise(""),
            F.lit("\nMot saida: 12 - ALTA MELHORADO\n"), other, F.lit(" x "), other, F.lit("\n"),
            F.when(k % 4 != 0, cs(F.lit("CID SECUNDÁRIO\n"), sec(0), F.lit(" "), sec(1), F.lit(" "), sec(0),
                                  F.lit("\nMS-DATASUS\nZ999"))).otherwise(""))
        return self.claims.select("claim_id", text.alias("texto"))

    @cached_property
    def answers(self):
        """Assistant turns with citations appended, and labelled statements."""
        c = self.raw("conversations").where("role = 'assistant'")
        k = F.col("conv_id") * 100 + F.col("turn")
        sec = lambda d: F.concat_ws(".", (k + d) % 70 + 1, (k + d) % 7 + 1)
        page = lambda d: ((k + d) % 50 + 1).cast("string")
        text = F.concat(
            F.col("text"), F.lit(" Conforme [Seção "), sec(0), F.lit(", p. "), page(0), F.lit("] e seção "), sec(3),
            F.lit(" (página "), page(4), F.lit("), ver SECAO "), sec(5), F.lit(". "),
            F.when(k % 3 == 0, F.concat(F.lit("[Secao "), sec(0), F.lit(",p"), page(0), F.lit("]"))).otherwise(""))
        return c.select(k.alias("answer_id"), text.alias("texto"),
                        F.when(k % 4 == 0, -1.0).otherwise((k % 10) / 10.0).alias("score_geral"))

    @cached_property
    def grounding_labels(self):
        """Every sentence of an answer is a statement with a label."""
        labels = F.array(F.lit(fv.SUPPORTED), F.lit(fv.INFERRED), F.lit(fv.UNSUPPORTED))
        return self.answers.select("answer_id", F.posexplode(F.split("texto", r"\.")).alias("i", "s")).select(
            "answer_id", F.col("s").alias("texto"),
            F.element_at(labels, ((F.col("answer_id") + F.col("i") * F.col("i")) % 3).cast("int") + 1).alias("classificacao"))
