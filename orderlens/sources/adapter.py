"""Stand-in order tables built from the driver's TPC-H-like parquet tables.

This module only reshapes rows into the order model's schema (see FIXTURES.md
section 2); it does none of an operator's work.  The same rules are written
in DuckDB SQL in ``oracle/adapter.py``; both sides use integer or decimal
arithmetic only, so the two engines agree exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.numeric import MONEY, PRICE, dec
from orderlens.model import TIPOS_GRUPO
from orderlens.plans.ranking import with_global_row_number
from orderlens.session import checkpoint_dir

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


REGIOES = ["Norte", "Nordeste", "Centro-Oeste", "Sudeste", "Sul"]


@dataclass
class Tables:
    """The order model's tables for one data set, built lazily."""

    spark: SparkSession
    sf_dir: str
    extra: dict = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def clientes(self) -> DataFrame:
        c, n, r = self.raw("customer"), self.raw("nation"), self.raw("region")
        # nation and region are fixed-size code tables (25 and 5 rows): safe to broadcast
        geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
        return (c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey)
                .select(F.col("c_custkey").alias("id_cliente"),
                        F.col("c_name").alias("nome"),
                        F.col("c_mktsegment").alias("tipo_cliente"),
                        F.col("r_name").alias("regiao"),
                        F.col("n_name").alias("estado"),
                        F.date_add(F.lit("1994-01-01").cast("date"),
                                   (F.col("c_custkey") % 365).cast("int")).alias("data_cadastro"),
                        F.col("c_acctbal").cast(MONEY).alias("limite_credito")))

    @cached_property
    def produtos(self) -> DataFrame:
        price = F.col("p_retailprice").cast(PRICE)
        return self.raw("part").select(
            F.col("p_partkey").alias("id_produto"),
            F.col("p_name").alias("nome"),
            F.col("p_type").alias("categoria"),
            F.col("p_brand").alias("subcategoria"),
            F.lit(None).cast("string").alias("unidade"),
            price.alias("preco_unitario"),
            F.when(F.col("p_partkey") % 5 == 0, F.lit(None).cast(PRICE))
             .otherwise(F.round(price * dec("0.65"), 2).cast(PRICE)).alias("custo_referencia"))

    def _lines(self, li: DataFrame) -> DataFrame:
        qty = F.col("l_quantity").cast(PRICE)
        unit_cents = F.call_function("div", F.round(F.col("l_extendedprice") * 100).cast("long"),
                                     F.col("l_quantity").cast("long"))
        price = (unit_cents * dec("0.01")).cast(PRICE)
        return li.select(
            F.col("l_orderkey").alias("id_pedido"),
            F.col("l_partkey").alias("id_produto"),
            qty.alias("quantidade"),
            price.alias("preco_unitario"),
            F.lit(None).cast("string").alias("unidade"),
            (qty * price).cast(MONEY).alias("subtotal"),
            *[c for c in li.columns if c.startswith("_")])

    @cached_property
    def itens_pedido(self) -> DataFrame:
        """Order lines without the surrogate key (most operators do not need it)."""
        return self._lines(self.raw("lineitem"))

    @cached_property
    def itens_pedido_com_id(self) -> DataFrame:
        """Order lines with ``id_item`` = row number over all line columns (X1, distributed)."""
        li = self.raw("lineitem")
        numbered = with_global_row_number(li, [F.col(c).asc_nulls_first() for c in LINE_COLUMNS], "_id_item")
        return self._lines(numbered).withColumnRenamed("_id_item", "id_item").select(
            "id_item", "id_pedido", "id_produto", "quantidade", "preco_unitario", "unidade", "subtotal")

    @cached_property
    def chaves_itens(self) -> DataFrame:
        """The keys of ``itens_pedido_com_id`` alone: numbers from 1 on, so that a count gives them without a sort."""
        return self.spark.range(1, self.raw("lineitem").count() + 1).withColumnRenamed("id", "id_item")

    @cached_property
    def pedidos(self) -> DataFrame:
        o = self.raw("orders")
        # per-order line sums: partial aggregate before the shuffle, output already
        # hash-partitioned on the order key, so the join only moves the orders side
        sums = self.itens_pedido.groupBy("id_pedido").agg(F.sum("subtotal").alias("_itens"))
        day = F.col("o_orderdate").cast("date")
        key = F.col("o_orderkey")
        status = (F.when(key % 10 == 0, "Cancelado")
                  .when(F.col("o_orderstatus") == "F", "Executado")
                  .when(F.col("o_orderstatus") == "O", "Em Andamento")
                  .when(F.col("o_orderstatus") == "P", "Pendente"))
        valor = (F.when((key % 7 == 0) | F.col("_itens").isNull(), F.col("o_totalprice").cast(MONEY))
                 .otherwise(F.col("_itens")).cast(MONEY))
        return (o.join(sums, o.o_orderkey == sums.id_pedido, "left")
                .select(key.alias("id_pedido"),
                        day.alias("data_pedido"),
                        F.date_add(day, (key % 30).cast("int")).alias("data_entrega"),
                        F.col("o_custkey").alias("id_cliente"),
                        F.col("o_orderpriority").alias("tipo_contrato"),
                        status.alias("status"),
                        # every eleventh order has no origin, every thirteenth no destination
                        F.when(key % 11 != 0, F.element_at(F.array(*[F.lit(r) for r in REGIOES]), (key % 5 + 1).cast("int"))).alias("regiao_origem"),
                        F.when(key % 13 != 0, F.element_at(F.array(*[F.lit(r) for r in REGIOES]), (key % 7 % 5 + 1).cast("int"))).alias("regiao_destino"),
                        valor.alias("valor_total")))

    @cached_property
    def grupos_compra(self) -> DataFrame:
        """A purchase group per nation, represented by its first customer; every fifth is closed."""
        kinds = F.array(*[F.lit(k) for k in TIPOS_GRUPO])
        first = self.raw("customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("representante_id"))
        n = self.raw("nation").join(first, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        key = F.col("n_nationkey")
        return n.select((key + 1).cast("long").alias("id_grupo"), F.col("n_name").alias("nome_grupo"),
                        F.element_at(kinds, (key % 4 + 1).cast("int")).alias("tipo_grupo"), "representante_id",
                        F.lit("1994-01-01").cast("date").alias("data_criacao"), (key % 5 != 4).alias("ativo"),
                        F.lit(None).cast("string").alias("observacoes"))

    @cached_property
    def cliente_grupo(self) -> DataFrame:
        """Every customer belongs to its nation's group; every fourth has left it."""
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("id_cliente"), (F.col("c_nationkey") + 1).cast("long").alias("id_grupo"),
            ((key % 1000) * dec("0.05")).cast("decimal(5,2)").alias("percentual_participacao"),
            F.date_add(F.lit("1994-01-01").cast("date"), (key % 365).cast("int")).alias("data_entrada"), (key % 4 != 0).alias("ativo"))

    @cached_property
    def pedido_clientes(self) -> DataFrame:
        """Shares produced by the share generator (H4) over these tables, written once: reports read them several times."""
        if "pedido_clientes" in self.extra:
            return self.extra["pedido_clientes"]
        from orderlens.operators.sharing import generate_shares
        checkpoint_dir(self.spark)
        return generate_shares(self.pedidos, self.clientes).checkpoint(eager=True)


def load_test_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
