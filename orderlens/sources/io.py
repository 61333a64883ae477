"""Loading, conforming, writing and validating the order tables.

Sources are open formats with declared schemas (no inference on a cluster);
writes are full refreshes in parent-before-child order, partitioned writers.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.model import KEYS, LOAD_ORDER, SCHEMAS

DB_MANAGED = ("created_at", "subtotal")


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet", names=None,
                options: dict | None = None) -> dict[str, DataFrame]:
    """Read ``<path>/<table>.<fmt>`` for each model table with its declared schema.
    Missing tables are returned as None (like a missing sheet); Spark is asked, so any
    file system does, and every other error is raised."""
    out = {}
    for name in names or LOAD_ORDER:
        reader = spark.read.options(**(options or {})).schema(SCHEMAS[name])
        if fmt == "csv":
            reader = reader.option("header", "true")
        try:
            out[name] = reader.format(fmt).load(f"{path}/{name}.{fmt}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = None
    return out


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              partitions: int, properties: dict | None = None) -> DataFrame:
    """A relational table read in ``partitions`` parallel key ranges."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})


def conform(name: str, df: DataFrame) -> DataFrame:
    """Drop database-managed columns, cast to the declared types, keep declared
    columns in declared order (absent ones become NULL); ``subtotal`` is re-derived."""
    df = df.drop(*[c for c in DB_MANAGED if c in df.columns])
    schema = SCHEMAS[name]
    cols = []
    for f in schema.fields:
        if f.name == "subtotal" and name == "itens_pedido":
            cols.append((F.col("quantidade").cast("decimal(12,2)") * F.col("preco_unitario").cast("decimal(12,2)"))
                        .cast(f.dataType).alias("subtotal"))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet",
                 partition_by: dict[str, list[str]] | None = None) -> None:
    """S3: full refresh -- overwrite each table, parents before children."""
    partition_by = partition_by or {}
    for name in LOAD_ORDER:
        df = tables.get(name)
        if df is None:
            continue
        w = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", "true")
        if partition_by.get(name):
            w = w.partitionBy(*partition_by[name])
        w.save(f"{path}/{name}.{fmt}")


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000, properties: dict | None = None) -> None:
    """S3: JDBC sink with batched inserts and truncate-on-overwrite."""
    (df.write.mode("overwrite").option("truncate", "true").option("batchsize", batch_size)
     .jdbc(url, table, properties=properties or {}))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, one row each."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("registros")).select(F.lit(name).alias("tabela"), "registros")
        out = part if out is None else out.unionByName(part)
    return out


def high_water_marks(tables: dict[str, DataFrame]) -> DataFrame:
    """Highest surrogate key per table (0 when empty) -- where new keys continue."""
    out = None
    for name, df in tables.items():
        key = KEYS.get(name)
        if key is None or key not in df.columns:
            continue
        part = df.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("maximo")).select(
            F.lit(name).alias("tabela"), F.lit(key).alias("chave"), "maximo")
        out = part if out is None else out.unionByName(part)
    return out


def export_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Export a result as JSON records (ISO dates) or CSV with a header."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.option("dateFormat", "yyyy-MM-dd").json(path)


def as_json_records(df: DataFrame) -> DataFrame:
    """One JSON document per row (dates as ISO text)."""
    return df.select(F.to_json(F.struct(*df.columns), {"dateFormat": "yyyy-MM-dd"}).alias("registro"))


# Co-location: orders and their lines meet on id_pedido in most operators; written
# bucketed (and sorted) on it with the same bucket count, their join reads matching
# buckets side by side with no shuffle of either table.
DEFAULT_BUCKETS = {"pedidos": ["id_pedido"], "itens_pedido": ["id_pedido"], "pedido_clientes": ["id_pedido"],
                   "clientes": ["id_cliente"], "produtos": ["id_produto"]}


def write_bucketed(tables: dict[str, DataFrame], path: str, buckets: int,
                   keys: dict[str, list[str]] | None = None, database: str | None = None) -> dict[str, str]:
    """S3 for repeated joins: save each table as a bucketed, sorted catalog table whose
    files live under ``path`` (a shared folder on a cluster).  Returns table names."""
    keys = keys or DEFAULT_BUCKETS
    names = {}
    for name in LOAD_ORDER:
        df = tables.get(name)
        if df is None:
            continue
        full = f"{database}.{name}" if database else name
        w = df.write.mode("overwrite").format("parquet").option("path", f"{path}/{name}")
        if name in keys:
            w = w.bucketBy(buckets, *keys[name]).sortBy(*keys[name])
        w.saveAsTable(full)
        names[name] = full
    return names
