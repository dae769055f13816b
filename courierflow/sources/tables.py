"""Entity tables with declared schemas: applied on read, from files or JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierflow.schema import ENTITY_DDL, entity_schema


def conform(df: DataFrame, entity: str) -> DataFrame:
    """The declared columns in order and type.  A missing column, or a null in
    one declared not null, is an error when the row is read."""
    cols = []
    for field in entity_schema(entity):
        c = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"null in {entity}.{field.name}")).cast(field.dataType))
        cols.append(c.alias(field.name))
    return df.select(*cols)


def read_entity(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """A parquet folder of one entity, columns pruned to the declared ones."""
    return conform(spark.read.parquet(path), entity)


def jdbc_options(url: str, entity: str, partition_column: str, lower: int, upper: int, partitions: int,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a partitioned JDBC read: ``partitions`` range queries over
    ``partition_column``, so that no single connection carries a table."""
    if entity not in ENTITY_DDL:
        raise KeyError(entity)
    return {"url": url, "dbtable": entity, "partitionColumn": partition_column, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions), "fetchsize": str(fetch_size)}


def read_jdbc_entity(spark: SparkSession, url: str, entity: str, partition_column: str, lower: int, upper: int,
                     partitions: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A table of a relational database (its driver must be on the classpath;
    not used in tests)."""
    options = jdbc_options(url, entity, partition_column, lower, upper, partitions) | (properties or {})
    return conform(spark.read.format("jdbc").options(**options).load(), entity)
