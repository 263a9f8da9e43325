"""Tables in any format Spark knows, and over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom import schemas

# ---- fixed values: one row of a dump of the domain-policy table -----------------------
POLICY_ROW = (
    r"^INSERT INTO dbo\.url_domain VALUES \(([0-9]+), '((?:[^']|'')*)', '((?:[^']|'')*)', "
    r"'((?:[^']|'')*)', '((?:[^']|'')*)', (true|false)\);"
)


def load_table(
    spark: SparkSession,
    path: str,
    source_format: str = "parquet",
    schema: str | None = None,
    **options,
) -> DataFrame:
    """Read a table.  For ``source_format="jdbc"``, ``path`` is the table name and the
    options carry ``url``, ``partitionColumn`` and so on; its driver must be on the
    class path."""
    reader = spark.read.format(source_format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if source_format == "jdbc":
        return reader.option("dbtable", path).load()
    loaded = reader.load(path)
    if schema is None:
        return loaded
    # Partition columns come last from files; keep the order of the schema.
    return loaded.select(*StructType.fromDDL(schema).fieldNames())


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """Give a table that comes in fewer splits than there are cores to all of them.

    Meant for small inputs of costly rows (one file with texts, say).  A table large enough
    to have a split per core is passed on as it is, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores, *keys)


def save_table(
    table: DataFrame,
    path: str,
    source_format: str = "parquet",
    mode: str = "append",
    partition_by: list[str] = (),
    **options,
) -> None:
    writer = table.write.format(source_format).mode(mode).options(**options)
    if source_format == "jdbc":
        writer.option("dbtable", path).save()
        return
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def load_policy(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    """Domain policies: from a table, or from a database dump (``source_format="dump"``)."""
    if source_format == "dump":
        return parse_policy_dump(spark.read.text(path))
    options = {"header": "true"} if source_format == "csv" else {}
    return load_table(spark, path, source_format, schemas.DOMAIN_POLICY, **options)


def parse_policy_dump(lines: DataFrame, column: str = "value") -> DataFrame:
    """Domain policies from the INSERT lines of a dump; other lines are skipped."""
    line = F.col(column)

    def field(n: int):
        return F.regexp_extract(line, POLICY_ROW, n)

    def text(n: int):
        return F.replace(field(n), F.lit("''"), F.lit("'"))

    return lines.where(line.rlike(POLICY_ROW)).select(
        field(1).cast("int").alias("id"),
        text(2).alias("subdomain"),
        text(3).alias("domain"),
        text(4).alias("suffix"),
        text(5).alias("method"),
        field(6).cast("boolean").alias("checked"),
    )

