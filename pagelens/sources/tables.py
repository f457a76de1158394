"""Library tables on shared storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.model import TABLES, Library


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    df = spark.read.schema(TABLES[name]).parquet(f"{directory}/{name}")
    return df.select(TABLES[name].names)


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def read_library(spark: SparkSession, directory: str) -> Library:
    """All tables of a library that were written; lazily, with fixed schemas."""
    return Library(**{name: read_if_there(spark, f"{directory}/{name}", TABLES[name]) for name in TABLES})


def read_visits(spark: SparkSession, directory: str, start, end) -> DataFrame:
    """Visits in an inclusive range; whole days outside it are not read."""
    stored = T.StructType([*TABLES["visits"].fields, T.StructField("visit_date", T.DateType())])
    visits = spark.read.schema(stored).parquet(f"{directory}/visits")
    return visits.filter(
        F.col("visit_date").between(F.to_date(start), F.to_date(end))
        & F.col("visited_at").between(start, end)
    ).select(TABLES["visits"].names)


def write_table(df: DataFrame, directory: str, name: str) -> None:
    """Replace one table, laid out for its usual reads."""
    out = df.select(TABLES[name].names)
    target = f"{directory}/{name}"
    if name == "visits":
        dated = out.withColumn("visit_date", F.to_date("visited_at"))
        dated.write.mode("overwrite").partitionBy("visit_date").parquet(target)
    elif name == "postings":
        # The range also covers the document, which splits frequent terms over many files.
        out.repartitionByRange("term", "document_id").sortWithinPartitions("term", "document_id").write.mode("overwrite").parquet(target)
    else:
        out.write.mode("overwrite").parquet(target)


def write_library(library: Library, directory: str) -> None:
    """Write a library to a new directory; never over the one it was read from."""
    for name in TABLES:
        df = getattr(library, name)
        if df is not None:
            write_table(df, directory, name)


#: The key by which each table is dealt into buckets, and the order inside one.
BUCKETS = {
    "documents": ("document_id", ["document_id"]),
    "chunks": ("document_id", ["document_id", "chunk_id"]),
    "conversations": ("conversation_id", ["conversation_id"]),
    "messages": ("conversation_id", ["conversation_id", "message_id"]),
}


def write_buckets(library: Library, directory: str, name: str, buckets: int = 64) -> None:
    """Tables ``name_documents`` and so on, dealt by the keys of their joins: those need no shuffle, a lookup reads one bucket."""
    for table, (key, order) in BUCKETS.items():
        df = getattr(library, table)
        if df is not None:
            out = df.repartition(buckets, key)  # one file for each bucket
            out.write.mode("overwrite").bucketBy(buckets, key).sortBy(*order).option("path", f"{directory}/{table}").saveAsTable(f"{name}_{table}")


def read_buckets(spark: SparkSession, name: str, library: Library) -> Library:
    """``library`` with those of its tables that ``write_buckets`` wrote."""
    return library.with_tables(**{t: spark.table(f"{name}_{t}") for t in BUCKETS if spark.catalog.tableExists(f"{name}_{t}")})


def save_digests(digests: DataFrame, directory: str) -> None:
    """Replace the stored digests of the given ranges and leave the others alone."""
    (
        digests.select(TABLES["digests"].names)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("range")
        .parquet(f"{directory}/digests")
    )


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Small files come in fewer partitions than there are cores: spread those by ``key``.

    A scan with a partition for every core is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages; rows with a content type other than HTML are left out."""
    pages = spark.read.parquet(path)
    if "content_type" in pages.columns:
        pages = pages.filter(F.col("content_type").rlike(r"(?i)\btext/html\b|\bapplication/xhtml"))
    return pages
