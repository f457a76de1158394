"""Small builders shared by the tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagelens.model import Library

NOW_MS = 1_700_000_000_000
NOW = datetime(2023, 11, 14, 22, 13, 20)


def as_of():
    return F.timestamp_millis(F.lit(NOW_MS))


def ago(**parts):
    return NOW - timedelta(**parts)


def one(spark, expression, *values, schema="string"):
    """Value of an expression over each of the given inputs."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def library(spark, documents, chunks, visits=()):
    """``documents (id, url, title, visited, importance)``, ``chunks (doc, ord, text, vector)``."""
    d = spark.createDataFrame(
        [(i, u, "ex.test", t, "", v, 1, e) for i, u, t, v, e in documents],
        "document_id long, url string, domain string, title string, summary string, "
        "last_visited_at timestamp, visit_count int, importance double")
    c = spark.createDataFrame(
        [(i, i * 1_000_000 + o, o, t, e) for i, o, t, e in chunks],
        "document_id long, chunk_id long, ord int, text string, embedding array<float>")
    v = spark.createDataFrame(list(visits), "url string, visited_at timestamp")
    return Library(d, c, v)
