"""Maintenance of the library's tables: upsert, replace, append, migrate, retain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.text import nonempty
from pagelens.functions.urls import hostname
from pagelens.model import TABLES, Library
from pagelens.operators.spread import bucket_totals, number_rows, top_n

# Engagement per visit and the retention limits.
FIRST_VISIT, REVISIT, LENGTH_GAIN, LENGTH_SCALE, MIGRATED = 0.12, 0.07, 0.15, 25_000, 0.15
MAX_DOCUMENTS, MAX_CHUNKS, CHUNK_HEADROOM, MAX_VISITS = 10_000, 250_000, 44, 50_000
#: Parts in which the new addresses of one batch are numbered.
SLICES = 4096
#: Where documents without a visit stand: the first second of year 1.
NEVER = -62_135_596_800


def lookup(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is listed in ``keys``."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def fold_engagement(batch: DataFrame) -> DataFrame:
    """One row per url from visits ``(url, domain, title, summary, visited_at, seq)``.

    All increments are positive, so capping once at the end equals capping at every step. Only
    mergeable aggregates: a url with any number of visits is combined before the shuffle.
    """
    gain = REVISIT + F.least(F.lit(LENGTH_GAIN), F.length("summary") / F.lit(LENGTH_SCALE))

    def newest_nonempty(name: str):
        return F.max_by(name, F.when(F.col(name) != "", F.col("seq"))).alias(name)

    return (
        batch.withColumn("_gain", gain)
        .groupBy("url")
        .agg(
            F.count("*").alias("visits"),
            F.sum("_gain").alias("gain"),
            F.min_by("_gain", "seq").alias("first_gain"),
            newest_nonempty("title"),
            newest_nonempty("domain"),
            F.max_by("summary", "seq").alias("summary"),
            F.max_by("visited_at", "seq").alias("last_visited_at"),
            (F.min("position") if "position" in batch.columns else F.lit(0).cast("long")).alias("position"),
        )
    )


def upsert_documents(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Existing documents merged with a batch of visits, in arrival order ``seq``.

    ``position`` is that of the first batch with the address, where visits come with one.
    """
    new = fold_engagement(batch).alias("n")
    old = existing.alias("o")
    joined = old.join(new, "url", "full_outer")
    known, seen = F.col("o.document_id").isNotNull(), F.col("n.visits").isNotNull()

    def latest(name: str):
        return F.when(seen, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    start = F.when(known, F.col("o.importance") + F.col("n.gain")).otherwise(
        FIRST_VISIT + F.col("n.gain") - F.col("n.first_gain")
    )
    merged = joined.select(
        F.col("o.document_id").alias("document_id"),
        "url",
        F.coalesce(nonempty(F.col("n.domain")), F.col("o.domain"), F.lit("")).alias("domain"),
        F.coalesce(nonempty(F.col("n.title")), nonempty(F.col("o.title")), F.lit("Untitled")).alias("title"),
        latest("summary"),
        latest("last_visited_at"),
        (F.coalesce(F.col("o.visit_count"), F.lit(0)) + F.coalesce(F.col("n.visits"), F.lit(0)))
        .cast("int").alias("visit_count"),
        F.when(seen, F.least(F.lit(1.0), start)).otherwise(F.col("o.importance")).alias("importance"),
        F.col("n.position").alias("position"),
    )
    return merged


def number_new_documents(merged: DataFrame, existing: DataFrame, start: int | None = None) -> DataFrame:
    """Give documents without an id the next free numbers, from ``start`` if that is more.

    Numbers go by the position of the first batch with the address, so that batches added later change none.
    """
    top = existing.agg(F.max("document_id").alias("m")).first()["m"]
    free = max(0 if top is None else top + 1, start or 0)
    slice_ = F.coalesce("position", F.lit(0)) * SLICES + F.pmod(F.xxhash64("url"), F.lit(SLICES))
    new = merged.filter("document_id is null").drop("document_id").withColumn("_slice", slice_)
    fresh = number_rows(new, [], "_slice", [F.col("url")], "document_id").withColumn("document_id", F.col("document_id") + F.lit(free - 1))
    columns = [c for c in merged.columns if c != "position"]
    return merged.filter("document_id is not null").select(columns).unionByName(fresh.select(columns))


def replace_chunks(chunks: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """All chunks of the listed documents give way to the new ones."""
    kept = chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(new.select(chunks.columns))


def append_visits(log: DataFrame, new: DataFrame, cap: int | None = None) -> DataFrame:
    """Visit log with the new visits; with a ``cap`` (``MAX_VISITS`` is usual), each tenant's newest."""
    both = log.unionByName(new)
    if cap is None:
        return both
    newest = [F.col("visited_at").desc(), F.col("url"), F.col("title")]
    both = both.withColumn("_spread", F.xxhash64("url", "visited_at"))
    return top_n(both, ["tenant_id"], newest, cap, "_spread").drop("rank", "_spread")


def visits_between(visits: DataFrame, start, end) -> DataFrame:
    """Visits in an inclusive time range."""
    return visits.filter(F.col("visited_at").between(start, end))


def migrate_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and single chunks from the old one-row-per-visit table.

    ``pages(id, url, title, visited_at, text, summary, embedding)``; the newest row of a url wins,
    the later one among equals.
    """
    payload = F.struct("id", "title", "visited_at", "text", "summary", "embedding")
    newest = (
        pages.groupBy("url")
        .agg(F.max_by(payload, F.struct(F.coalesce("visited_at", F.timestamp_millis(F.lit(0))), "id")).alias("p"))
        .select("url", "p.*")
    )
    documents = newest.select(
        F.col("id").alias("document_id"), "url", hostname(F.col("url")).alias("domain"), "title",
        "summary", F.col("visited_at").alias("last_visited_at"), F.lit(1).alias("visit_count"),
        F.lit(MIGRATED).alias("importance"),
    )
    chunks = newest.select(
        F.col("id").alias("document_id"), F.lit(0).alias("ord"), "text", "embedding"
    )
    return documents, chunks


def retain(
    documents: DataFrame,
    chunk_counts: DataFrame,
    keys: tuple[str, ...] = (),
    max_documents: int = MAX_DOCUMENTS - 1,
    max_chunks: int = MAX_CHUNKS - CHUNK_HEADROOM,
    bucket: str = "HOUR",
) -> DataFrame:
    """Newest documents that fit both limits; the oldest go first, those never visited before all.

    Documents with a null key form a group like any other.
    Whole time buckets are kept or dropped on their totals; only the one bucket per key in which
    a limit is reached is ordered row by row.
    """
    keys = list(keys)
    sized = (
        documents.join(chunk_counts.select("document_id", "n_chunks"), "document_id", "left")
        .withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))
        .withColumn("_bucket", F.coalesce(F.date_trunc(bucket, "last_visited_at"), F.timestamp_seconds(F.lit(NEVER))))
    )
    # Joins by equality lose null keys: groups are told by keys that are never null.
    plain = [f"_key{i}" for i in range(len(keys))]
    for name, key in zip(plain, keys, strict=True):
        sized = sized.withColumn(name, F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")))
    keys = plain
    totals = bucket_totals(
        sized, keys, "_bucket",
        {"_docs": F.lit(1).cast("long"), "_chunks": F.col("n_chunks")}, descending=True,
    )
    fits = (F.col("_docs") + F.col("_docs_before") <= max_documents) & (
        F.col("_chunks") + F.col("_chunks_before") <= max_chunks
    )
    open_ = (F.col("_docs_before") < max_documents) & (F.col("_chunks_before") <= max_chunks)
    placed = sized.join(
        totals.withColumn("_fits", fits).filter(open_).drop("_docs", "_chunks"), [*keys, "_bucket"]
    )
    order = [F.col("last_visited_at").desc_nulls_last(), F.col("document_id").desc()]
    border = top_n(placed.filter(~F.col("_fits")), keys, order, max_documents, "document_id")


    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    border = border.withColumn("_sum", F.sum("n_chunks").over(so_far)).filter(
        (F.col("_docs_before") + F.col("rank") <= max_documents)
        & (F.col("_chunks_before") + F.col("_sum") <= max_chunks)
    )
    columns = [*documents.columns, "n_chunks"]
    return placed.filter("_fits").select(columns).unionByName(border.select(columns))


def tenant_documents(library: Library) -> DataFrame:
    """``tenant_id, document_id, last_visited_at``: what each tenant has read, and when last."""
    pages = library.documents.select("document_id", "url")
    return library.visits.join(pages, "url").groupBy("tenant_id", "document_id").agg(F.max("visited_at").alias("last_visited_at"))


def enforce_retention(library: Library, scope: str = "library", **limits) -> Library:
    """Library without the documents beyond its limits, and without their chunks and postings.

    With ``scope="tenant"`` the limits hold for what each tenant has read: a document stays as long as one tenant
    has room for it, and documents that no tenant has read go. Visits stay, they have a limit of their own.
    """
    counts = library.chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    if scope == "tenant":
        wanted = retain(tenant_documents(library), counts, ("tenant_id",), **limits).select("document_id").distinct()
        documents = library.documents.join(wanted, "document_id", "left_semi")
    elif scope == "library":
        documents = retain(library.documents, counts, **limits).drop("n_chunks")
    else:
        raise ValueError(f"no such scope: {scope}")
    own = documents.select("document_id")
    postings = library.postings if library.postings is None else library.postings.join(own, "document_id", "left_semi")
    return library.with_tables(documents=documents, chunks=library.chunks.join(own, "document_id", "left_semi"), postings=postings)


def clear_library(spark, directory: str) -> None:
    """Overwrite every table with an empty one of the right schema."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{directory}/{name}")


def library_counts(library: Library) -> DataFrame:
    """Sizes of documents, chunks and visits, one row each."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in (
            ("chunks", library.chunks), ("documents", library.documents), ("visits", library.visits)
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def recent(df: DataFrame, by: str, k: int) -> DataFrame:
    """Newest ``k`` rows."""
    return df.orderBy(F.col(by).desc()).limit(k)
