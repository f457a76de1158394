"""Reports on a library."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagelens.model import Library
from pagelens.operators.library import library_counts, recent
from pagelens.operators.vectors import embed_coverage

RECENT_VISITS = 12


def library_report(library: Library, k: int = RECENT_VISITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Table sizes, vector coverage and the newest visits."""
    return (
        library_counts(library), embed_coverage(library.chunks), recent(library.visits, "visited_at", k)
    )
