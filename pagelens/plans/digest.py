"""Reading digests: what was read in a period, the prompt for it, and the parsed answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.questions import DAY_MS, day_start
from pagelens.functions.text import WS, collapse, nonempty, strip
from pagelens.model import Library
from pagelens.operators.budget import fit_budget
from pagelens.operators.chunks import representative
from pagelens.operators.spread import top_n
from pagelens.plans.ask import SMALL_PROMPT, join_blocks
from pagelens.session import written

# Periods, sizes in characters, listed sources, minutes a digest stays fresh.
RANGES = {"today": "today", "yesterday": "yesterday", "last_7_days": "in the last 7 days"}
RESERVED, PER_SOURCE, SHOWN, LISTED, FRESH_MINUTES = 2_000, 300, 600, 24, 30
NO_NARRATIVE = "No summary generated."


#: What the model is told before any prompt; ``parse_digest`` reads this layout.
LAYOUT = """Sum up what was read, from the numbered passages alone, in three parts with these headings:
NARRATIVE: two or three sentences on what the reading was about
TOPICS:
- a topic, named as closely as the passages allow (2 pages)
INSIGHTS:
- one thing that can be learned from a passage, with its number [1]
Give three to five topics, the most important first, and two to four insights, each resting on one passage."""


def periods(ranges: Sequence[str], as_of: Column) -> Column:
    """Start and end of each named period, as an array of structs."""
    now = F.unix_millis(as_of)
    today = day_start(now)
    bounds = {
        "today": (today, now),
        "yesterday": (today - DAY_MS, today - 1),
        "last_7_days": (today - 7 * DAY_MS, now),
    }
    return F.array(*[
        F.struct(F.lit(r).alias("range"), bounds[r][0].alias("start_ms"), bounds[r][1].alias("end_ms"))
        for r in ranges
    ])


def documents_by_period(documents: DataFrame, ranges: Sequence[str], as_of: Column) -> DataFrame:
    """Documents once per period that holds their last visit."""
    week_ago = F.timestamp_millis(day_start(F.unix_millis(as_of)) - 7 * DAY_MS)
    ms = F.unix_millis("last_visited_at")
    inside = F.filter(periods(ranges, as_of), lambda p: ms.between(p["start_ms"], p["end_ms"]))
    return (
        documents.filter(F.col("last_visited_at").between(week_ago, as_of))
        .withColumn("_p", F.explode(inside))
        .select(*documents.columns, F.col("_p.range").alias("range"))
    )


def digest_order() -> list[Column]:
    """Importance in steps of a tenth, then the latest visit."""
    return [
        F.floor(F.coalesce("importance", F.lit(0.0)) * 10).desc(), F.col("last_visited_at").desc(),
        F.col("document_id"),
    ]


def pack_digest(by_period: DataFrame, chunks: DataFrame, max_chars: int = SMALL_PROMPT) -> DataFrame:
    """Longest chunk of each document, as many per period as the prompt takes.

    The order does not hang on the texts, so they are read for the documents only that could fit.
    """
    room = max_chars - RESERVED
    cut = by_period.join(chunks.select("document_id"), "document_id", "left_semi")
    first = written(top_n(cut, ["range"], digest_order(), max(1, room // PER_SOURCE), "document_id").drop("rank"))
    wanted = F.broadcast(first.select("document_id").distinct())  # a few rows for each period
    best = representative(chunks.join(wanted, "document_id", "left_semi"))
    rows = first.join(best, "document_id")
    size = F.least(F.length("text"), F.lit(SHOWN)) + PER_SOURCE
    return fit_budget(
        rows, ["range"], digest_order(), size, F.lit(room), room, PER_SOURCE, "document_id"
    ).drop("used")


def digest_prompts(packed: DataFrame, ranges: Sequence[str], as_of: Column) -> DataFrame:
    block = F.concat(
        F.lit("["), F.col("n"), F.lit("] "), F.col("title"), F.lit(" — "), F.col("domain"),
        F.lit("\n"), F.substring("text", 1, SHOWN),
    )
    spans = packed.sparkSession.range(1).select(F.inline(periods(ranges, as_of)))

    def day(ms: str) -> Column:
        return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")

    return join_blocks(packed, "range", block).join(spans, "range").select(
        "range", "source_count", F.lit(LAYOUT).alias("system"),
        F.concat(
            F.lit("Read between "), day("start_ms"), F.lit(" and "), day("end_ms"),
            F.lit(", one passage for each of "), F.col("source_count"),
            F.lit(" pages:\n\n"), F.col("blocks"),
            F.lit("\n\nWrite the digest in the layout given."),
        ).alias("prompt"),
    )


def digest_facts(by_period: DataFrame, ranges: Sequence[str], as_of: Column) -> DataFrame:
    """Counts and listed sources per period; an empty period has a message."""
    spans = by_period.sparkSession.range(1).select(F.inline(periods(ranges, as_of))).select("range")
    counts = by_period.groupBy("range").agg(
        F.count("*").alias("page_count"), F.count_distinct("domain").alias("domains_count")
    )
    oldest = [F.col("last_visited_at"), F.col("document_id")]
    listed = top_n(by_period, ["range"], oldest, LISTED, "document_id").groupBy("range").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "url", "title", "domain", F.col("last_visited_at").alias("visited_at")
        ))).alias("s")
    )
    sources = F.transform(
        F.coalesce("s", F.array()), lambda x: F.struct(*[x[f].alias(f) for f in ("url", "title", "domain", "visited_at")])
    )
    label = F.create_map(*[F.lit(v) for pair in RANGES.items() for v in pair])[F.col("range")]
    zero = F.lit(0).cast("long")
    return spans.join(counts, "range", "left").join(listed, "range", "left").select(
        "range",
        F.coalesce("page_count", zero).alias("page_count"),
        F.coalesce("domains_count", zero).alias("domains_count"),
        F.when(F.col("s").isNull(), F.array().cast(
            "array<struct<url:string,title:string,domain:string,visited_at:timestamp>>"
        )).otherwise(sources).alias("sources"),
        F.when(
            F.col("page_count").isNull(),
            F.concat(F.lit("The library has no page read "), label, F.lit(", so there is nothing to sum up.")),
        ).alias("message"),
    )


# Layout of an answer. A section ends where the next header begins.
LINE = r"[^\n\r\x{2028}\x{2029}]+?"
NARRATIVE = rf"(?is)NARRATIVE:{WS}*(.*?)(?=\n{WS}*TOPICS{WS}*:)"
TOPICS = rf"(?is)TOPICS:{WS}*(.*?)(?=\n{WS}*INSIGHTS{WS}*:)"
INSIGHTS = rf"(?is)INSIGHTS:{WS}*(.*)"
TOPIC_LINE = rf"(?i)^[-*]{WS}*({LINE}){WS}*\(([0-9]+){WS}*pages?\)"
INSIGHT_LINE = rf"^[-*]{WS}*({LINE}){WS}*\[([0-9]+)\]"


def _lines(section: Column, pattern: str, first: str, second: str) -> Column:
    """Lines that fit the pattern, as structs of their two parts."""
    fitting = F.filter(
        F.split(section, "\n"),
        lambda line: line.rlike(pattern) & F.regexp_extract(line, pattern, 2).try_cast("int").isNotNull(),
    )
    return F.transform(
        fitting,
        lambda line: F.struct(
            strip(F.regexp_extract(line, pattern, 1)).alias(first),
            F.regexp_extract(line, pattern, 2).try_cast("int").alias(second),
        ),
    )


def parse_digest(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Narrative, topics and insights from ``answers(answer_id, raw)``.

    ``sources(answer_id, n, url, title)`` numbers what the answer may cite; lines that do not fit
    the layout or cite an unknown number drop out.
    """
    raw = F.col("raw")
    parsed = answers.select(
        "answer_id",
        F.coalesce(
            nonempty(collapse(F.regexp_extract(raw, NARRATIVE, 1))), F.lit(NO_NARRATIVE)
        ).alias("narrative"),
        _lines(F.regexp_extract(raw, TOPICS, 1), TOPIC_LINE, "topic", "page_count").alias("topics"),
        _lines(F.regexp_extract(raw, INSIGHTS, 1), INSIGHT_LINE, "text", "n").alias("_cited"),
    )
    cited = parsed.select("answer_id", F.posexplode("_cited").alias("_at", "_c")).select(
        "answer_id", "_at", F.col("_c.text").alias("text"), F.col("_c.n").alias("n")
    )
    known = cited.join(sources.select("answer_id", "n", "url", "title"), ["answer_id", "n"])
    row = F.struct("_at", "text", F.col("url").alias("source_url"), F.col("title").alias("source_title"))
    kept = known.groupBy("answer_id").agg(F.array_sort(F.collect_list(row)).alias("_kept"))
    insights = F.transform(
        "_kept", lambda x: F.struct(*[x[f].alias(f) for f in ("text", "source_url", "source_title")])
    )
    empty = F.array().cast("array<struct<text:string,source_url:string,source_title:string>>")
    return parsed.join(kept, "answer_id", "left").select(
        "answer_id", "narrative", "topics",
        F.when(F.col("_kept").isNull(), empty).otherwise(insights).alias("insights"),
    )


def stale_digests(
    requested: DataFrame, digests: DataFrame, as_of: Column, minutes: int = FRESH_MINUTES
) -> DataFrame:
    """Requested ranges without a stored digest younger than ``minutes``; forced ones always."""
    age = F.unix_millis(as_of) - F.unix_millis("generated_at")
    fresh = digests.filter(age < minutes * 60_000).select("range")
    force = F.coalesce(F.col("force"), F.lit(False)) if "force" in requested.columns else F.lit(False)
    reusable = fresh.distinct().withColumn("_fresh", F.lit(True))
    return requested.join(reusable, "range", "left").filter(F.col("_fresh").isNull() | force).drop("_fresh")


def reading_digest(
    library: Library, ranges: Sequence[str], as_of: Column, max_chars: int = SMALL_PROMPT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, prompts and numbered sources for the given periods."""
    by_period = documents_by_period(library.documents, ranges, as_of)
    packed = pack_digest(by_period, library.chunks, max_chars)
    return digest_facts(by_period, ranges, as_of), digest_prompts(packed, ranges, as_of), packed


def finish_digests(facts: DataFrame, answers: DataFrame, packed: DataFrame, as_of: Column) -> DataFrame:
    """Digest rows ready to store, from ``answers(range, raw)``; empty periods are not stored."""
    parsed = parse_digest(
        answers.withColumnRenamed("range", "answer_id"),
        packed.select(F.col("range").alias("answer_id"), "n", "url", "title"),
    ).withColumnRenamed("answer_id", "range")
    return facts.filter("message is null").join(parsed, "range").select(
        "range", as_of.alias("generated_at"), "page_count", "domains_count", "narrative", "topics",
        "insights", "sources",
    )
