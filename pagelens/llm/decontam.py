"""Benchmark passages in training texts, by a positional inverted index.

The index has a posting (term, document, position) for every word of every text, in segments: each
task writes its own documents' postings in the order of the terms' hashes, so that building needs no shuffle
and a term's postings are runs of a file. A search starts from the rarest terms of each window of test
words. Postings less their offsets are the places where the window may begin; only where those lists
agree the postings of the other words are looked up, and runs of agreeing positions are phrases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import discard, free, stored

WIDTH = 10
#: Terms of a window whose postings are intersected before all the others are looked up.
RAREST = 2
#: Rows up to which terms or documents are broadcast (some tens of MB); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: A document is told by its id and, should ids repeat or be null, a row number written with the postings.
DOC = ["doc_id", "copy"]


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; on ASCII texts that is the faster ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), NO_WORD), "")


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", copy: Column | None = None) -> DataFrame:
    """Written postings ``term, doc_id, copy, pos`` of all words.

    ``copy`` tells rows of one id apart; by default each row has a number of its own. A text's end has a
    posting too, of the empty term, whose position is the number of words.
    """
    row = F.monotonically_increasing_id() if copy is None else copy
    given = docs.select(F.col(id).cast("long").alias("doc_id"), row.cast("long").alias("copy"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Words are lowered one by one: most are ASCII, also in texts that aren't.
    found = F.array_append(F.array_remove(F.split("text", NO_WORD), ""), F.lit(""))
    postings = given.select(*DOC, F.posexplode(found).alias("pos", "term")).select(lowered(F.col("term")).alias("term"), *DOC, "pos")
    return stored(postings.sortWithinPartitions(F.xxhash64("term")), "postings")


def _small(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) if c in DOC else left[c] == right[c] for c in columns])


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def item_terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, item, q, term, n``: the words of each test text, with their places and number.

    ``item`` tells texts apart, should ids repeat or be null.
    """
    given = items.select(F.col(id).alias("item_id"), words(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("words")).dropDuplicates()
    return given.select("item_id", F.xxhash64("item_id", "words").alias("item"), F.size("words").alias("n"), F.posexplode("words").alias("q", "term"))


def phrases(index: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, copy, item_id, item, diagonal, q, pos``: every document word in an occurring window.

    A window is ``width`` consecutive words of an item, or all of an item with fewer. A phrase is
    found as a run of positions on one diagonal (document position less item position).
    """
    terms = stored(item_terms(items), "item-terms")
    vocabulary = _small(terms.select("term").distinct(), broadcast_rows)
    counts = stored(index.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("occurrences")), "term-counts")

    # The rarest terms of each window; a window with a term that never occurs has no place.
    size = F.least(F.col("n"), F.lit(width))
    rated = terms.join(counts, "term", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    window = F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - size + 1), F.least(F.col("q"), F.col("n") - size))).alias("window")
    ranked = F.array_sort(F.collect_list(F.struct("occurrences", "q", "term")))
    windows = rated.select("item", window, "occurrences", "q", "term").groupBy("item", "window").agg(F.slice(ranked, 1, RAREST).alias("rarest"))
    windows = stored(windows.filter("rarest[0].occurrences > 0"), "windows")
    rarest = windows.select("item", F.explode("rarest").alias("place")).select("item", "place.q", "place.term").distinct()

    # Their postings less their offsets: where an item would have to begin. There must be all the
    # rarest terms of one of its windows. Places in an item are bits, those of long items share them;
    # whether the words are all there is found below.
    begins = index.join(_small(rarest, broadcast_rows), "term").select(*DOC, "item", (F.col("pos") - F.col("q")).alias("diagonal"), _bit(F.col("q")).alias("bit"))
    met = begins.groupBy(*DOC, "item", "diagonal").agg(F.bit_or("bit").alias("met"))
    masks = F.aggregate("rarest", F.lit(0).cast("long"), lambda a, r: a.bitwiseOR(_bit(r["q"])))
    wanted = windows.groupBy("item").agg(F.collect_set(masks).alias("wanted"))
    starts = met.join(wanted, "item").filter(F.exists("wanted", lambda w: F.col("met").bitwiseAND(w) == w))
    starts = stored(starts.select(*DOC, "item", "diagonal"), "starts")

    # All words of the items there, to be found among the postings of just those documents.
    asked = starts.join(terms.select("item", "item_id", "n", "q", "term"), "item").withColumn("pos", F.col("diagonal") + F.col("q")).filter("pos >= 0")
    places = _small(starts.select(*DOC).distinct(), broadcast_rows)
    there = index.join(vocabulary, "term", "left_semi").join(places, _same(index, places, DOC), "left_semi")
    found = asked.join(there, _same(asked, there, [*DOC, "pos", "term"]), "left_semi")

    line = [*DOC, "item", "diagonal"]
    run = F.col("q") - F.row_number().over(Window.partitionBy(*line).orderBy("q"))
    length = F.count("*").over(Window.partitionBy(*line, "run"))
    return found.withColumn("run", run).withColumn("length", length).filter(F.col("length") >= size).select(*DOC, "item_id", "item", "diagonal", "q", "pos")


def near(index: DataFrame, items: DataFrame, within: int, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, copy, item_id, item, window, at``: windows whose words all stand near one place, in any order.

    ``at`` is a position of the window's rarest term; the other words stand at most ``within`` words away.
    """
    terms = stored(item_terms(items), "item-terms")
    vocabulary = _small(terms.select("term").distinct(), broadcast_rows)
    counts = stored(index.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("occurrences")), "term-counts")
    size = F.least(F.col("n"), F.lit(width))
    window = F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - size + 1), F.least(F.col("q"), F.col("n") - size))).alias("window")
    rated = terms.join(counts, "term", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    windows = stored(rated.select("item_id", "item", window, "term", "occurrences").groupBy("item_id", "item", "window").agg(
        F.min(F.struct("occurrences", "term")).alias("rarest"), F.collect_set("term").alias("terms")).filter("rarest.occurrences > 0"), "windows")
    first = index.join(_small(windows.select("item_id", "item", "window", F.col("rarest.term").alias("term")), broadcast_rows), "term")
    starts = stored(first.select(*DOC, "item_id", "item", "window", F.col("pos").alias("at")), "near-starts")
    asked = starts.join(windows.select("item", "window", "terms"), ["item", "window"])
    # Words within reach lie in the same stretch of ``within`` positions or in a neighbouring one.
    stretch = F.floor(F.col("at") / within)
    asked = asked.select(*DOC, "item_id", "item", "window", "at", F.size("terms").alias("wanted"), F.explode("terms").alias("term"),
                         F.array(stretch - 1, stretch, stretch + 1).alias("around")).withColumn("stretch", F.explode("around")).drop("around")
    places = _small(starts.select(*DOC).distinct(), broadcast_rows)
    there = index.join(vocabulary, "term", "left_semi").join(places, _same(index, places, DOC), "left_semi").withColumn("stretch", F.floor(F.col("pos") / within))
    met = asked.join(there, _same(asked, there, [*DOC, "term", "stretch"]) & (F.abs(there["pos"] - asked["at"]) <= within), "left_semi")
    key = [*DOC, "item_id", "item", "window", "at"]
    whole = met.select(*key, "wanted", "term").distinct().groupBy(*key, "wanted").agg(F.count("*").alias("had"))
    return whole.filter("had = wanted").select(*key)


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: ``doc_id, copy, n_words, n_hit, n_items, items, contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` has the ids of the items
    with occurring windows, sorted as strings. Null and empty texts have no words. Repeated rows give
    repeated rows; rows with one id and different texts are searched apart. Items without words, with
    null texts or repeated add nothing; a null item id counts as an item of its own, written as an empty
    string. Very long texts are searched whole, other columns are ignored. Empty tables: no hits, or no rows.
    """
    index = build_index(docs)
    hits = phrases(index, items, width, broadcast_rows)
    # Positions of a document and items are each few enough for one row: a text has that many words.
    found = hits.groupBy(*DOC).agg(
        F.size(F.collect_set("pos")).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"))
    ends = index.filter(F.col("term") == "").select(*DOC, F.col("pos").cast("long").alias("n_words"))
    joined = ends.join(found, _same(ends, found, DOC), "left")
    n_hit = F.coalesce(found["n_hit"], F.lit(0))
    items = F.coalesce(found["items"], F.array().cast("array<string>"))
    return joined.select(ends["doc_id"], ends["copy"], "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any occurring window, with all their columns, whatever their names.

    Each row is decided on by its own text: where ids repeat or are null, the rows are numbered and written first.
    Null and empty texts stay, as they have no words. Empty tables: all rows of ``docs`` stay, or no rows.
    """
    own, gone, row = F.col(id).cast("long"), free(docs, "_doc"), free(docs, "_row")
    numbered = None
    if docs.filter(own.isNull()).limit(1).count() or docs.groupBy(own.alias("id")).count().filter("count > 1").limit(1).count():
        numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        index = build_index(numbered, id, text, F.col(row))
    else:
        index = build_index(docs, id, text, F.lit(0))
    hits = phrases(index, items, width).select(F.col("doc_id" if numbered is None else "copy").alias(gone)).distinct()
    hits = stored(hits, "contaminated")
    discard(index)
    hits = _small(hits, BROADCAST_ROWS)
    if numbered is None:
        return docs.join(hits, own == F.col(gone), "left_anti")
    return numbered.join(hits, F.col(row) == F.col(gone), "left_anti").drop(row)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM doc_words, sizes WHERE len(w) >= size)
), found AS (
  SELECT p.doc_id, p.size, p.s, v.item_id FROM places p JOIN windows v ON p.phrase = v.phrase AND p.size = v.size
), hit_words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM found) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
"""
