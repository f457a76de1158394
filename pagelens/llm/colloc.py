"""Collocations: phrases whose words go together more often than apart.

Each place in a text has one row: the word there and the ones that follow it in its piece, up to the longest
phrase, as lead columns that are empty beyond the piece's end. Only these longest windows are counted. A phrase of
fewer words occurs where a window begins with it, so ``ROLLUP`` over the columns sums the windows of each shorter
beginning. Before that, windows are cut where no candidate can go on: at words that are rare, between two words that
are rare together, and behind longer beginnings that are rare, as found where their windows lie side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, discard, stored, tidied
from pagelens.llm.fingerprints import mixed, of_ranges
from pagelens.operators.spread import top_n

LONGEST, LEAST, FIRST, PERCENT = 5, 100, 2000, 100
#: Frequent words whose fingerprints tasks get (8 bytes each); with more, windows aren't cut at rare words and have the fingerprints themselves.
VOCABULARY = 4_000_000
#: Frequent pairs of words that tasks get (8 bytes each); with more, windows aren't cut between two words.
PAIRS = 4_000_000
#: Rows up to which a side is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text that windows are counted in before they are handed on.
BLOCK_BYTES = 8 << 20
#: Windows that a task holds, to add up those of its blocks that are alike, before it hands them on.
HELD_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE_END, GAP = ".,;:!?\n\x0b\x0c\r", " \t"
ENDS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
#: The words of the longest windows; 0 where there is none.
LEADS = [f"w{i}" for i in range(1, LONGEST + 1)]

KINDS = np.zeros(256, np.uint8)
KINDS[list(GAP.encode())] = 1
KINDS[list(PIECE_END.encode())] = 2


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, word, n``, written: all words of all texts."""
    lowered = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    words = docs.select(language(F.col(lang)).alias("lang"), F.explode(F.split(lowered, r"[.,;:!?\x0A-\x0D\x20\x09]+")).alias("word")).filter("word != ''")
    return stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")


def fingerprinted(words: DataFrame) -> DataFrame:
    """``word, id``: each distinct word with its fingerprint."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [w.encode() for w in batch.column(0).to_pylist()]
            ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
            ids = of_ranges(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends[:-1]).astype(np.int64)[: len(ends)], ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids.view(np.int64))], ["word", "id"])

    return words.select("word").distinct().mapInArrow(run, "word string, id long")


def places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of some texts, and the number of each word's piece; texts end at a line's end."""
    low = np.frombuffer(data.lower(), np.uint8)
    kinds = KINDS[low]
    inside = np.concatenate([[False], kinds == 0, [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    return of_ranges(low, starts, ends), np.cumsum(kinds == 2)[starts]


def parts(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end where a piece does."""
    start = 0
    while start < len(data):
        end = ENDS.search(data, start + BLOCK_BYTES)
        end = end.end() if end else len(data)
        yield data[start:end]
        start = end


def leads(words: np.ndarray, pieces: np.ndarray, longest: int = LONGEST, pairs: np.ndarray | None = None) -> list[np.ndarray]:
    """The words at and after each place, 0 from where its piece or a run of frequent words (not 0) ends.

    With ``pairs``, sorted, a window ends between two words that are none of them.
    """
    joined = words[1:] if len(words) else words
    goes_on = (words[:-1] != 0) & (joined != 0) & (pieces[:-1] == pieces[1:])
    if pairs is not None and len(pairs):
        both = pair(words[:-1], joined)
        goes_on &= pairs[np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)] == both
    goes_on = np.append(goes_on, False)  # nothing follows the last word
    starts = np.flatnonzero(words != 0)
    out, going = [words[starts]], np.ones(len(starts), bool)
    for i in range(1, longest):
        before = np.minimum(starts + i - 1, len(words) - 1)
        going = going & goes_on[before]
        out.append(np.where(going, words[np.minimum(before + 1, len(words) - 1)], 0))
    return out


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two places in a vocabulary as one number."""
    return first << 32 | second


def counted(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows that are alike made one, with their number, or the sum of ``n``. Their hashes only bring them together: rows are compared by their words."""
    size = len(columns[0])
    hashes = np.zeros(size, np.uint64)
    for c in columns:
        hashes = mixed(hashes * np.uint64(0x9E3779B97F4A7C15) ^ c.view(np.uint64))
    order = np.argsort(hashes)
    columns = [c[order] for c in columns]
    new = np.ones(size, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, size)) if n is None else np.add.reduceat(n[order], first)
    return [c[first] for c in columns], times.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Languages and texts of some ``BLOCK_BYTES``."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for language, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in parts(value.as_buffer().to_pybytes()):
                held.setdefault(language, []).append(part)
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield from ((known, b"\n".join(texts)) for known, texts in held.items())
                    held, size = {}, 0
    yield from ((known, b"\n".join(texts)) for known, texts in held.items())


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(language(F.col(lang)).alias("lang"), F.col(text).cast("string").alias("text")).filter("text != ''")


def _numbers(found: np.ndarray, frequent: np.ndarray | None) -> np.ndarray:
    """Words as their places in ``frequent`` from 1 on, 0 for others; without it as their fingerprints."""
    if frequent is None:
        return np.where(found == 0, 1, found).view(np.int64)
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    return np.where(frequent[at] == found, at + 1, 0).astype(np.int64)


def _named(language: str, n: np.ndarray) -> pa.Array:
    return pa.array([language]).take(pa.array(np.zeros(len(n), np.int32)))


def frequent_pairs(docs: DataFrame, text: str, lang: str, frequent: np.ndarray, least: int) -> DataFrame:
    """``pair``, written: two words, as places in ``frequent``, that follow one another ``least`` times in some language."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, data in _blocks(batches):
            found, pieces = places(data)
            first, second = leads(_numbers(found, shared.value), pieces, 2)
            both, n = np.unique(pair(first, second)[second != 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([_named(language, n), pa.array(both), pa.array(n.astype(np.int64))], ["lang", "pair", "n"])

    each = _texts(docs, text, lang).mapInArrow(run, "lang string, pair long, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n"))
    return stored(each.filter(F.col("n") >= least).select("pair").distinct(), "pairs")


def held_windows(batches: Iterator[pa.RecordBatch], known: np.ndarray | None, pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The longest windows of a task's texts with their numbers, combined over its blocks as long as few enough are held."""
    held: dict[str, list[tuple[list[np.ndarray], np.ndarray]]] = {}

    def rows() -> int:
        return sum(len(n) for some in held.values() for _, n in some)

    def combined() -> None:
        for language, some in held.items():
            if len(some) > 1:
                columns = [np.concatenate(c) for c in zip(*(c for c, _ in some), strict=True)]
                held[language] = [counted(columns, np.concatenate([n for _, n in some]))]

    def handed() -> Iterator[pa.RecordBatch]:
        for language, some in held.items():
            for columns, n in some:
                yield pa.RecordBatch.from_arrays([_named(language, n), *map(pa.array, columns), pa.array(n)], ["lang", *LEADS, "n"])
        held.clear()

    for language, data in _blocks(batches):
        found, pieces = places(data)
        columns = leads(_numbers(found, known), pieces, pairs=pairs)
        if len(columns[0]):
            held.setdefault(language, []).append(counted(columns))
        if rows() >= HELD_ROWS:
            combined()
            if 2 * rows() >= HELD_ROWS:
                yield from handed()
    combined()
    yield from handed()


def windows(docs: DataFrame, text: str, lang: str, frequent: np.ndarray | None, pairs: np.ndarray | None = None) -> DataFrame:
    """``lang, w1 ... w5, n``: the longest windows, combined in each task.

    Words are their places in ``frequent``, sorted fingerprints, from 1 on; without it they are their fingerprints.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, pairs))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from held_windows(batches, *shared.value)

    return _texts(docs, text, lang).mapInArrow(run, f"lang string, {', '.join(f'{c} long' for c in LEADS)}, n long")


def pruned(all: DataFrame, least: int) -> DataFrame:
    """Windows cut behind their longest beginning of three or more words that occurs ``least`` times, and added up.

    Windows that share three words lie in one partition, so that their beginnings are summed there. Two words alone
    may have any share of all rows: they are left to the sum over all partitions.
    """
    near = all.repartition("lang", *LEADS[:3]).groupBy("lang", *LEADS).agg(F.sum("n").alias("n"))
    for size in range(LONGEST - 1, 2, -1):
        near = near.withColumn(f"n{size}", F.sum("n").over(Window.partitionBy("lang", *LEADS[:size])))
    totals = {LONGEST: "n"} | {size: f"n{size}" for size in range(3, LONGEST)}
    cut = [F.when(F.col(totals[i]) >= least, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) if i in totals else F.col(c) for i, c in enumerate(LEADS, 1)]
    return near.select("lang", *cut, "n").groupBy("lang", *LEADS).agg(F.sum("n").alias("n"))


def phrase_counts(longest: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, f``: all phrases, as arrays of words, that begin windows at least ``least`` times together."""
    size = F.lit(LONGEST) - F.expr("bit_count(grouping_id())")
    sums = longest.rollup("lang", *LEADS).agg(F.sum("n").alias("f"), size.cast("int").alias("size")).filter((F.col("size") > 0) & (F.col("f") >= least))
    phrase = F.slice(F.array(*LEADS), F.lit(1), F.col("size"))
    return sums.select("lang", phrase.alias("phrase"), "f").filter(F.element_at("phrase", -1) != 0)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of phrases of two words and more, by the cut with the lowest score."""
    candidates = phrases.filter(F.size("phrase") > 1).withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("rest", F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")))
    known = _small(phrases.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "f"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known, (F.col("lang") == F.col("of")) & (F.col(part) == F.col("part"))).withColumnRenamed("f", name).drop("of", "part", part)
    cuts = cuts.join(_small(totals), "lang")
    # 38 digits: counts up to 10**17 are exact. The quotient is at most ten times n.
    score = F.expr("cast(1000 AS decimal(4,0)) * cast(a AS decimal(18,0)) * cast(n AS decimal(18,0)) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return best.select("lang", "phrase", *[f"cut.{c}" for c in ("a", "l", "r", "n", "score")])


def outer(scored_phrases: DataFrame, percent: int) -> DataFrame:
    """Without phrases inside a longer candidate that has ``percent`` of their occurrences.

    A longer candidate around a phrase has one of just one word more inside, at least as frequent, so those are enough.
    """
    words = F.size("phrase")
    inside = F.explode(F.array(F.slice("phrase", F.lit(1), words - 1), F.slice("phrase", F.lit(2), words - 1))).alias("within")
    longer = scored_phrases.filter(words > 2).select(F.col("lang").alias("of"), inside, "a").groupBy("of", "within").agg(F.max("a").alias("around"))
    joined = scored_phrases.join(longer, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("within")), "left")
    return joined.filter("around IS NULL" + f" OR {int(percent)} * a > 100 * around").drop("of", "within", "around")


def spelled(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Phrases as text: their words' fingerprints looked up, parted by blanks."""
    each = phrases.select(F.col("lang").alias("of"), F.col("phrase").alias("ids"), F.posexplode("phrase").alias("at", "id")).join(_small(vocabulary), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    texts = each.groupBy("of", "ids").agg(text.alias("text"))
    return phrases.join(texts, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("ids"))).select(
        "lang", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = FIRST, percent: int = PERCENT,
                 vocabulary_rows: int = VOCABULARY, pair_rows: int = PAIRS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` phrases of each language by score, count and spelling.

    A candidate has two to five words of one piece (``.,;:!?`` and line ends part pieces, blanks and tabs words;
    A-Z count as a-z) and occurs ``a >= least`` times. Of its cuts in two, with counts ``l`` and ``r``, the one with the
    lowest ``1000 * a * n / (l * r)``, rounded down, counts; ``n`` is the number of words of its language. A candidate goes
    if a longer one around it has ``percent`` of its occurrences.

    Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as they occur, long
    texts are read whole, ties go by the spelling's bytes, other columns are ignored. Empty table: no rows. Words are
    told apart by 64-bit fingerprints; if two frequent ones had the same, ValueError is raised.
    """
    counts = word_counts(docs, text, lang)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary = stored(fingerprinted(counts.filter(F.col("n") >= least)), "vocabulary")
    size = vocabulary.count()
    if vocabulary.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("two frequent words have the same fingerprint")
    frequent = pairs = None
    if size <= vocabulary_rows:
        frequent = np.sort(vocabulary.select("id").toPandas()["id"].to_numpy(np.int64).view(np.uint64))
        if not size:
            frequent = np.zeros(1, np.uint64)
        together = frequent_pairs(docs, text, lang, frequent, least)
        if together.limit(pair_rows + 1).count() <= pair_rows:
            pairs = np.append(np.int64(-1), np.sort(together.toPandas()["pair"].to_numpy(np.int64)))
        discard(together)
    longest = stored(pruned(windows(docs, text, lang, frequent, pairs), least), "longest")
    phrases = stored(_as_fingerprints(phrase_counts(longest, least), frequent), "phrases")
    best = stored(scored(phrases, totals), "scored")
    named = spelled(outer(best, percent), vocabulary)
    out = top_n(named, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], first, "phrase")
    discard(longest)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _as_fingerprints(phrases: DataFrame, frequent: np.ndarray | None) -> DataFrame:
    """Places in ``frequent`` turned back into fingerprints."""
    if frequent is None:
        return phrases
    shared = phrases.sparkSession.sparkContext.broadcast(frequent)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids = shared.value[lists.flatten().to_numpy() - 1].view(np.int64)
            sizes = np.append(0, np.cumsum(lists.value_lengths().to_numpy())).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(ids)), batch.column(2)], ["lang", "phrase", "f"])

    return phrases.mapInArrow(run, "lang string, phrase array<long>, f long")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), phrases AS (
  SELECT lang, p, count(*) AS f FROM (
    SELECT lang, list_slice(w, i, i + k - 1) AS p FROM (
      SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * c.f * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM phrases WHERE len(p) > 1) c
  JOIN phrases x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k)
  JOIN phrases y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, len(c.p))
  JOIN totals t ON t.lang = c.lang
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, unnest(list_transform(range(1, len(p) - size + 2), lambda i: list_slice(p, i, i + size - 1))) AS p, f
  FROM (SELECT lang, p, f, unnest(range(2, len(p))) AS size FROM phrases WHERE len(p) > 2)
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN (SELECT lang, p, max(f) AS f FROM inner_parts GROUP BY ALL) i ON i.lang = s.lang AND i.p = s.p
  WHERE i.f IS NULL OR 100 * i.f < 100 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
