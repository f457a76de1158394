"""Spelling variants: words one edit apart, and the most frequent spelling they lead to.

A word is the vector of how often it has each letter. An inserted letter moves it by a squared distance of one, a
replaced one by two, so only pairs that near can be one edit apart. Words lie in blocks by how many letters they
have of each class of letters, which is also their length. An edit changes those numbers by at most one up and one
down: each word visits the few blocks it may have a longer or equally long neighbour in. There one matrix product
of letter counts gives all squared distances, and near pairs are verified letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import discard, stored, tidied
from pagelens.llm.decontam import lowered

LETTERS = r"([A-Za-zÀ-ÿ]+)"
#: Letters and occurrences a word has at least, how often a run loses a letter, and how much more frequent a form is.
SHORTEST, LEAST, LOSES, TIMES = 5, 3, 97, 2
#: Words of a block, and words that visit it, that are compared in one go (with their letters in bytes); larger blocks are cut into parts.
RESIDENTS, VISITORS, PART_BYTES = 4096, 32_768, 4 << 20
#: Distances that are in memory at once: rows and columns.
ROWS, COLUMNS = 1024, 4096
#: Rows up to which a side is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Classes of letters at most, and the bits of the number of words for each.
CLASSES, BITS_PER_CLASS = 12, 2.5


def occurrences(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``: all runs of letters with A-Z lowered; of some, told by a checksum of id and run, one letter is left out."""
    own = F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id")
    runs = docs.select(own, F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(LETTERS), F.lit(1))).alias("run")).select("id", lowered(F.col("run")).alias("run"))
    runs = runs.filter(F.char_length("run") >= SHORTEST).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring(F.col("run"), place + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % LOSES == 0, shorter).otherwise(F.col("run")).alias("word"))


def words(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``, written: distinct words of at least ``SHORTEST`` letters that occur ``LEAST`` times."""
    found = occurrences(docs, id, text).filter(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
    return stored(found.filter(F.col("n") >= LEAST), "words")


def classes(counted: DataFrame, size: int) -> np.ndarray:
    """A class for each letter (by its Latin-1 byte), each class with about as many occurrences in words as the others."""
    number = int(np.clip(round(np.log2(max(2, size)) / BITS_PER_CLASS), 4, CLASSES))
    letters = counted.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    out, load = np.zeros(256, np.int64), np.zeros(number)
    for r in letters.filter("letter != ''").orderBy(F.desc("n"), "letter").collect():  # some ninety letters
        own = int(load.argmin())
        out[ord(r["letter"])] = own
        load[own] += r["n"]
    out[0] = number - 1  # no letter: keeps the number of classes
    return out


def moves(number: int) -> np.ndarray:
    """What edits add to the counts of classes: nothing, a letter, or one letter for another of a later class."""
    one = np.eye(number, dtype=np.int64)
    swaps = [one[i] - one[j] for i in range(number) for j in range(i + 1, number)]
    return np.concatenate([np.zeros((1, number), np.int64), one, np.array(swaps).reshape(-1, number)])


def _keys(counts: np.ndarray) -> pa.Array:
    """Counts as bytes; in four bytes each where one is large, so that keys are equal for equal counts only."""
    if counts.max(initial=0) < 256:
        data = pa.py_buffer(counts.astype(np.uint8).tobytes())
        return pa.Array.from_buffers(pa.binary(counts.shape[1]), len(counts), [None, data]).cast(pa.binary())
    return pa.array([c.astype(np.uint8 if c.max() < 256 else "<u4").tobytes() for c in counts], pa.binary())


def placed(counted: DataFrame, of: np.ndarray) -> DataFrame:
    """``word, n, own, visits``: the key of a word's block, and of all that have its neighbours of its length or one more."""
    steps = moves(int(of[0]) + 1)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            codes = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
            rows = np.repeat(np.arange(len(texts)), sizes)
            counts = np.bincount(rows * steps.shape[1] + of[codes], minlength=len(texts) * steps.shape[1]).reshape(len(texts), steps.shape[1])
            visited = counts[:, None, :] + steps
            valid = (visited >= 0).all(axis=2)
            ends = np.append(0, np.cumsum(valid.sum(axis=1))).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(ends), _keys(visited[valid]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _keys(counts), visits], ["word", "n", "own", "visits"])

    return counted.select("word", "n").mapInArrow(run, "word string, n long, own binary, visits array<binary>")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def cells(counted: DataFrame, of: np.ndarray) -> DataFrame:
    """``block, p, q, own, word, n``: residents of a block in parts ``p``, each met by all parts ``q`` of its visitors.

    Residents visit their own block, too.
    """
    all = stored(placed(counted, of), "placed")
    residents = all.groupBy(F.col("own").alias("block")).agg(F.count("*").alias("r"), F.sum(F.char_length("word")).alias("letters"))
    residents = stored(residents, "residents")
    visits = all.select("word", "n", "own", F.explode("visits").alias("at"))
    visits = stored(visits.join(_small(residents.select("block")), F.col("at") == F.col("block")).select("block", "word", "n", "own"), "visits")
    visited = visits.groupBy("block").agg(F.count("*").alias("v"), F.sum(F.char_length("word")).alias("met"))
    parts = residents.join(visited, "block").select(
        "block", _parts("r", RESIDENTS, "letters").alias("ps"), _parts("v", VISITORS, "met").alias("qs"))
    parts = _small(stored(parts, "parts"))
    spread = F.xxhash64("word")
    come = visits.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), F.pmod(spread, F.col("qs")).cast("int").alias("q"),
                                              F.lit(False).alias("lives"), (F.col("own") == F.col("block")).alias("own"), "word", "n")
    live = all.withColumnRenamed("own", "block").join(parts, "block").select(
        "block", F.pmod(spread, F.col("ps")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.lit(True).alias("lives"), F.lit(True).alias("own"), "word", "n")
    return come.unionByName(live)


def _parts(rows: str, most: int, letters: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / most), F.ceil(F.col(letters) / PART_BYTES)).cast("int")


def _matrix(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return codes[starts[:, None] + np.arange(size)]


def _counts(letters: np.ndarray, column: np.ndarray, width: int, kind: type) -> np.ndarray:
    rows = np.repeat(np.arange(len(letters)), letters.shape[1]) * width
    return np.bincount(rows + column[letters].reshape(-1), minlength=len(letters) * width).reshape(len(letters), width).astype(kind)


def one_edit(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """For rows of letters of two equally long words, or one letter longer and shorter, whether one edit makes them alike.

    What they share from the left and from the right must cover all but one letter.
    """
    size, less = longer.shape[1], shorter.shape[1]
    left = np.cumprod(longer[:, :less] == shorter, axis=1, dtype=np.int32).sum(axis=1)
    right = np.cumprod((longer[:, size - less :] == shorter)[:, ::-1], axis=1, dtype=np.int32).sum(axis=1)
    return (left + right >= size - 1) & (left < size)


def near_pairs(codes: np.ndarray, starts: np.ndarray, size: int, visiting: np.ndarray, same: np.ndarray, less: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of residents and visitors one edit apart: residents of ``size`` letters, visitors of ``size - less``.

    ``same`` tells visitors that live in the block, too: their pairs count once, in the order of their letters.
    """
    if not len(starts) or not len(visiting) or not size - less:
        return
    resident, visitor = _matrix(codes, starts, size), _matrix(codes, visiting, size - less)
    present = np.unique(np.concatenate([np.unique(resident), np.unique(visitor)]))
    column = np.zeros(256, np.int64)
    column[present] = np.arange(len(present))
    kind = np.float32 if size < 2000 else np.float64  # squares stay exact
    a, b = (_counts(m, column, len(present), kind) for m in (resident, visitor))
    a_squares, b_squares = (a * a).sum(axis=1), (b * b).sum(axis=1)
    for i in range(0, len(a), ROWS):
        for j in range(0, len(b), COLUMNS):
            distance = a_squares[i : i + ROWS, None] + b_squares[j : j + COLUMNS] - 2 * (a[i : i + ROWS] @ b[j : j + COLUMNS].T)
            x, y = np.nonzero(distance == (1 if less else 2))
            step = max(1, PART_BYTES // size)
            for k in range(0, len(x), step):
                at, to = x[k : k + step] + i, y[k : k + step] + j
                good = one_edit(resident[at], visitor[to])
                at, to = at[good], to[good]
                if len(at) and not less:
                    # Both ways round among residents: the one with the smaller differing letter comes as visitor.
                    first = (resident[at] != visitor[to]).argmax(axis=1)
                    ahead = resident[at, first] > visitor[to, first]
                    at, to = at[ahead | ~same[to]], to[ahead | ~same[to]]
                if len(at):
                    yield at, to


def _cell(texts: list[str], counts: np.ndarray, lives: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    codes = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    residents = np.flatnonzero(lives)
    if not len(residents):
        return
    size = int(sizes[residents[0]])
    for less in (0, 1):
        visitors = np.flatnonzero(~lives & (sizes == size - less))
        for at, to in near_pairs(codes, starts[residents], size, starts[visitors], own[visitors], less):
            a, b = residents[at], visitors[to]
            yield pa.RecordBatch.from_arrays(
                [pa.array([texts[i] for i in a.tolist()], pa.string()), pa.array([texts[i] for i in b.tolist()], pa.string()), pa.array(counts[a]), pa.array(counts[b])], ["a", "b", "n_a", "n_b"])


@tidied
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells one after the other, from rows sorted by them; a cell may go on in the next batch."""

    def ready(table: pa.Table, last: bool) -> tuple[list[int], pa.Table]:
        """Where cells begin and end, and the rows of the one that may go on."""
        new = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            new[1:] = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (table.column(i).combine_chunks() for i in range(3))], axis=0)
        cuts = [*np.flatnonzero(new).tolist(), table.num_rows]
        return (cuts, table.slice(table.num_rows)) if last else (cuts[:-1], table.slice(cuts[-2]))

    def compared(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        lives, own, counts = (table.column(i).to_numpy() for i in (3, 4, 6))
        texts = table.column(5).to_pylist()
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield from _cell(texts[start:end], counts[start:end], lives[start:end], own[start:end])

    held: pa.Table | None = None
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if held is not None and held.num_rows and all(held.column(i)[0] == batch.column(i)[batch.num_rows - 1] for i in range(3)):
            continue  # the cell goes on
        table = pa.Table.from_batches(waiting)
        table = pa.concat_tables([held, table]) if held is not None else table
        waiting = []
        cuts, held = ready(table, False)
        yield from compared(table, cuts)
    if waiting:
        table = pa.Table.from_batches(waiting)
        held = pa.concat_tables([held, table]) if held is not None else table
    if held is not None and held.num_rows:
        yield from compared(held, ready(held, True)[0])


def near(counted: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b``, written: each two words one inserted, deleted or replaced letter apart, once."""
    of = classes(counted, counted.count())
    dealt = cells(counted, of).repartition("block", "p", "q").sortWithinPartitions("block", "p", "q")
    return stored(dealt.select("block", "p", "q", "lives", "own", "word", "n").mapInArrow(_compare, "a string, b string, n_a long, n_b long"), "near")


def forms(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n``: the near word of largest count, if that is ``TIMES`` the word's own."""
    both = pairs.select(F.col("a").alias("of"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionAll(
        pairs.select(F.col("b").alias("of"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("of").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    found = counted.join(best, F.col("word") == F.col("of"), "left")
    enough = -F.col("best.minus") >= TIMES * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: the last that forms lead to.

    Counts at least double from word to form, so 62 steps lead to the end of any way; each round doubles the steps.
    """
    held = stored(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        now = held.select("word", "root")
        further = _small(now.select(F.col("word").alias("mid"), F.col("root").alias("next")))
        new = stored(now.join(further, F.col("root") == F.col("mid"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(held)
        held = new
        if not new.filter("moved").limit(1).count():
            return new.select("word", "root")


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row for each distinct word.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lowered, with at least ``SHORTEST`` letters and
    ``LEAST`` occurrences; one in ``LOSES`` runs, told by the checksum of id and run, has lost a letter first. ``n_near``
    counts the words one edit apart, ``form`` is the most frequent of them (ties: first in code-point order) if it
    occurs at least ``TIMES`` as often, else null; ``root`` is where forms lead in the end, the word itself if nowhere.

    Null and empty texts have no words; null ids are written as nothing before the colon. Repeated rows count as often
    as they occur, long texts and words are read whole, other columns are ignored. Empty table: no rows.
    """
    counted = words(docs, id, text)
    pairs = near(counted)
    formed = stored(forms(counted, pairs), "forms")
    discard(pairs)
    ends = roots(formed)
    out = formed.join(_small(ends.withColumnRenamed("word", "at")), F.col("word") == F.col("at"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
