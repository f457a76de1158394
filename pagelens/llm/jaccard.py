"""Near duplicates by word shingles: prefix filtering under several global orders.

If two sets are similar enough, then under any one order of all shingles their first few (a prefix
whose length follows from the threshold) have one in common. The first order goes by how frequent a
shingle is in the corpus, rarest first, so that few sets meet; a second order mixes frequency classes
with another hash. Candidates must meet under both, and are verified on their whole sets. How frequent
shingles are is counted over the corpus in a table of fixed size: shingles that share a cell only get
a later place in the order, which costs work but no link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.common import bounded_batches, discard, free, slices, stored, tidied
from pagelens.llm.components import components
from pagelens.llm.fingerprints import mixed, of_ranges, of_runs

SHINGLE, PERCENT = 3, 90

#: Cells of the frequency table (as a power of two), and of one of its rows.
CELL_BITS, ROW_BITS = 22, 16
#: Sets that meet in one shingle are paired one by one up to this many; more are compared where they lie.
PAIRED = 32
#: Bytes of sets that are compared together; larger meetings are split, and each two parts compared.
MEETING_BYTES = 24 << 20
BROADCAST_ROWS = 500_000


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the runs of ``width`` words; of all words, if fewer.

    Words are parted by ASCII white space, A-Z are lower-cased.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return np.unique(of_runs(of_ranges(np.frombuffer(b" ".join(words), np.uint8), ends - sizes, ends), min(width, len(words))))


def set_id(found: np.ndarray) -> int:
    """64-bit id of a set; equal sets, and no others, are one class."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _cells(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(found: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set under both orders; ``found`` is sorted, which breaks ties alike everywhere."""
    seen, size = counts[_cells(found)].astype(np.uint64), prefix_size(len(found), percent)
    other = mixed(found + np.uint64(0x51ED270B))
    keys = (seen << np.uint64(40)) | (found >> np.uint64(24)), (np.log2(seen + np.uint64(1)).astype(np.uint64) << np.uint64(58)) | (other >> np.uint64(6))
    return tuple(found[np.argsort(key, kind="stable")[:size]] for key in keys)


def similar(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def count_cells(docs: DataFrame, width: int) -> np.ndarray:
    """How often the shingles of each cell occur, each once a document; a table of 16 MB whatever the corpus."""
    rows = 1 << (CELL_BITS - ROW_BITS)

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    if text:
                        np.add.at(counts, _cells(shingles(text, width)), 1)
        if counts.any():
            short = np.minimum(counts, 65535).astype("<u2").reshape(rows, -1)
            for row in range(rows):
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([short[row].tobytes()], pa.binary())], ["row", "counts"])

    @tidied
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(counts.as_buffer(), "<u2")
                sums[row] = sums[row] + new if row in sums else new.astype(np.int64)
        for row, total in sums.items():
            short = np.minimum(total, (1 << 24) - 1).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([short], pa.binary())], ["row", "counts"])

    schema = "row int, counts binary"
    added = docs.mapInArrow(count, schema).repartition("row").mapInArrow(add, schema)
    out = np.zeros((rows, 1 << ROW_BITS), np.uint32)
    for r in added.collect():
        out[r["row"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


def described(docs: DataFrame, id: str, text: str, width: int, percent: int) -> DataFrame:
    """``doc_id, n, set, first, second``, written: size and id of each text's set, its prefixes under both orders."""
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = docs.sparkSession.sparkContext.broadcast(count_cells(given.select("text"), width))

    @tidied
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sizes, ids, first, second = [], [], [], []
                for t in part.column(1).to_pylist():
                    found = shingles(t or "", width)
                    sizes.append(len(found))
                    ids.append(set_id(found) if len(found) else None)
                    a, b = prefixes(found, counts.value, percent) if len(found) else (found, found)
                    first.append(a.view(np.int64))
                    second.append(b.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(second, pa.list_(pa.int64()))],
                    ["doc_id", "n", "set", "first", "second"])

    return stored(given.mapInArrow(describe, "doc_id long, n long, set long, first array<long>, second array<long>"), "described")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _whole_sets(docs: DataFrame, id: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """``set, members``, written: the fingerprints of the sets of some documents, each set once."""

    @tidied
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = [f for t in part.column(0).to_pylist() if len(f := shingles(t or "", width))]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["set", "members"])

    wanted = _small(wanted)
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["rep"]), "left_semi").select("text")
    return _once(stored(texts.mapInArrow(build, "set long, members binary"), "sets"))


def _once(sets: DataFrame) -> DataFrame:
    """One row per set. They come from one document each; only rows that repeat its id make more."""
    if not sets.groupBy("set").count().filter("count > 1").limit(1).count():
        return sets
    out = stored(sets.dropDuplicates(["set"]), "sets")
    discard(sets)
    return out


def _verified(percent: int):
    """Streams ``a, b, members`` sorted by ``a`` and ``b``; the row of ``a`` itself, with no ``b``, comes first."""

    @tidied
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = np.frombuffer(members.as_buffer(), np.uint64)
                if b is None:
                    now, held = a, found
                elif a == now and similar(len(np.intersect1d(held, found, assume_unique=True)), len(held), len(found), percent):
                    out.append((a, b))
            yield _links(out)

    return verify


def _links(out: list) -> pa.RecordBatch:
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def spanning(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets: each newly reached set is compared with all not reached yet."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marks = np.zeros(token.max() + 1, bool)
    left = np.arange(len(sets))
    columns, begins = token, ends - sizes
    reached = np.zeros(len(sets), bool)
    links: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left):
        if reached[left].sum() * 2 > len(left):
            # Most are reached: go on with the others' tokens alone.
            left = left[~reached[left]]
            columns = np.concatenate([token[ends[i] - sizes[i] : ends[i]] for i in left]) if len(left) else token[:0]
            begins = np.cumsum(sizes[left]) - sizes[left]
            continue
        if not queue:
            start = left[~reached[left]]
            if not len(start):
                break
            reached[start[0]] = True
            queue.append(int(start[0]))
        x = queue.pop()
        own = token[ends[x] - sizes[x] : ends[x]]
        marks[own] = True
        common = np.add.reduceat(marks[columns].astype(np.int64), begins)
        marks[own] = False
        near = left[(100 * common >= percent * (sizes[left] + sizes[x] - common)) & ~reached[left]]
        reached[near] = True
        links += [(ids[x], ids[i]) for i in near.tolist()]
        queue += near.tolist()
    return links


def links(docs: DataFrame, all: DataFrame, id: str, text: str, width: int, percent: int) -> DataFrame:
    """``a, b``, written: links between sets that connect all that are connected."""
    # Copies leave their class by their ids, so that the prefixes stay where they were written.
    several = all.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).filter("rows > 1")
    several = _small(stored(several.select(F.col("set").alias("of"), "rep"), "several"))
    copies = all.filter("n > 0").select("set", "doc_id").join(several, F.col("set") == F.col("of")).filter(~F.col("doc_id").eqNullSafe(F.col("rep")))
    copies = _small(stored(copies.select("of", F.col("doc_id").alias("copy")).distinct(), "copies"))
    sets = all.filter("n > 0").join(copies, F.col("doc_id").eqNullSafe(F.col("copy")) & (F.col("set") == F.col("of")), "left_anti")
    sets = _once(stored(sets.select("set", "n", F.col("doc_id").alias("rep"), "first", "second"), "classes"))
    shared = Window.partitionBy("shingle")
    met = sets.select("set", "n", F.explode("first").alias("shingle")).withColumn("met", F.count("*").over(shared)).withColumn("total", F.sum("n").over(shared))
    met = stored(met.filter("met > 1"), "met")

    few = met.filter(F.col("met") <= PAIRED).select("shingle", "set", "n")
    a, b = few.select("shingle", F.col("set").alias("a"), F.col("n").alias("n_a")), few.select("shingle", F.col("set").alias("b"), F.col("n").alias("n_b"))
    sized = (F.col("a") < F.col("b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pairs = a.join(b, (a["shingle"] == b["shingle"]) & sized).select("a", "b").distinct()
    second = sets.select("set", "second")
    pairs = (pairs.join(second.select(F.col("set").alias("a"), F.col("second").alias("second_a")), "a")
             .join(second.select(F.col("set").alias("b"), F.col("second").alias("second_b")), "b")
             .filter(F.arrays_overlap("second_a", "second_b")).select("a", "b"))
    pairs = stored(pairs, "pairs")
    many = met.filter(F.col("met") > PAIRED)

    wanted = pairs.select(F.col("a").alias("set")).unionAll(pairs.select(F.col("b").alias("set"))).unionAll(many.select("set")).distinct()
    whole = _whole_sets(docs, id, text, stored(sets.join(wanted, "set", "left_semi").select("rep"), "wanted"), width)

    asked = pairs.select(F.col("b").alias("set"), "a", "b").unionAll(pairs.select(F.col("a").alias("set"), "a", F.lit(None).cast("long").alias("b")).distinct())
    asked = _small(stored(asked, "asked"))
    found = whole.join(asked, "set").select("a", "b", "members").repartition("a").sortWithinPartitions("a", "b").mapInArrow(_verified(percent), "a long, b long")

    parts = F.greatest(F.lit(1), F.ceil(F.col("total") * 8 / MEETING_BYTES)).cast("int")
    dealt = many.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("shingle", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "set")

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("set").to_pylist()
        own = [np.frombuffer(m.as_buffer(), np.uint64) for m in group.column("members")]
        return pa.Table.from_batches([_links(spanning(ids, own, percent) if len(ids) > 1 else [])])

    dealt = _small(stored(dealt, "dealt"))
    meetings = whole.join(dealt, "set").groupBy("shingle", "low", "high").applyInArrow(compare, "a long, b long")
    out = stored(found.unionAll(meetings).distinct(), "links")
    discard(sets, met, pairs, whole)
    return out


def _grouped(docs: DataFrame, id: str, text: str, width: int, percent: int) -> DataFrame:
    """``doc_id, n, set, root, component_id``, one row per document; no ``set`` and ``root`` where there are no shingles."""
    whole = described(docs, id, text, width, percent)
    found = links(docs, whole, id, text, width, percent)
    all = stored(whole.select("doc_id", "n", "set"), "sets-of-documents")
    discard(whole)
    roots = components(found)
    classes = all.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"))
    rooted = classes.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(lowest, "root").select("set", "root", "component_id")
    # Most classes are a single document's; the copies of one class are spread by the join's own splitting.
    out = all.select("doc_id", "n", "set").join(named, "set", "left")
    return out.select("doc_id", "n", "set", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per document.

    Documents link when ``100 * common >= percent * union`` for their sets of distinct shingles.
    ``component_id`` is the smallest id reachable over links, its own included. Equal sets are one
    class from the start, so copies, however many, are compared once; among sets that differ, every
    two that pass the filters are compared unless links found already connect them.

    Null and empty texts, and texts of white space, have no shingles, link with nothing and keep their
    own id. Texts of fewer than ``width`` words have their words as the one shingle. Repeated rows give
    repeated rows. A null id is reported as null and never the smallest, unless all of a component are.
    Very long texts are read whole. Empty table: no rows. Other columns are ignored.
    """
    out = _grouped(docs, id, text, width, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _with_sets(docs: DataFrame, text: str, width: int, name: str) -> DataFrame:
    """``docs`` with the id of each text's set as column ``name``; null where there are no shingles."""
    place, names = docs.columns.index(text), docs.columns

    @tidied
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                found = [shingles(t or "", width) for t in part.column(place).to_pylist()]
                ids = pa.array([set_id(f) if len(f) else None for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*names, name])

    return docs.mapInArrow(label, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest id.

    All columns stay, whatever their names. An id may stand for several texts, and be null: each text is decided
    on by its own component, where null ids come last and of several sets of one id one stays. Of rows equal in id
    and set one stays; so it does of rows that repeat an id without words, but null ids without words all stay.
    Null and empty texts are without words, very long ones are read whole. Empty table: no rows.
    """
    found = stored(_grouped(docs, id, text, width, percent).select("doc_id", "set", "root", "component_id"), "near-duplicates")
    own, labelled = F.col(id).cast("long"), free(docs, "_set")
    gone_id, gone_set = free(docs, "_gone"), free(docs, "_from")
    if not found.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        gone = _small(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(gone_id)))
        return docs.join(gone, own.eqNullSafe(F.col(gone_id)), "left_anti")
    texts = found.filter("set is not null")
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "set")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("kept"), F.col("first.set").alias("of"))
    gone = texts.select(F.col("doc_id").alias(gone_id), F.col("set").alias(gone_set)).distinct()
    gone = gone.join(kept, F.col(gone_id).eqNullSafe(F.col("kept")) & (F.col(gone_set) == F.col("of")), "left_anti")
    gone = _small(stored(gone, "gone"))
    out = _with_sets(docs, text, width, labelled)
    out = out.join(gone, own.eqNullSafe(F.col(gone_id)) & (F.col(labelled) == F.col(gone_set)), "left_anti")
    same = found.filter("doc_id is not null or set is not null").groupBy("doc_id", "set").count().filter("count > 1")
    if same.limit(1).count():
        apart = free(out, "_apart")
        wordless = F.when(F.col(id).isNull() & F.col(labelled).isNull(), F.monotonically_increasing_id())
        out = out.withColumn(apart, wordless).dropDuplicates([id, labelled, apart]).drop(apart)
    return out.drop(labelled)


ORACLE_SQL = r"""
WITH RECURSIVE given AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1),
    lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) END AS s FROM given
), classes AS (
  SELECT s, len(s) AS n, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s
), members AS (
  SELECT rep, n, unnest(s) AS x FROM classes
), common AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM members a JOIN members b ON a.x = b.x AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL
), linked AS (
  SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach(node, low) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT e.b, r.low FROM reach r JOIN both_ways e ON r.node = e.a WHERE r.low < e.b
), roots AS (
  SELECT node, min(low) AS low FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.low, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON s.s = c.s AND len(s.s) > 0 LEFT JOIN roots r ON r.node = c.rep
"""
