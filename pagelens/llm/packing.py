"""Concatenate and cut: token streams packed into sequences of a fixed length.

First pass: every task encodes its documents, numbers them by the tokens before them in the task and
writes the ids. Second pass: prefix sums over the tasks' token totals give each task its place in the
one global stream, which is cut at multiples of the sequence length. A piece is the part of a document
between two cuts, with the record of where it begins and ends.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, one_thread, slices, stored, tidied
from pagelens.llm.fingerprints import SHORT, packed

LENGTH, SEPARATOR, TOKENIZER = 4096, 2, "word_bpe_49k.json"

#: Words whose ids a Python worker remembers (some 30 bytes each), the bytes of the longer of them, and the bytes of text it looks at together.
REMEMBERED, LONG_BYTES, BLOCK_BYTES = 2_000_000, 64 << 20, 1 << 20

BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = BLANK
    kinds[ord("a") : ord("z") + 1] = LETTER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[[c for c in range(33, 127) if not chr(c).isalnum() and c != ord("'")]] = SIGN
    return kinds


KINDS = _classes()
LOWER = np.array([c | 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, each distinct word encoded once.

    For vocabularies that lower-case, drop white space and mark the end of a word in its last token.
    They cut a text into runs of letters, single digits and runs of signs; where a stretch between
    blanks has only ASCII and Latin-1 characters of those kinds, these words are found for a whole
    block of texts at once and told by their bytes: short ones as numbers, longer ones in a dictionary. Any other stretch counts as one word, and
    the tokenizer cuts it. Other vocabularies get the texts as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_words = getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>" and "Lowercase" in str(self.tokenizer.normalizer)
        self.forget()

    def forget(self) -> None:
        self.keys, self.places, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self.pool, self.filled = np.zeros(1 << 16, "<u4"), 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out, held, size = [], [], 0
        for text in texts:
            data = text.encode()
            if held and size + len(data) > BLOCK_BYTES:
                out += self._block(held)
                held, size = [], 0
            if len(data) > BLOCK_BYTES:
                out.append(b"".join(b"".join(self._block([part])) for part in _cut(data)))
            else:
                held.append(data)
                size += len(data)
        return out + (self._block(held) if held else [])

    def _block(self, texts: list[bytes]) -> list[bytes]:
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, np.uint8)
        if not len(data):
            return [b""] * len(texts)
        if len(self.keys) > REMEMBERED or self.long_bytes > LONG_BYTES:
            self.forget()
        lower, starts, ends, other = _words(data)
        found, first, word = np.unique(self._known(lower, starts, ends), return_index=True, return_inverse=True)
        rows = self._rows(found, lower, starts[first], ends[first], other[first])[word]
        size = self.sizes[rows]
        total = np.cumsum(size)
        whole = self.pool[np.repeat(self.places[rows] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        cuts = np.append(0, total)[np.append(np.searchsorted(starts, begins), len(starts))]
        return [whole[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number for each word, the same for equal words only: its bytes, or its place among the longer ones."""
        sizes = ends - starts
        keys = packed(data, starts, sizes)
        far, raw, places = np.flatnonzero(sizes > SHORT), data.tobytes(), []
        for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True):
            word = raw[a:b]
            place = self.long.get(word)
            if place is None:
                place = self.long[word] = len(self.long)
                self.long_bytes += b - a
            places.append(place)
        keys[far] = np.array(places, np.uint64) | np.uint64(0xFF << 56)
        return keys

    def _rows(self, found: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Where the table has each of the words; new ones are encoded and put in."""
        at = np.searchsorted(self.keys, found)
        new = np.ones(len(found), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != found
        if new.any():
            strings = [data[a:b].tobytes().decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            ids, sizes = self._encoded(strings, other[new])
            if self.filled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.filled], np.zeros(max(len(self.pool), len(ids)), "<u4")])
            self.pool[self.filled : self.filled + len(ids)] = ids
            places = self.filled + np.cumsum(sizes) - sizes
            self.filled += len(ids)
            self.keys = np.insert(self.keys, at[new], found[new])
            self.places = np.insert(self.places, at[new], places)
            self.sizes = np.insert(self.sizes, at[new], sizes)
            at = np.searchsorted(self.keys, found)
        return at

    def _encoded(self, words: list[str], other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        sizes = np.zeros(len(words), np.int64)
        parts: list = [None] * len(words)
        plain, odd = np.flatnonzero(~other), np.flatnonzero(other)
        if len(plain):
            # One call for all: the last token of a word says that it ends.
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in plain])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(plain):
                odd, plain = np.arange(len(words)), plain[:0]
            else:
                for i, a, b in zip(plain.tolist(), [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    parts[i] = ids[a:b]
        if len(odd):
            for i, e in zip(odd.tolist(), self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, "<u4")
        sizes[:] = [len(p) for p in parts]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), sizes


def _cut(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end at blanks."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK_BYTES)
        end = len(data) if end < 0 else end + 1
        yield data[at:end]
        at = end


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, where words start and end, and which of them the tokenizer has to cut."""
    lower = LOWER[data]
    kinds = KINDS[lower]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    latin = lead[(after != 0x97) & (after != 0xB7)]  # all but the signs for times and division
    kinds[latin] = kinds[latin + 1] = LETTER
    capital = latin[data[latin + 1] < 0x9F] + 1
    lower[capital] |= 0x20
    kinds[np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))] = OTHER  # may begin a special token
    full = kinds != BLANK
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    odd = kinds == OTHER
    if odd.any():
        stretch = np.cumsum(begins)
        strange = np.zeros(stretch[-1] + 1, bool)
        strange[stretch[odd]] = True
        whole = strange[stretch] & full
        kinds[whole] = OTHER
        lower[whole] = data[whole]
    change = begins.copy()
    change[1:] |= full[1:] & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT))
    starts = np.flatnonzero(change)
    stops = full.copy()
    stops[:-1] &= ~full[1:] | change[1:]
    ends = np.flatnonzero(stops) + 1
    return lower, starts, ends, kinds[starts] == OTHER


@cache
def encoder(tokenizer: str) -> Encoder:
    """One per Python worker; workers serve many tasks."""
    one_thread()
    if not os.path.exists(tokenizer):
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return Encoder(tokenizer)


def tokenized(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """``doc_id, task, before, n, ids``: ids of each text with the separator, and its place in its task."""
    end = np.array([separator], "<u4").tobytes()

    @tidied
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 1):
                ids = [x + end for x in ids_of([t or "" for t in part.column(1).to_pylist()])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                places = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(n), task), pa.int32()), pa.array(places), pa.array(n), pa.array(ids, pa.binary())],
                    ["doc_id", "task", "before", "n", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        encode, "doc_id long, task int, before long, n long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``start`` is where the piece begins in its document, ``offset`` where it begins in its sequence,
    ``ids`` its tokens (little-endian unsigned 32-bit). Every token, the separator after each document
    among them, lies in exactly one piece; all sequences but the last are full.

    Null or empty text: the separator alone. Repeated rows are packed as often as they occur, null ids
    keep their null. Very long texts become pieces in many sequences. Empty table: no rows. Columns
    other than the id and the text are ignored. Documents stay in the order of the input's partitions;
    the first pass is written, so a retried task finds the same places.
    """
    tokens = stored(tokenized(docs, **how), "tokens")
    totals = tokens.groupBy("task").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # A row of 12 bytes for each task of the first pass, of which the driver holds far more already.
    bases = F.broadcast(totals.select("task", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base")))
    placed = tokens.join(bases, "task").withColumn("at", F.col("base") + F.col("before"))
    first, last = F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}")

    def piece(sequence):
        start = F.greatest(F.col("at"), sequence * length) - F.col("at")
        size = F.least(F.col("at") + F.col("n"), (sequence + 1) * length) - F.col("at") - start
        return F.struct(
            start.alias("start"), size.alias("length"),
            F.substring("ids", (start * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"),
            sequence.alias("sequence_id"), (F.col("at") + start - sequence * length).alias("offset"))

    pieces = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("piece"))
    return pieces.select("doc_id", "piece.start", "piece.length", "piece.ids", "doc_tokens", "piece.sequence_id", "piece.offset")


def sequences(pieces: DataFrame, length: int = LENGTH, padding: int = 0) -> DataFrame:
    """``sequence_id, ids, tokens``: pieces put together, padded to ``length`` tokens.

    A sequence has at most ``length`` pieces of one token, so its group is small.
    """
    whole = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    blank = F.lit(np.full(length, padding, "<u4").tobytes())
    joined = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return whole.select("sequence_id", F.substring(F.concat(joined, blank), F.lit(1), F.lit(length * 4)).alias("ids"), "tokens")


def digest(pieces: DataFrame, *more: str) -> DataFrame:
    """The pieces with a checksum of their ids, and ``more`` of their columns."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more)
