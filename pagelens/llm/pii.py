"""Personal data in texts, plain and disguised, at the characters of the source.

Plain identifiers are matched in the text itself. For disguised ones a chain of small transducers
rewrites the text (look-alike letters, full-width and foreign digits, invisible characters; digits
spelled as words; "at" and "dot" written out), and every character they put out keeps the source
characters it stands for. Identifiers found in the rewritten text are mapped back over that.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.common import bounded_batches, slices, tidied

KINDS = ("email", "ip", "card", "phone")

# ---- Plain identifiers. A run of digits or of an address is entered at its start only, where the
# leftmost match begins anyway, so a long run is read once rather than from each of its characters.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def is_ip(parts) -> bool:
    return all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in parts)


def is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(found: str) -> bool:
    return 9 <= len(DIGITS.findall(found)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` to the left as far as the characters allow, then the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def plain(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the identifiers in a text as it is, by start and then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if is_ip(m.groups())]
        out += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if is_card(m.group())]
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if is_phone(m.group())]
    return [(a, b, KINDS[k]) for a, k, b in sorted((a, k, b) for a, b, k in out)]


# ---- Transducers. A text under rewriting: its characters, and where each begins and ends in the source.
LETTERS = dict(zip(
    "аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαονικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijshdqwABEKMHOPCTXIJSaovikptuxABEZHIKMNOPTYX".replace(" ", ""), strict=True))
SIGNS = {"。": ".", "．": ".", "․": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "＠": "@", "﹫": "@", "＋": "+", " ": " ", " ": " ", " ": " "}
INVISIBLE = "­​‌‍⁠﻿‎‏"


def _folded(c: str) -> str:
    """What one character looks like in ASCII, if it imitates it."""
    if c in INVISIBLE:
        return ""
    found = LETTERS.get(c) or SIGNS.get(c)
    if found:
        return found
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    if "\U0001d400" <= c <= "\U0001d7ff":
        return unicodedata.normalize("NFKC", c)
    return c


#: The first of each ten decimal digits outside ASCII; they follow each other.
ZEROS = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.decimal(c, None) == 0]
FOLDS = re.compile("[" + "".join(map(re.escape, (*LETTERS, *SIGNS, *INVISIBLE))) + "！-～" + "".join(f"{z}-{chr(ord(z) + 9)}" for z in ZEROS) + "\U0001d400-\U0001d7ff]")

#: Names of the digits in the languages of the corpus.
SPELLED = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
    "oh": "0", "zwo": "2", "nought": "0",
}
NAME = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r"|[0-9]++)(?!\w)"
DOT = r"(?:dot|punto|punkt|point)"
BETWEEN = rf"(?:[\x20,()-]{{1,3}}|\.|[\x20]{DOT}[\x20])"
#: A run of at least this many spelled digits is a number; one with fewer if its figures are an address, a card or a phone.
LEAST_SPELLED = 7
SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus[\x20]|\+[\x20(]{{0,2}})?{NAME}(?:{BETWEEN}{NAME})++", re.I)
PIECE = re.compile(rf"plus|\+|(?P<dot>(?<=[\x20]){DOT}(?=[\x20])|\.)|{NAME}", re.I)
#: Pieces of the longest IP: twelve digits, three dots.
IP_PIECES = 15

OPEN, CLOSE = r"[\x20]{0,2}[(\[{<][\x20]{0,2}", r"[\x20]{0,2}[)\]}>][\x20]{0,2}"
AT_WORD = r"(?:at|arroba|arobase)"
BRACKET_AT, BRACKET_DOT = rf"{OPEN}(?:{AT_WORD}|@){CLOSE}", rf"{OPEN}(?:{DOT}|\.){CLOSE}"
BARE_AT, BARE_DOT = rf"[\x20]{AT_WORD}[\x20]|[\x20]{{1,2}}@[\x20]{{0,2}}|@[\x20]{{1,2}}", rf"[\x20]{DOT}[\x20]|[\x20]\.[\x20]"
LABEL = r"[A-Za-z0-9-]+"
#: An address with its at or its dots in disguise; a bare "at" counts only together with a disguised dot.
ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{BRACKET_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,4}}+"
    rf"(?:(?:{BRACKET_AT})(?:{LABEL})(?:(?:{BRACKET_DOT}|{BARE_DOT}|\.){LABEL})+"
    rf"|(?:{BARE_AT}|@)(?!(?:the|an?|this|that)[\x20])(?:{LABEL})(?:\.{LABEL})*(?:(?:{BRACKET_DOT}|{BARE_DOT}){LABEL}(?:\.{LABEL})*)+)", re.I)
SEPARATORS = re.compile(rf"(?P<at>{BRACKET_AT}|{BARE_AT}|@)|(?P<dot>{BRACKET_DOT}|{BARE_DOT})", re.I)
ADDRESS_HINT = re.compile(rf"[(\[{{<][\x20]{{0,2}}(?:{AT_WORD}|@)[\x20]{{0,2}}[)\]}}>]|(?<!\w){DOT}(?!\w)|[(\[{{<][\x20]{{0,2}}\.[\x20]{{0,2}}[)\]}}>]|[\x20]\.[\x20]", re.I)


class Rewritten:
    """A text with, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """Put strings in the place of ranges, which are in order and apart."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in changes:
            text += (self.text[at:a], new)
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(text), starts + self.starts[at:], ends + self.ends[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def fold(r: Rewritten) -> None:
    r.replace([(m.start(), m.end(), new) for m in FOLDS.finditer(r.text) if (new := _folded(m.group())) != m.group()])


def _figures(pieces: list[tuple]) -> str:
    return "".join(p[2] for p in pieces)


def _long(pieces: list[tuple]) -> bool:
    # The same word over and over is noise rather than a number.
    names = [p[3] for p in pieces if p[3] in SPELLED]
    return len(names) >= LEAST_SPELLED and len(set(names)) >= 2


def _shows(pieces: list[tuple]) -> bool:
    """Whether the figures are an IP, a phone with its plus, or a card."""
    found = _figures(pieces)
    if found.count(".") == 3 and "+" not in found:
        return (ip := IP.fullmatch(found)) is not None and is_ip(ip.groups())
    if not found or "." in found or len(set(found) - {"+"}) < 2:
        return False
    return is_phone(found) if found[0] == "+" else is_card(found)


def _numbers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """The parts of a run that are read as numbers: all of it, or else what within it is one."""
    if _shows(pieces):
        # Words beside a number that stands in figures alone aren't part of it.
        words = [p[3].isalpha() for p in pieces]
        first, last = words.index(False) if False in words else 0, len(words) - words[::-1].index(False) if False in words else len(words)
        if any(words[first:last]) or not _shows(pieces[first:last]):
            yield pieces
        return
    single = [list(g) for same, g in groupby(pieces, lambda p: len(p[2]) == 1) if same]
    if any(_long(part) for part in single):
        yield from filter(_long, single)
        return
    if _long(pieces):
        yield pieces
        return
    if pieces[0][2] == "+":
        for end in range(min(len(pieces) - 1, 16), 1, -1):
            if _shows(pieces[:end]):
                if any(p[3].isalpha() for p in pieces[:end]):
                    yield pieces[:end]
                return
    at = 0
    while sum(p[2] == "." for p in pieces[at : at + IP_PIECES]) >= 3 or at + IP_PIECES < len(pieces):
        end = next((e for e in range(min(at + IP_PIECES, len(pieces)), at + 6, -1) if _ends(pieces, at, e) and _shows(pieces[at:e])), None)
        if end and any(p[3].isalpha() for p in pieces[at:end]):
            yield pieces[at:end]
        at = end or at + 1


def _ends(pieces: list[tuple], start: int, end: int) -> bool:
    """Whether a part that looks like an IP is one of its own, not cut out of a longer dotted row."""
    return not (start and pieces[start - 1][2] == "." or end < len(pieces) and pieces[end][2] == ".")


def spelled_numbers(text: str) -> list[tuple[int, int, str, bool]]:
    """Where digits spelled as words, all or some of them, are numbers: ``start, end, figures``, and whether a long run."""
    out = []
    for run in SPELLED_RUN.finditer(text):
        pieces = []
        for m in PIECE.finditer(text, run.start(), run.end()):
            word = m.group().lower()
            pieces.append((m.start(), m.end(), "+" if word in ("plus", "+") else "." if m["dot"] else SPELLED.get(word, word), word))
        if not any(p[3].isalpha() for p in pieces):
            continue
        # A comma ends what has dots.
        cuts = [i for i in range(1, len(pieces)) if "," in text[pieces[i - 1][1] : pieces[i][0]]] if any(p[2] == "." for p in pieces) else []
        for a, b in zip([0, *cuts], [*cuts, len(pieces)], strict=True):
            out += [(part[0][0], part[-1][1], _figures(part), _long(part)) for part in _numbers(pieces[a:b])]
    return out


def read_digits(r: Rewritten, found: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
    """Spelled numbers to figures; returns where the long ones stand in the source, and their figures."""
    runs = [(*r.source(a, b), new) for a, b, new, long in found if long]
    r.replace([(a, b, new) for a, b, new, _ in found])
    return runs


def read_addresses(r: Rewritten) -> None:
    changes = []
    for found in ADDRESS.finditer(r.text):
        changes += [(found.start() + m.start(), found.start() + m.end(), "@" if m["at"] else ".") for m in SEPARATORS.finditer(found.group())]
    r.replace(changes)


def disguised(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifiers that show only after rewriting, some of them wider than what a plain one found."""
    folds = not text.isascii() and FOLDS.search(text) is not None
    spelled, address = [] if folds else spelled_numbers(text), ADDRESS_HINT.search(text) is not None
    if not (folds or spelled or address):
        return []
    r = Rewritten(text)
    if folds:
        fold(r)
        spelled = spelled_numbers(r.text)
    runs = read_digits(r, spelled)
    if address or folds:
        read_addresses(r)
    if r.text == text:
        return []
    out = [(*r.source(a, b), kind) for a, b, kind in plain(r.text)]
    # A spelled number as long as a phone's is one, also without its plus.
    held = {(a, b) for a, b, _ in out}
    for a, b, figures in runs:
        if is_phone(figures) and "." not in figures and not any(x < b and a < y for x, y in held):
            out.append((a, b, "phone"))
    # A span that a plain one covers adds nothing; a wider one of the same kind does.
    fresh, i = [], 0
    for a, b, kind in sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1])):
        while i < len(known) and known[i][1] <= a and known[i][0] < a - 256:
            i += 1
        touched = []
        for x, y, k in known[i:]:
            if x >= b:
                break
            if a < y:
                touched.append((x, y, k))
        wider = all(a <= x and y <= b and (x, y) != (a, b) and k == kind for x, y, k in touched)
        if wider and (a, b, kind) not in fresh[-8:]:
            fresh.append((a, b, kind))
    return fresh


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain and disguised identifiers of one text."""
    base = plain(text)
    return base, disguised(text, base)


SPANS = "array<struct<kind: string, start: long, end: long, disguised: boolean>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))


def _ordered(base, more):
    return sorted([(a, KINDS.index(k), b, False) for a, b, k in base] + [(a, KINDS.index(k), b, True) for a, b, k in more])


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: personal data of each text, by start and then kind; offsets in code points.

    Every text is read whole. Null or empty text: no spans. One row for each row of ``docs``, repeated
    or not, with null ids kept; other columns are ignored. Empty table: no rows.
    """

    @tidied
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "disguised": d} for a, k, b, d in _ordered(*spans(t or ""))]
                        for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, ARROW_SPANS)], ["doc_id", "spans"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(search, f"doc_id long, spans {SPANS}")


def masked(text: str) -> str:
    """A text with ``[EMAIL]`` and the like in the place of its spans; what overlaps is one place."""
    out, at = [], 0
    for a, k, b, _ in _ordered(*spans(text)):
        if b <= at:
            continue
        if a >= at:
            out += (text[at:a], f"[{KINDS[k].upper()}]")
        at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` with personal data masked in ``text`` and, if there is one, ``chars`` counted anew.

    All rows and columns stay; a null text stays null.
    """
    place, whole = docs.columns.index(text), [f.name for f in docs.schema.fields]

    @tidied
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                texts = [None if t is None else masked(t) for t in part.column(place).to_pylist()]
                columns = [part.column(i) for i in range(part.num_columns)]
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, whole)

    bounded_batches(docs.sparkSession)
    out = docs.mapInArrow(rewrite, T.StructType(docs.schema.fields))
    if chars in whole:
        out = out.withColumn(chars, F.char_length(text).cast(docs.schema[chars].dataType))
    return out


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: ~s["disguised"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> F.Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
