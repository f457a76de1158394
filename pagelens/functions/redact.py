"""Redaction of high-risk strings, built from regular expressions and a checksum in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import bind, ws

MASK = "[REDACTED]"

# Kinds in the order they are applied, with the pattern of each.
CARD = r"(?<![A-Za-z0-9_])(?:[0-9][ \t-]*?){13,19}(?![A-Za-z0-9_])"
PATTERNS = {
    "ssn": r"<b[0-9]{3}-[0-9]{2}-[0-9]{4}b>",
    "jwt": r"<beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+b>",
    "api_key": r"(?i)<b(sk-|pk_live_|pk_test_|api[_-]?key[_-]?)[A-Za-z0-9/_+=-]{16,}b>",
    "bearer": r"(?i)<bBearer<s>+[A-Za-z0-9_\-.]{20,}b>",
}
KINDS = ("credit_card", *PATTERNS)

# What every match holds: quicker to look for than the patterns, whose boundaries are tried at each character.
CARD_DIGITS = r"[0-9](?:[ \t-]*+[0-9]){12}"
SIGNS = {
    "ssn": lambda text: text.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "jwt": lambda text: F.contains(text, F.lit("eyJ")),
    "api_key": lambda text: _holds(text, "sk-", "pk_live_", "pk_test_", "apikey", "api_key", "api-key"),
    "bearer": lambda text: _holds(text, "bearer"),
}


def _holds(text: Column, *words: str) -> Column:
    """Whether any of the words occurs, in whatever case."""
    return bind(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in words]))


def _replaced(text: Column, kind: str) -> Column:
    return bind(text, lambda t: F.when(SIGNS[kind](t), F.regexp_replace(t, ws(PATTERNS[kind]), MASK)).otherwise(t))


def luhn_ok(run: Column) -> Column:
    """Checksum over the digits of one candidate card number."""
    digits = F.regexp_replace(run, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _cards(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CARD), F.lit(0))


def _mask_cards(text: Column) -> Column:
    """Mask valid numbers only; the pieces between candidates are put back in place."""
    pieces = F.split(text, CARD, -1)
    masked = F.transform(
        _cards(text), lambda run: F.when(luhn_ok(run), F.lit(MASK)).otherwise(run)
    )
    joined = F.zip_with(pieces, masked, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    # Most texts hold no candidate at all: skip the array work for them.
    return F.when(text.rlike(CARD_DIGITS) & text.rlike(CARD), F.array_join(joined, "")).otherwise(text)


def redact(text: Column) -> Column:
    return reduce(_replaced, PATTERNS, bind(text, _mask_cards))


def pii_types(text: Column) -> Column:
    """Kinds found, in the order applied; later kinds look at the text as masked so far."""
    def cards(t: Column) -> Column:
        return F.when(t.rlike(CARD_DIGITS) & F.exists(_cards(t), luhn_ok), F.array(F.lit("credit_card"))).otherwise(
            F.array().cast("array<string>"))

    def look(rest: list[str], masked: Column) -> Column:
        if not rest:
            return F.array().cast("array<string>")
        kind, *later = rest
        here = F.when(SIGNS[kind](masked) & masked.rlike(ws(PATTERNS[kind])), F.array(F.lit(kind))).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(here, bind(_replaced(masked, kind), lambda t: look(later, t)))

    return bind(text, lambda whole: F.concat(cards(whole), bind(_mask_cards(whole), lambda t: look(list(PATTERNS), t))))
