"""Pieces of DuckDB SQL shared by the checks: the test tables as a library, and text functions.

Written from the definitions, not from the Spark expressions: pairs are compared by brute force.
"""

from __future__ import annotations

from pagelens.sources.testdata import AS_OF_MS

AS_OF = str(AS_OF_MS)
DAY = "86400000::BIGINT"
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_WS = WS.replace("[", "[^", 1)


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split({collapse(x)}, ' '), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}')"


def in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def last_index(x: str, needle: str) -> str:
    at = f"strpos(reverse({x}), '{needle[::-1]}')"
    return f"(CASE WHEN {at} = 0 THEN -1 ELSE length({x}) - {at} - {len(needle) - 1} END)"


def excerpt(x: str) -> str:
    clean = collapse(x)
    head = f"substring({clean}, 1, 240)"
    at = last_index(head, " ")
    return (
        f"CASE WHEN length({clean}) <= 220 THEN {clean} WHEN {at} > 80 "
        f"THEN substring({head}, 1, {at}) || '…' ELSE {head} || '…' END"
    )


def query_words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{WS}+'), lambda w: length(w) > 1)"


def keyword_score(text: str, query: str) -> str:
    ws = query_words(query)
    return (
        f"(CASE WHEN len({ws}) = 0 THEN 0.0 ELSE "
        f"len(list_filter({ws}, lambda w: contains(lower({text}), w))) / len({ws})::DOUBLE END)"
    )


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '(?i)^https?://([^/?#:]+)', 1))"


def recency(ms: str) -> str:
    days = f"(({AS_OF} - {ms}) / 86400000.0)"
    return f"(CASE WHEN {days} <= 0 THEN 1.0 ELSE power(0.5, {days} / 18) END)"


DOCS = f"""docs AS (
  SELECT doc_id AS document_id, 'https://' || source || '.example/' || doc_id AS url,
    source || '.example' AS domain, substring(text, 1, 60) AS title, {excerpt('text')} AS summary,
    {AS_OF} - (doc_id % 90) * {DAY} AS visited_ms, (doc_id % 100) / 100.0::DOUBLE AS importance, text
  FROM documents)"""


def chunks(cap: int | None = None) -> str:
    limit = "" if cap is None else f"WHERE i < {cap}"
    return f"""split_docs AS (
  SELECT doc_id, text, {words('text')} AS ws FROM documents),
window_numbers AS (
  SELECT *, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 420 THEN 1
    ELSE ceil((len(ws) - 420) / 345.0)::BIGINT + 1 END)) AS i FROM split_docs),
windows AS (
  SELECT doc_id, text, i, array_to_string(ws[345 * i + 1 : 345 * i + 420], ' ') AS part
  FROM window_numbers {limit}),
chunks AS (
  SELECT doc_id AS document_id, doc_id * 1000000 + i AS chunk_id, i AS ord,
    CASE WHEN length(part) > 40 THEN part ELSE {strip('text')} END AS text
  FROM windows)"""


CHUNKS = chunks()

VISITS = """visits AS (
  SELECT e.user_id AS tenant_id, 'https://' || d.source || '.example/' || d.doc_id AS url,
    e.event_type AS title, d.source || '.example' AS hostname, epoch_us(e.ts) // 1000 AS visited_ms,
    epoch_us(e.ts) AS visited_us, d.n_chars AS text_length
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""

PAGE_VISITS = f"""page_visits AS (
  SELECT e.event_id AS seq, e.user_id AS tenant_id, p.url, {host('p.url')} AS domain,
    CASE WHEN e.event_type = 'error' THEN '' ELSE e.event_type || ' ' || p.page_id END AS title,
    e.props AS summary, epoch_us(e.ts) // 1000 AS visited_ms, epoch_us(e.ts) AS visited_us
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))"""

MESSAGES = f"""messages AS (
  SELECT conv_id AS conversation_id, conv_id * 1000000 + turn AS message_id, role,
    text AS content, {AS_OF} - (1000 - turn) * 60000 AS sent_ms
  FROM conversations WHERE role <> 'system')"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
