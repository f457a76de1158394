"""Checks: text functions, redaction, URL and policy rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.checks import sql as Q
from pagelens.checks.sql import AS_OF, CHUNKS, DOCS, VISITS, WS, with_
from pagelens.functions import policy as P
from pagelens.functions import questions as QU
from pagelens.functions import redact as RE
from pagelens.functions import text as T
from pagelens.functions import urls as U
from pagelens.model import Library, Policy
from pagelens.operators import chunks as C
from pagelens.operators import gate as G
from pagelens.sources import testdata as TD


def _ms(name):
    return F.unix_millis(name)


def library_documents(spark, sf):
    d = TD.documents(spark, sf)
    return d.select("document_id", "url", "domain", "title", "summary",
                    _ms("last_visited_at").alias("visited_ms"), "importance")


LIBRARY_DOCUMENTS = with_(DOCS) + (
    "SELECT document_id, url, domain, title, summary, visited_ms, importance FROM docs"
)


def chunk_windows(spark, sf):
    return TD.chunks(spark, sf).select(
        "document_id", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"))


CHUNK_WINDOWS = with_(CHUNKS) + "SELECT document_id, ord, md5(text) AS digest FROM chunks"


def chunk_windows_page_cap(spark, sf):
    raw = TD.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return C.chunk(raw, cap=C.PAGE_CAP).select(
        "document_id", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"))


CHUNK_WINDOWS_PAGE_CAP = with_(Q.chunks(36)) + "SELECT document_id, ord, md5(text) AS digest FROM chunks"


def _docs(spark, sf):
    return TD.table(spark, sf, "documents")


def excerpts(spark, sf):
    return _docs(spark, sf).select("doc_id", T.excerpt(F.col("text")).alias("summary"))


EXCERPTS = f"SELECT doc_id, {Q.excerpt('text')} AS summary FROM documents"


def _chrome(text):
    """Texts as a page would show them: with the phrases the cleaner looks for around them."""
    return F.concat(
        F.lit("Skip to main content 3 notifications Clicked  apply "), text,
        F.lit(" Job moved to archive today. Open candidate profile Home Jobs Me Messaging Home"),
    )


def noise(spark, sf):
    host = F.when(F.col("doc_id") % 2 == 0, "www.linkedin.com").otherwise("other.example")
    clean = T.strip_noise(_chrome(F.col("text")), host)
    return _docs(spark, sf).select("doc_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("digest"))


def _noise_sql():
    x = ("'Skip to main content 3 notifications Clicked  apply ' || text || "
         "' Job moved to archive today. Open candidate profile Home Jobs Me Messaging Home'")
    out = Q.collapse(x)
    for p in (r"\bskip to (?:main )?content\b", r"\bskip to search\b", rf"\bclicked?{WS}+apply\b",
              rf"[0-9]+{WS}+notifications?\b", r"\bJob moved to\b[^.]{0,120}\.",
              rf"\bUnder\b{WS}+Clicked apply\b", rf"\bOpen{WS}+(?:candidate{WS}+)?profile\b"):
        out = f"regexp_replace({out}, '(?i){p}', ' ', 'g')"
    menu = (rf"(?:\b(?:Home|My Network|Jobs|Messaging|Notifications|Me|For Business|Advertise)\b{WS}*){{4,}}")
    out = (f"CASE WHEN doc_id % 2 = 0 THEN regexp_replace({out}, '(?i){menu}', ' ', 'g') ELSE {out} END")
    return (f"SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM "
            f"(SELECT doc_id, {Q.collapse('t')} AS t FROM (SELECT doc_id, {out} AS t FROM documents))")


def _with_secrets(text):
    """Texts with one secret of each kind on every document of some residue class."""
    def on(n, secret):
        return F.when(F.col("doc_id") % n == 0, F.lit(secret)).otherwise(F.lit(""))

    return F.concat(
        on(2, "é123-45-6789 "), on(3, "eyJhbGci.eyJzdWIi.c2ln_nature "),
        on(5, "API_KEY_ABCDEFGH12345678= "), on(7, "bearer abcdefghij.klmnopqrst-uv "), text,
        on(11, " 4111 1111-1111 1111"), on(13, " 4111111111111112"),
    )


def redaction(spark, sf):
    text = _with_secrets(F.col("text"))
    return _docs(spark, sf).select(
        "doc_id", F.md5(RE.redact(text)).alias("digest"),
        F.array_join(RE.pii_types(text), ",").alias("kinds"))


def redaction_audit(spark, sf):
    found = _docs(spark, sf).select(RE.pii_types(_with_secrets(F.col("text"))).alias("pii_types"))
    return G.redaction_audit(found)


CARD = r"\b(?:[0-9][ \t-]*?){13,19}\b"
LUHN = ("(length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform("
        "string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''), lambda c, i: "
        "CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT * 2 > 9 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0)")
SECRETS = (
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"),
    ("api_key", r"(?i)\b(sk-|pk_live_|pk_test_|api[_-]?key[_-]?)[A-Za-z0-9/_+=-]{16,}\b"),
    ("bearer", rf"(?i)\bBearer{WS}+[A-Za-z0-9_\-.]{{20,}}\b"),
)


def _redacted_cte():
    def on(n, secret):
        return f"CASE WHEN doc_id % {n} = 0 THEN '{secret}' ELSE '' END"

    text = " || ".join([
        on(2, "é123-45-6789 "), on(3, "eyJhbGci.eyJzdWIi.c2ln_nature "),
        on(5, "API_KEY_ABCDEFGH12345678= "), on(7, "bearer abcdefghij.klmnopqrst-uv "), "text",
        on(11, " 4111 1111-1111 1111"), on(13, " 4111111111111112")])
    return with_(*redaction_steps(f"SELECT doc_id, {text} AS t FROM documents"))


def redaction_steps(source: str) -> list[str]:
    """CTEs that redact column ``t`` of ``source(doc_id, t)``; the last one is the result."""
    parts = [
        f"src AS ({source})",
        f"cut AS (SELECT doc_id, string_split_regex(t, '{CARD}') AS pieces, "
        f"regexp_extract_all(t, '{CARD}') AS runs FROM src)",
        "t0 AS (SELECT doc_id, array_to_string(list_transform(list_zip(pieces, runs), lambda z: z[1] || "
        f"coalesce(list_transform([z[2]], lambda m: CASE WHEN m IS NULL THEN NULL WHEN {LUHN} "
        "THEN '[REDACTED]' ELSE m END)[1], '')), '') AS t, "
        f"CASE WHEN len(list_filter(runs, lambda m: {LUHN})) > 0 THEN ['credit_card'] ELSE []::VARCHAR[] END AS kinds FROM cut)",
    ]
    for i, (kind, pattern) in enumerate(SECRETS):
        parts.append(
            f"t{i + 1} AS (SELECT doc_id, regexp_replace(t, '{pattern}', '[REDACTED]', 'g') AS t, "
            f"CASE WHEN regexp_matches(t, '{pattern}') THEN list_append(kinds, '{kind}') ELSE kinds END AS kinds FROM t{i})")
    return parts


def questions_gate(spark, sf):
    c = TD.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", P.valid_question(F.col("text")).alias("valid"))


URL_VARIANTS = (
    ("plain", "url", lambda u: u),
    ("bank", "replace(url, '.example.com', '.chase.com')", lambda u: F.replace(u, F.lit(".example.com"), F.lit(".chase.com"))),
    ("gov", "replace(url, '.example.net', '.city.gov')", lambda u: F.replace(u, F.lit(".example.net"), F.lit(".city.gov"))),
    ("social", "replace(url, '.example.org', '.linkedin.com')", lambda u: F.replace(u, F.lit(".example.org"), F.lit(".linkedin.com"))),
    ("login", "replace(url, '.example', '.example.co/Login/x.example')", lambda u: F.replace(u, F.lit(".example"), F.lit(".example.co/Login/x.example"))),
    ("hint", "replace(url, '.example.org/', '.example.org/myBank/')", lambda u: F.replace(u, F.lit(".example.org/"), F.lit(".example.org/myBank/"))),
    ("script", "'javascript:' || url", lambda u: F.concat(F.lit("javascript:"), u)),
    ("spaced", "'  ' || url || ' '", lambda u: F.concat(F.lit("  "), u, F.lit(" "))),
    ("broken", "'not ' || url", lambda u: F.concat(F.lit("not "), u)),
)


def _urls(spark, sf):
    """Every page address in nine shapes, so that each rule meets each page."""
    shapes = F.array(*[F.struct(F.lit(n).alias("shape"), f(F.col("url")).alias("url")) for n, _, f in URL_VARIANTS])
    return TD.table(spark, sf, "pages").select("page_id", F.explode(shapes).alias("s")).select(
        "page_id", "s.shape", "s.url")


URLS = "urls AS (" + " UNION ALL ".join(
    f"SELECT page_id, '{n}' AS shape, {s} AS url FROM pages" for n, s, _ in URL_VARIANTS) + ")"
# Test addresses are well formed, so the brute-force reading can stay simple.
PARTS = URLS + f""",
tidy AS (SELECT *, {Q.strip('url')} AS u FROM urls),
parts AS (SELECT *, regexp_matches(u, '(?i)^https?://[^/ ]+') AS web,
  CASE WHEN regexp_matches(u, '(?i)^https?://[^/ ]+') THEN {Q.host('u')} ELSE '' END AS host,
  regexp_extract(u, '(?i)^https?://[^/?#]+([^?#]*)', 1) AS path,
  regexp_extract(u, '(\\?[^#]+)', 1) AS query, regexp_extract(u, '(#.*)$', 1) AS frag FROM tidy)"""
WHOLE = "regexp_extract(u, '(?i)^(https?)://', 1) || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || query"


def url_parts(spark, sf):
    u = F.col("url")
    return _urls(spark, sf).select(
        "page_id", "shape", U.hostname(u).alias("host"), U.path_and_query(u).alias("path_query"),
        U.strip_fragment(u).alias("no_fragment"), U.safe_http(u).alias("safe"))


URL_PARTS = with_(PARTS) + f"""SELECT page_id, shape, host,
  CASE WHEN web THEN CASE WHEN path = '' THEN '/' ELSE path END || query END AS path_query,
  CASE WHEN web THEN {WHOLE} END AS no_fragment, CASE WHEN web THEN {WHOLE} || frag END AS safe FROM parts"""


def url_normal_forms(spark, sf):
    """Badly written addresses of every page: detours, blanks, quotes and letters outside ASCII."""
    host, id_ = U.hostname(F.col("url")), F.col("page_id")
    bad = F.concat(F.lit(" HTTPS://"), F.upper(host), F.lit(":443/x/../"), id_, F.lit("/./a b/%2E%2e/é{"), id_, F.lit('}/..a/.?q= "'), id_, F.lit("'#<top>"))
    pages = TD.table(spark, sf, "pages").select("page_id", host.alias("host"), bad.alias("bad")).filter("host <> ''")
    return pages.select("page_id", U.strip_fragment(F.col("bad")).alias("address"), U.path_and_query(F.col("bad")).alias("path_query"),
                        U.safe_http(F.col("bad")).alias("safe"))


URL_NORMAL_FORMS = f"""WITH h AS (SELECT page_id, {Q.host('url')} AS host FROM pages),
f AS (SELECT page_id, host, '/' || page_id || '/%C3%A9%7B' || page_id || '%7D/..a/?q=%20%22' || page_id || '%27' AS pq FROM h WHERE host <> '')
SELECT page_id, 'https://' || host || pq AS address, pq AS path_query, 'https://' || host || pq || '#%3Ctop%3E' AS safe FROM f"""


def length_gates(spark, sf):
    h = U.hostname(F.col("url"))
    return _urls(spark, sf).select(
        "page_id", "shape", P.min_chars(h).cast("long").alias("least"),
        P.min_capture_chars(h).cast("long").alias("least_capture"))


LENGTH_GATES = with_(PARTS) + """SELECT page_id, shape,
  CASE WHEN host LIKE '%linkedin.com%' THEN 32 WHEN host LIKE '%twitter.com%' OR host = 'x.com' THEN 40 ELSE 80 END::BIGINT AS least,
  CASE WHEN host LIKE '%linkedin.com%' THEN 28 WHEN host LIKE '%twitter.com%' OR host = 'x.com' THEN 38 ELSE 72 END::BIGINT AS least_capture
FROM parts"""


def skip_rules(spark, sf):
    u = F.col("url")
    return _urls(spark, sf).select(
        "page_id", "shape", G.registry_skip(u).alias("registry"),
        F.coalesce(P.sensitive(U.hostname(u), U.path(u)), F.lit(False)).alias("sensitive"))


_SKIP = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in P.SKIP_DOMAINS)
REGISTRY = (f"(web AND ({_SKIP} OR regexp_matches(path || query, "
            "'(?i)/checkout/|/payment/|/account/security|/login|/signin|/auth|/oauth')))")
SENSITIVE = ("(contains(host, 'accounts.google') AND contains(lower(path), 'signin') OR ends_with(host, '.gov') "
             "OR contains(host, '.mil') OR " + " OR ".join(
                 f"contains(host, '{x}') OR contains(lower(path), '{x}')" for x in P.SENSITIVE_HINTS) + ")")
SKIP_RULES = with_(PARTS) + f"SELECT page_id, shape, {REGISTRY} AS registry, {SENSITIVE} AS sensitive FROM parts"

BLOCKED, ALLOWED = ["example.net", " Thther.example.org "], ["example.com", "example.net", "city.gov", "example.org"]


def _rules(spark, domains):
    return spark.createDataFrame([(d,) for d in domains], "domain string")


def _policy(spark):
    return Policy(blocklist=_rules(spark, BLOCKED), allowlist=_rules(spark, ALLOWED), allowlist_only=True)


def policy_gate(spark, sf):
    return G.policy_reason(_urls(spark, sf), _policy(spark)).select("page_id", "shape", "reason")


def _listed(domains):
    names = [d.strip().lower() for d in domains]
    return "(" + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in names) + ")"


BAD_URL = "NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:')"
POLICY_GATE = with_(PARTS) + f"""SELECT page_id, shape, CASE WHEN {BAD_URL} THEN 'bad_url'
  WHEN {REGISTRY} THEN 'always_skip_registry' WHEN NOT {_listed(ALLOWED)} THEN 'allowlist'
  WHEN {_listed(BLOCKED)} THEN 'blocklist' WHEN {SENSITIVE} THEN 'sensitive_heuristic' END AS reason FROM parts"""


def domain_matches(spark, sf):
    hosts = _urls(spark, sf).select(U.hostname(F.col("url")).alias("host"))
    return G.match_domains(hosts, _rules(spark, BLOCKED))


DOMAIN_MATCHES = with_(PARTS) + f"SELECT DISTINCT host FROM parts WHERE {_listed(BLOCKED)}"


def url_status(spark, sf):
    docs = TD.documents(spark, sf)
    urls = _urls(spark, sf).select("shape", "url").unionByName(
        docs.select(F.lit("document").alias("shape"), "url"))
    policy = Policy(blocklist=_rules(spark, BLOCKED))
    found = G.url_status(urls, Library(docs, None, None), policy)
    return found.groupBy("shape", "status").agg(F.count("*").alias("urls"))


URL_STATUS = "WITH " + DOCS + ", " + URLS + f""",
every AS (SELECT shape, url FROM urls UNION ALL SELECT 'document', url FROM docs),
tidy AS (SELECT *, {Q.strip('url')} AS u FROM every),
parts AS (SELECT *, regexp_matches(u, '(?i)^https?://[^/ ]+') AS web,
  CASE WHEN regexp_matches(u, '(?i)^https?://[^/ ]+') THEN {Q.host('u')} ELSE '' END AS host,
  regexp_extract(u, '(?i)^https?://[^/?#]+([^?#]*)', 1) AS path,
  regexp_extract(u, '(\\?[^#]+)', 1) AS query FROM tidy)
SELECT shape, CASE WHEN {BAD_URL} THEN 'bad_url' WHEN NOT web THEN 'not_web'
  WHEN {REGISTRY} THEN 'skipped' WHEN {_listed(BLOCKED)} THEN 'blocked' WHEN {SENSITIVE} THEN 'sensitive'
  WHEN url IN (SELECT url FROM docs) THEN 'indexed' ELSE 'not_saved' END AS status, count(*) AS urls
FROM parts GROUP BY ALL"""


def settings_lines(spark, sf):
    """Every document read as a settings text with one rule per line."""
    return G.load_policy(_docs(spark, sf))


SETTINGS_LINES = f"""SELECT DISTINCT lower({Q.strip('line')}) AS domain
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {Q.strip('line')} <> ''"""


def titles_or(spark, sf):
    v = TD.page_visits(spark, sf)
    return v.select("seq", T.title_or(F.col("title"), F.lit(""), F.col("url")).alias("title"))


def conversation_titles(spark, sf):
    c = TD.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.conversation_title(F.col("text")).alias("title"),
                    T.truncate_words(F.col("text")).alias("short"))


CONVERSATION_TITLES = f"""SELECT conv_id, turn,
  substring(text, 1, 60) || CASE WHEN length(text) > 60 THEN '…' ELSE '' END AS title,
  CASE WHEN length(text) <= 800 THEN text
    ELSE regexp_replace(substring(text, 1, 800), '{WS}{Q.NOT_WS}*$', '') || '...' END AS short FROM conversations"""


def text_links(spark, sf):
    text = F.concat(F.col("url"), F.lit("), see <"), F.col("url"), F.lit("> "), F.col("html"))
    p = TD.table(spark, sf, "pages").withColumn("links", T.links(text))
    return p.select("page_id", F.size("links").cast("long").alias("n"), F.array_join("links", " ").alias("links"))


TEXT_LINKS = r"""SELECT page_id, len(l)::BIGINT AS n, array_to_string(l, ' ') AS links FROM (
  SELECT page_id, list_transform(regexp_extract_all(url || '), see <' || url || '> ' || html,
    '(?i)https?://[^\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}<>"{}|\\^`\[\]]+'),
    lambda u: regexp_replace(u, '[.,);!?]+$', '')) AS l FROM pages)"""


def snippets(spark, sf):
    lib = TD.library(spark, sf)
    both = lib.chunks.join(lib.documents.select("document_id", "title"), "document_id")
    ask = F.concat_ws(" ", F.reverse(F.split("title", " ")))
    return both.select("chunk_id", T.snippet(F.col("text"), ask).alias("snippet"))


SNIPPETS = "WITH " + DOCS + ", " + CHUNKS + f""",
a AS (SELECT chunk_id, {Q.collapse('c.text')} AS t,
  list_filter(list_transform(list_filter({Q.tokens("array_to_string(list_reverse(string_split(title, ' ')), ' ')")},
    lambda w: length(w) >= 3), lambda w: strpos(lower({Q.collapse('c.text')}), w)), lambda p: p > 0) AS places
  FROM chunks c JOIN docs USING (document_id)),
b AS (SELECT *, greatest(0, coalesce(places[1], 0) - 49) AS r FROM a),
c AS (SELECT *, {Q.last_index('substring(t, 1, r + 2)', '. ')} AS dot, {Q.last_index('substring(t, 1, r + 1)', ' ')} AS sp FROM b),
d AS (SELECT *, CASE WHEN r = 0 THEN 0 WHEN dot <> -1 AND r - dot < 100 THEN dot + 2
  WHEN sp <> -1 AND r - sp < 40 THEN sp + 1 ELSE r END AS s FROM c),
e AS (SELECT *, trim(substring(t, s + 1, 200)) AS part FROM d),
f AS (SELECT *, coalesce(list_min(list_filter(range(73, 176), lambda i:
  substring(part, i + 1, 1) IN ('.', '!', '?') AND substring(part, i + 2, 1) = ' ')) + 2, length(part)) AS cut,
  {Q.last_index('part', ' ')} AS blank FROM e),
g AS (SELECT *, CASE WHEN cut < length(part) - 12 THEN trim(substring(part, 1, cut))
  WHEN blank >= 100 THEN trim(substring(part, 1, blank)) ELSE part END AS short FROM f)
SELECT chunk_id, CASE WHEN t = '' THEN '' WHEN s + length(short) < length(t) OR s > 0 THEN short || '…' ELSE short END AS snippet FROM g"""

CHECKS = {
    "library_documents": (library_documents, LIBRARY_DOCUMENTS),
    "chunk_windows": (chunk_windows, CHUNK_WINDOWS),
    "chunk_windows_page_cap": (chunk_windows_page_cap, CHUNK_WINDOWS_PAGE_CAP),
    "excerpts": (excerpts, EXCERPTS),
    "noise_removal": (noise, _noise_sql()),
    "redaction": (redaction, _redacted_cte()
                  + f"SELECT doc_id, md5(t) AS digest, array_to_string(kinds, ',') AS kinds FROM t{len(SECRETS)}"),
    "redaction_audit": (redaction_audit, _redacted_cte()
                        + f"SELECT kind, count(*) AS texts FROM (SELECT unnest(kinds) AS kind FROM t{len(SECRETS)}) GROUP BY kind"),
    "question_gate": (questions_gate, "SELECT conv_id, turn, length(text) <= 12000 AS valid FROM conversations"),
    "url_parts": (url_parts, URL_PARTS),
    "url_normal_forms": (url_normal_forms, URL_NORMAL_FORMS),
    "length_gates": (length_gates, LENGTH_GATES),
    "skip_rules": (skip_rules, SKIP_RULES),
    "policy_gate": (policy_gate, POLICY_GATE),
    "domain_matches": (domain_matches, DOMAIN_MATCHES),
    "url_status": (url_status, URL_STATUS),
    "settings_lines": (settings_lines, SETTINGS_LINES),
    "title_fallback": (titles_or, with_(Q.PAGE_VISITS)
                       + "SELECT seq, CASE WHEN title <> '' THEN title ELSE url END AS title FROM page_visits"),
    "short_texts": (conversation_titles, CONVERSATION_TITLES),
    "text_links": (text_links, TEXT_LINKS),
    "snippets": (snippets, SNIPPETS),
}
