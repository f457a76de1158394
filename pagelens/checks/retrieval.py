"""Checks: term statistics, scores, vector search and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.checks import sql as Q
from pagelens.checks.sql import AS_OF, CHUNKS, DAY, DOCS, VISITS, WS
from pagelens.functions import questions as QU
from pagelens.functions import scoring as S
from pagelens.functions import text as T
from pagelens.operators import ranking as R
from pagelens.operators import vectors as V
from pagelens.operators.spread import broadcast_if_small
from pagelens.plans import index as I
from pagelens.plans import search as SE
from pagelens.session import materialise
from pagelens.sources import testdata as TD


def _round(name):
    return F.round(name, 6).alias(name)


def _corpus(spark, sf):
    lib = TD.library(spark, sf)
    return I.corpus(lib.documents, lib.chunks)


def chunk_corpus(spark, sf):
    return _corpus(spark, sf).select("document_id", "chunk_id", F.md5("corpus").alias("digest"))


def corpus_stats(spark, sf):
    lib = TD.library(spark, sf)
    return I.corpus_stats(I.chunk_lengths(lib.documents, lib.chunks)).select("n", _round("avgdl"))


def term_frequencies(spark, sf):
    """Terms of every chunk, summed up per chunk."""
    lib = TD.library(spark, sf)
    own = F.col("term") != I.WHOLE_CHUNK
    rows = I.term_freq(lib.documents, lib.chunks).groupBy("document_id", "chunk_id").agg(
        F.max(F.when(~own, F.col("tf"))).alias("dl"), F.count_if(own).alias("terms"),
        F.sum(F.when(own, F.col("tf"))).cast("long").alias("occurrences"), F.max(F.when(own, F.col("tf"))).alias("most"))
    return rows.filter("terms > 0").drop("document_id")


def document_frequencies(spark, sf):
    lib = TD.library(spark, sf)
    rows = I.term_freq(lib.documents, lib.chunks).filter(F.col("term") != I.WHOLE_CHUNK)
    n = lib.chunks.count()
    return I.doc_freq(rows).select(
        "term", "df", F.round(S.idf(F.lit(float(n)), F.col("df")), 6).alias("idf"))


def _opened(spark, sf):
    """All matched pairs, none left out by bounds."""
    lib = TD.library(spark, sf)
    block = SE.open_block(SE.prepare_queries(TD.queries(spark, sf), TD.as_of()))
    chunks = materialise(SE.scanned(lib, block))
    asked = SE.with_extremes(SE.weighed(chunks, block), chunks)
    facts = SE.document_facts(lib, block, TD.as_of())
    return SE.spans_of(spark, asked), SE.matched_pairs(asked, chunks, facts, lib, SE.MAX_HITS)


def pair_counts(found, terms):
    """Terms a query and a chunk share, and how often they occur; a chunk's rows lie together, so pairs are added up without a shuffle."""
    return (
        found.join(broadcast_if_small(terms), "key")
        .groupBy("query_id", "document_id", "chunk_id")
        .agg(F.count("*").alias("terms"), F.sum("tf").cast("long").alias("occurrences")).drop("document_id")
    )


def term_matches(spark, sf):
    """Inverted join of query terms and chunk terms."""
    lib = TD.library(spark, sf)
    block = SE.open_block(SE.prepare_queries(TD.queries(spark, sf), TD.as_of()))
    terms = block.queries.select("query_id", F.explode("terms").alias("key"))
    return pair_counts(SE.signals(lib, block, None).filter("kind = 'term'"), terms)


def bm25_scores(spark, sf):
    spans, pairs = _opened(spark, sf)
    scored = pairs.filter("bm25 > 0").join(F.broadcast(spans), "query_id")
    return scored.select(
        "query_id", "chunk_id", _round("bm25"),
        F.round(S.min_max(F.col("bm25"), F.col("low"), F.col("high")), 6).alias("share"))


def title_scores(spark, sf):
    _, pairs = _opened(spark, sf)
    return pairs.filter("title > 0").select("document_id", "query_id", _round("title")).distinct()


def semantic_neighbours(spark, sf):
    """Ten nearest vectors of every vector."""
    vectors = TD.table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return V.semantic_top_k(vectors, asked, 10).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "vec_id", _round("cosine"))


COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
SEMANTIC_NEIGHBOURS = f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {COSINE} AS c
  FROM embeddings a, embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 10) DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, round(c, 6) AS cosine FROM r WHERE rank <= 10"""


def profile_scores(spark, sf):
    """The two other scoring profiles: each chunk, asked for its document's domain and title."""
    lib = TD.library(spark, sf)
    first = lib.chunks.select("document_id", "chunk_id", "text", F.col("embedding").alias("b"))
    other = TD.table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 1).alias("document_id"), F.col("embedding").alias("a"))
    rows = first.join(lib.documents, "document_id").join(other, "document_id", "left")
    ask = F.concat_ws(" ", F.col("domain"), F.col("title"))
    kw, tm = S.keyword_score(F.col("text"), ask), S.title_match(F.col("title"), F.col("summary"))
    rec, cos = S.recency(F.col("last_visited_at"), TD.as_of()), S.cosine(F.col("a"), F.col("b"))
    scored = rows.select("document_id", "chunk_id", "importance", kw.alias("keyword"), tm.alias("title_match"),
                         rec.alias("recency"), cos.alias("cosine"))
    c = F.col
    return scored.select(
        "document_id", "chunk_id", _round("keyword"), _round("title_match"), _round("recency"), _round("cosine"),
        F.round(S.profile_hybrid(c("cosine"), c("keyword"), c("title_match"), c("recency")), 6).alias("hybrid"),
        F.round(S.profile_production(c("cosine"), c("keyword"), c("title_match"), c("recency"), c("importance")), 6).alias("production"))


PROFILE_SCORES = "WITH " + DOCS + ", " + CHUNKS + f""",
x AS (SELECT c.document_id, c.chunk_id, d.importance AS e, {Q.keyword_score('c.text', "d.domain || ' ' || d.title")} AS k,
  {Q.keyword_score('d.title', 'd.summary')} AS t, {Q.recency('visited_ms')} AS r,
  coalesce({COSINE}, 0.0) AS c
  FROM chunks c JOIN docs d USING (document_id) LEFT JOIN embeddings b ON b.vec_id = c.document_id AND c.ord = 0
  LEFT JOIN embeddings a ON a.vec_id = c.document_id - 1)
SELECT document_id, chunk_id, round(k, 6) AS keyword, round(t, 6) AS title_match, round(r, 6) AS recency, round(c, 6) AS cosine,
  round(CASE WHEN c > 0.02 THEN 0.58*c + 0.17*k + 0.13*t + 0.12*r ELSE 0.52*k + 0.28*t + 0.2*r END, 6) AS hybrid,
  round(CASE WHEN c > 0.02 THEN 0.55*c + 0.25*(0.82*k + 0.18*t) + 0.1*r + 0.1*e
    ELSE 0.42*(0.82*k + 0.18*t) + 0.33*r + 0.25*e END, 6) AS production FROM x"""

# -- queries as text, in four styles -----------------------------------------------------------


def plain_queries(spark, sf):
    return TD.queries(spark, sf)


def vector_queries(spark, sf):
    return TD.queries(spark, sf, vectors=True)


def ranged_queries(spark, sf):
    """Each query with a window of its own; the last days of them hold no visit at all."""
    start = F.lit(TD.AS_OF_MS) - (F.col("query_id") % 7) * QU.DAY_MS * 4
    end = start + F.when(F.col("query_id") % 7 == 0, 3_600_000).otherwise(QU.DAY_MS)
    return TD.queries(spark, sf, vectors=True).withColumns({"start_ms": start, "end_ms": end})


def windowed_queries(spark, sf):
    """Each query with a window that no other has, from an hour to months, some of them empty."""
    start = F.lit(TD.AS_OF_MS) - (F.col("query_id") + 1) * 51_234_567
    end = start + F.col("query_id") * 7_654_321 + F.when(F.col("query_id") % 5 == 0, -86_400_000).otherwise(3_600_001)
    return TD.queries(spark, sf).withColumns({"start_ms": start, "end_ms": end})


def named_queries(spark, sf):
    """Queries that name things: a quoted phrase of the passage, a company, LinkedIn, yesterday."""
    head = F.regexp_extract("text", "^([^ ]+ [^ ]+)", 1)
    asked = F.concat(
        F.lit("who works at "), F.regexp_extract("text", "^[^ ]+ ([A-Za-z]+)", 1), F.lit(' on linked in "'), head,
        F.lit('" '), F.when(F.col("query_id") % 2 == 0, F.lit("yesterday ")).otherwise(F.lit("")), F.col("text"))
    return TD.queries(spark, sf).withColumn("text", asked)


PLAIN = "SELECT item_id AS query_id, text, NULL::FLOAT[] AS vector, NULL::BIGINT AS start_ms, NULL::BIGINT AS end_ms FROM benchmark"
WITH_VECTOR = PLAIN.replace("NULL::FLOAT[]", "e.embedding").replace(
    "FROM benchmark", "FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id")
RANGED = WITH_VECTOR.replace("NULL::BIGINT AS start_ms", f"{AS_OF} - (item_id % 7) * {DAY} * 4 AS start_ms").replace(
    "NULL::BIGINT AS end_ms", f"{AS_OF} - (item_id % 7) * {DAY} * 4 + CASE WHEN item_id % 7 = 0 THEN 3600000 ELSE {DAY} END AS end_ms")
WINDOWED = PLAIN.replace("NULL::BIGINT AS start_ms", f"{AS_OF} - (item_id + 1) * 51234567 AS start_ms").replace(
    "NULL::BIGINT AS end_ms", f"{AS_OF} - (item_id + 1) * 51234567 + item_id * 7654321 + CASE WHEN item_id % 5 = 0 THEN -86400000 ELSE 3600001 END AS end_ms")
NAMED = PLAIN.replace("text,", """'who works at ' || regexp_extract(text, '^[^ ]+ ([A-Za-z]+)', 1) || ' on linked in "' ||
  regexp_extract(text, '^([^ ]+ [^ ]+)', 1) || '" ' || CASE WHEN item_id % 2 = 0 THEN 'yesterday ' ELSE '' END || text AS text,""")

STOP = ", ".join(f"'{w}'" for w in QU.ENTITY_STOP)
ORG = r"([A-Za-z0-9][A-Za-z0-9&.+\-]{1,48})\b"
FORMS = (
    rf"(?i)\bworks?{WS}+at{WS}+" + ORG, rf"(?i)\bworks?{WS}+in{WS}+" + ORG,
    rf"(?i)\bemployed{WS}+(?:by|at){WS}+" + ORG, rf"(?i)\bcompany{WS}+" + ORG,
    rf"(?i)\bat{WS}+([A-Za-z][A-Za-z0-9&.+\-]{{2,48}}){WS}+(?:yesterday|today|profile)",
)


def entities_sql(x: str) -> str:
    found = [f"regexp_extract_all({x}, '\"([^\"]{{2,120}})\"', 1)"]
    found += [f"CASE WHEN regexp_matches({x}, '{p}') THEN [regexp_extract({x}, '{p}', 1)] ELSE []::VARCHAR[] END" for p in FORMS]
    found.append(f"regexp_extract_all({x}, '\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b')")
    joined = "list_concat(" + ", list_concat(".join(found[:-1]) + ", " + found[-1] + ")" * (len(found) - 1)
    trimmed = f"list_transform({joined}, lambda t: {Q.strip('t')})"
    return (f"list_filter({trimmed}, lambda t, i: list_position({trimmed}, t) = i AND length(t) >= 2 "
            f"AND lower(t) NOT IN ({STOP}))")


def range_sql(x: str) -> str:
    y = f"({AS_OF} - {DAY}) // {DAY} * {DAY}"
    t = f"{AS_OF} // {DAY} * {DAY}"
    low = f"lower({x})"
    return f"""CASE WHEN regexp_matches({low}, '\\byesterday\\b') THEN [{y}, {y} + {DAY} - 1]
    WHEN regexp_matches({low}, '\\btoday\\b') THEN [{t}, least({AS_OF}, {t} + {DAY} - 1)]
    WHEN regexp_matches({low}, '\\blast{WS}*week\\b') THEN [{AS_OF} - 7 * {DAY}, {AS_OF}]
    WHEN regexp_matches({low}, '\\blast{WS}*month\\b') THEN [{AS_OF} - 30 * {DAY}, {AS_OF}] END"""


NORMAL = f"regexp_replace(regexp_replace({Q.strip('text')}, '(?i)linked{WS}*in', 'linkedin', 'g'), '(?i)linked-in', 'linkedin', 'g')"
PROFILE = rf"(?i)\b(profile|linkedin|connection|who{WS}+works|employee)\b"


def search_ctes(asked: str, k: int = 28) -> str:
    """Every query against every chunk, as the definitions say."""
    return "WITH " + DOCS + ", " + CHUNKS + ", " + VISITS + f""",
asked AS ({asked}),
norm AS (SELECT *, {NORMAL} AS q FROM asked),
named AS (SELECT *, {entities_sql('q')} AS entities, regexp_matches(q, '{PROFILE}') AS wants_profile,
  CASE WHEN start_ms IS NOT NULL THEN [start_ms, end_ms] ELSE {range_sql('q')} END AS span FROM norm),
qs AS (SELECT *, {Q.in_order(Q.tokens("q || CASE WHEN len(entities) > 0 THEN chr(10) || ' ' || array_to_string(entities, chr(10) || ' ') ELSE '' END"))} AS terms,
  {Q.query_words("q || CASE WHEN len(entities) > 0 THEN chr(10) || array_to_string(entities, chr(10)) ELSE '' END")} AS twords FROM named),
prep AS (SELECT c.*, d.url, d.title, d.importance, {Q.recency('d.visited_ms')} AS rec, e.embedding,
  lower(d.title || chr(10) || d.summary || chr(10) || c.text) AS pool,
  {Q.tokens("d.title || chr(10) || d.summary || chr(10) || c.text")} AS toks
  FROM chunks c JOIN docs d USING (document_id) LEFT JOIN embeddings e ON e.vec_id = c.document_id AND c.ord = 0),
stats AS (SELECT count(*) AS n, avg(greatest(len(toks), 1)) AS avgdl FROM prep),
postings AS (SELECT chunk_id, greatest(len(toks), 1) AS dl, unnest(toks) AS term FROM prep),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM postings GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT query_id, unnest(terms) AS term FROM qs),
bm AS (SELECT query_id, chunk_id, count(*) AS nterms, sum(tf)::BIGINT AS occurrences,
  sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.35 / (tf + 1.35 * (1 - 0.78 + 0.78 * dl / avgdl))) AS bm25
  FROM qt JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL),
pairs AS (SELECT qs.query_id, prep.chunk_id, prep.document_id, coalesce(bm25, 0.0) AS bm25,
  coalesce(list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]), 0.0) AS cos,
  vector IS NOT NULL AND embedding IS NOT NULL AS paired,
  len(list_filter(entities, lambda e: contains(pool, lower(e)))) AS found,
  wants_profile AND contains(lower(url), 'linkedin.com') AS prof, rec, importance AS eng
  FROM qs, prep LEFT JOIN bm ON bm.query_id = qs.query_id AND bm.chunk_id = prep.chunk_id),
titles AS (SELECT query_id, document_id, CASE WHEN len(twords) = 0 THEN 0.0 ELSE
  len(list_filter(twords, lambda w: contains(lower(title), w))) / len(twords)::DOUBLE END AS tm FROM qs, docs),
spans AS (SELECT query_id, min(bm25) AS lo, max(bm25) AS hi FROM pairs GROUP BY 1),
normed AS (SELECT *, (bm25 - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS share, paired AND cos > 0.025 AS semantic
  FROM pairs JOIN spans USING (query_id) JOIN titles USING (query_id, document_id)),
scored AS (SELECT *, least(1.45, CASE WHEN semantic
  THEN 0.48 * cos + 0.24 * (0.72 * share + 0.28 * tm) + 0.12 * rec + 0.16 * eng
  ELSE 0.52 * (0.72 * share + 0.28 * tm) + 0.26 * rec + 0.22 * eng END
  + 0.06 * found + CASE WHEN prof THEN 0.05 ELSE 0 END) AS score FROM normed),
best AS (SELECT *, min(chunk_id) OVER (PARTITION BY query_id, document_id) AS first_chunk,
  row_number() OVER (PARTITION BY query_id, document_id ORDER BY round(score, 10) DESC, round(bm25, 10) DESC, chunk_id) AS nth FROM scored),
cut AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM best WHERE nth = 1)
  WHERE score >= greatest(0.028, least(0.26, 0.072 * top))),
seen AS (SELECT cut.*, q, terms, span, span IS NULL OR d.url IN (SELECT url FROM visits v WHERE v.visited_ms BETWEEN span[1] AND span[2]) AS inside
  FROM cut JOIN qs USING (query_id) JOIN docs d USING (document_id)),
kept AS (SELECT * FROM (SELECT *, bool_or(inside) OVER (PARTITION BY query_id) AS any_inside FROM seen) WHERE inside OR NOT any_inside),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, first_chunk) AS rank FROM kept)
  WHERE rank <= {k})
"""


def _hits(hits):
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "document_id", "chunk_id", "url",
        _round("score"), "match_reason", "score_breakdown", "time_relaxed")


def _search(make):
    def run(spark, sf):
        return _hits(SE.hybrid_search(make(spark, sf), TD.library(spark, sf), TD.as_of()))
    return run


REASON = """CASE WHEN len(telling) >= 2 THEN 'Words of the query: ' || array_to_string(telling[1:3], ', ')
  WHEN len(telling) = 1 AND length(telling[1]) >= 8 THEN 'A rare word of the query: ' || telling[1] END"""


def search_sql(asked: str) -> str:
    return search_ctes(asked) + f""", shown AS (SELECT h.*, d.url, list_filter(terms, lambda t: length(t) >= 6
  AND contains(lower(d.title || ' ' || c.text), t)) AS telling
  FROM hits h JOIN docs d USING (document_id) JOIN chunks c USING (chunk_id))
SELECT query_id, rank, document_id, chunk_id, url, round(score, 6) AS score, {REASON} AS match_reason,
  CASE WHEN semantic THEN 'Meaning: ' || floor(least(100, greatest(0, cos * 100)) + 0.5)::BIGINT || ' % like the query'
    ELSE 'Meaning: not compared, words and dates decided' END || '. Words: ' ||
    floor(least(100, greatest(0, share * 100)) + 0.5)::BIGINT || ' % of the best passage.' AS score_breakdown,
  span IS NOT NULL AND NOT any_inside AS time_relaxed FROM shown"""


def search_confidence(spark, sf):
    hits = SE.hybrid_search(plain_queries(spark, sf), TD.library(spark, sf), TD.as_of(), k=20)
    return R.confidence(hits).groupBy("confidence").agg(F.count("*").alias("hits"))


SEARCH_CONFIDENCE = search_ctes(PLAIN, 20) + """
SELECT CASE WHEN s >= 0.88 THEN 'Strong match' WHEN s >= 0.62 THEN 'Good match' ELSE 'Looser match' END AS confidence,
  count(*) AS hits FROM (SELECT score / max(score) OVER (PARTITION BY query_id) AS s FROM hits) GROUP BY 1"""


def search_evidence(spark, sf):
    asked = ranged_queries(spark, sf)
    hits = SE.hybrid_search(asked, TD.library(spark, sf), TD.as_of())
    return SE.search_evidence(asked, hits, TD.as_of())


SEARCH_EVIDENCE = search_ctes(RANGED) + """
SELECT query_id, count(*) AS hits, count(*) || CASE WHEN count(*) = 1 THEN ' page fits.' ELSE ' pages fit.' END || CASE WHEN any_value(span) IS NULL THEN '' WHEN NOT bool_or(any_inside)
    THEN ' None of them was read in the time asked for.'
    ELSE ' All of them were read in the time asked for.' END AS evidence
FROM hits GROUP BY query_id"""


def passage_holders(documents, passages):
    """Documents ``(document_id, text)`` that hold a passage, as ``(query_id, document_id)``.

    Passages of a block's size are all looked for by one walk over each text, which stays where it is. Of more
    passages, a token inside one is a whole token of any text that holds the passage, so the passage's
    longest inner token leads to the candidates. Passages without an inner token are looked for in every text
    by one walk.
    """
    size = passages.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if size["n"] <= SE.BLOCK_QUERIES and (size["chars"] or 0) <= SE.BLOCK_CHARS:
        asked = passages.filter("text <> ''").select("query_id", F.col("text").alias("key"))
        wanted = sorted({r["key"] for r in asked.select("key").collect()})  # at most a block's characters
        held = SE.names_in(documents.select("document_id", "text"), ["document_id"], wanted, exact=True)
        return held.join(F.broadcast(asked), "key").select("query_id", "document_id")
    inner = F.expr("slice(ts, 2, greatest(size(ts) - 2, 0))")
    longest = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    keyed = passages.withColumn("ts", T.tokens(F.col("text"))).select(
        "query_id", F.col("text").alias("passage"), longest.alias("term"))
    held = documents.select("document_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    candidates = held.join(keyed, "term").select("document_id", "query_id", "passage")
    found = candidates.join(documents, "document_id").filter(F.contains("text", "passage")).select("query_id", "document_id")
    short = {r["query_id"]: r["passage"] for r in keyed.filter("term is null").select("query_id", "passage").collect()}
    if short:  # as many as there are queries with fewer than three words
        whole = SE.names_in(documents.select("document_id", "text"), ["document_id"], sorted({p.lower() for p in short.values() if p}))
        rows = spark_rows(documents, short)
        again = whole.join(rows, F.col("key") == F.lower("passage")).join(documents, "document_id")
        found = found.unionByName(again.filter(F.contains("text", "passage")).select("query_id", "document_id"))
    return found


def spark_rows(df, passages):
    return df.sparkSession.createDataFrame(list(passages.items()), "query_id long, passage string")


def search_quality(spark, sf):
    """Whether each passage finds a document that holds it; a passage nobody holds has no such check."""
    lib, asked = TD.library(spark, sf), plain_queries(spark, sf)
    texts = TD.documents(spark, sf, with_text=True)
    holders = passage_holders(texts.select("document_id", "text"), asked).join(texts.select("document_id", "url"), "document_id")
    firsts = holders.groupBy("query_id").agg(F.min("url").alias("any_url"))
    none = F.lit(None).cast("string")
    wanted = asked.join(firsts, "query_id", "left").select(
        "query_id", F.lit(1).alias("min_hits"), none.alias("top_url"), "any_url", none.alias("banned_url"))
    hits = SE.hybrid_search(asked, lib, TD.as_of())
    return R.eval_pass_rate(hits, wanted)


def search_gate(spark, sf):
    return R.eval_gate(search_quality(spark, sf)).select("queries", _round("rate"), "enough")


SEARCH_QUALITY = search_ctes(PLAIN) + """, firsts AS (SELECT query_id, min(url) AS any_url
  FROM asked, docs WHERE contains(docs.text, asked.text) GROUP BY 1)
SELECT query_id, count(h.rank) AS hits, count(h.rank) >= 1 AND (any_value(any_url) IS NULL OR bool_or(contains(d.url, any_url))) AS passed
FROM asked LEFT JOIN firsts USING (query_id) LEFT JOIN hits h USING (query_id) LEFT JOIN docs d USING (document_id) GROUP BY query_id"""


SEARCH_GATE = f"""SELECT count(*) AS queries, round(avg(passed::INT), 6) AS rate, avg(passed::INT) >= 0.85 AS enough FROM ({SEARCH_QUALITY})"""


def annotated_texts(spark, sf):
    """Hints read from every passage and every turn, and from the queries that name things."""
    turns = TD.table(spark, sf, "conversations").select(
        F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("id"), "text")
    named = named_queries(spark, sf).select(F.concat_ws(":", F.lit("query"), "query_id").alias("id"), "text")
    both = turns.unionByName(named).withColumn("q", S.normalise_query(F.col("text")))
    window = QU.query_range(F.col("q"), TD.as_of())
    return both.select(
        "id", F.md5("q").alias("digest"), F.array_join(QU.entities(F.col("q")), "|").alias("entities"),
        QU.profile_style(F.col("q")).alias("profile"),
        window["start_ms"].alias("start_ms"), window["end_ms"].alias("end_ms"),
        F.array_join(T.distinct_in_order(T.tokens(F.col("q"))), " ").alias("terms"))


ANNOTATED = f"""WITH every AS (SELECT 'turn:' || conv_id || ':' || turn AS id, text FROM conversations
  UNION ALL SELECT 'query:' || query_id, text FROM ({NAMED})),
n AS (SELECT id, {NORMAL} AS q FROM every),
r AS (SELECT *, {range_sql('q')} AS span FROM n)
SELECT id, md5(q) AS digest, array_to_string({entities_sql('q')}, '|') AS entities,
  regexp_matches(q, '{PROFILE}') AS profile, span[1] AS start_ms, span[2] AS end_ms,
  array_to_string({Q.in_order(Q.tokens('q'))}, ' ') AS terms FROM r"""

CORPUS = "WITH " + DOCS + ", " + CHUNKS + f""",
corpus AS (SELECT document_id, chunk_id, title || chr(10) || summary || chr(10) || c.text AS t FROM chunks c JOIN docs USING (document_id)),
toks AS (SELECT *, {Q.tokens('t')} AS ts FROM corpus),
tf AS (SELECT chunk_id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM toks) GROUP BY ALL)
"""

CHECKS = {
    "chunk_corpus": (chunk_corpus, CORPUS + "SELECT document_id, chunk_id, md5(t) AS digest FROM corpus"),
    "corpus_stats": (corpus_stats, CORPUS + "SELECT count(*) AS n, round(avg(greatest(len(ts), 1)), 6) AS avgdl FROM toks"),
    "term_frequencies": (term_frequencies, CORPUS + """SELECT chunk_id, dl, count(*) AS terms,
  sum(tf)::BIGINT AS occurrences, max(tf) AS most FROM tf GROUP BY ALL"""),
    "document_frequencies": (document_frequencies, CORPUS + """SELECT term, df,
  round(ln(1 + ((SELECT count(*) FROM corpus) - df + 0.5) / (df + 0.5)), 6) AS idf
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""),
    "term_matches": (term_matches, search_ctes(PLAIN)
                     + "SELECT query_id, chunk_id, nterms AS terms, occurrences FROM bm"),
    "bm25_scores": (bm25_scores, search_ctes(PLAIN) + """SELECT query_id, chunk_id, round(bm25, 6) AS bm25,
  round(share, 6) AS share FROM normed WHERE bm25 > 0"""),
    "title_scores": (title_scores, search_ctes(PLAIN) + """SELECT document_id, query_id, round(tm, 6) AS title
  FROM titles WHERE tm > 0 AND document_id IN (SELECT document_id FROM chunks)"""),
    "semantic_neighbours": (semantic_neighbours, SEMANTIC_NEIGHBOURS),
    "profile_scores": (profile_scores, PROFILE_SCORES),
    "annotated_texts": (annotated_texts, ANNOTATED),
    "hybrid_search": (_search(plain_queries), search_sql(PLAIN)),
    "hybrid_search_vectors": (_search(vector_queries), search_sql(WITH_VECTOR)),
    "hybrid_search_ranges": (_search(ranged_queries), search_sql(RANGED)),
    "hybrid_search_windows": (_search(windowed_queries), search_sql(WINDOWED)),
    "hybrid_search_entities": (_search(named_queries), search_sql(NAMED)),
    "search_confidence": (search_confidence, SEARCH_CONFIDENCE),
    "search_evidence": (search_evidence, SEARCH_EVIDENCE),
    "search_quality": (search_quality, SEARCH_QUALITY),
    "search_gate": (search_gate, SEARCH_GATE),
}
