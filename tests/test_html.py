from helpers import as_of, ago

from pagelens.functions import policy as P  # noqa: F401
from pagelens.model import TABLES, Library, Policy
from pagelens.plans import ingest as IN
from pagelens.sources.html import extract_html, parse_page


def extract(spark, html, url="https://a.test/x"):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    r = extract_html(df).first()
    return r["title"], r["text"]


def test_scripts_forms_and_secrets_are_dropped(spark):
    html = """<!DOCTYPE html><html><head><title> A &amp; B </title><script>var t="</p>";</script><style>p{}</style></head>
    <body><a href="#main" class="skip-nav">Skip</a><p>One<p>Two <b>bold</b></p><form><label>L</label><input value="x">secret</form>
    <div data-sensitive>card</div><span autocomplete="cc-number">4111</span><textarea>t</textarea><!-- c -->
    <svg><title>icon</title><text>x</text></svg><p>Three&nbsp;four</p></body></html>"""
    assert extract(spark, html) == ("A & B", "One Two bold Three four")


def test_profile_pages_lose_their_navigation(spark):
    html = "<body><header>H</header><nav>N</nav><main>Ann Lee works here</main><footer>F</footer></body>"
    assert extract(spark, html, "https://www.linkedin.com/in/ann") == ("", "Ann Lee works here")
    assert extract(spark, html)[1] == "H N Ann Lee works here F"


def test_broken_markup_is_read_to_the_end():
    assert parse_page("<p>a<div>b</span>c", "")[1].split() == ["a", "bc"]
    assert parse_page(None, "") == ("", "", "", "", "")
    assert parse_page("<b>x</i></b><li>y<li>z", "")[1].split() == ["x", "y", "z"]


def empty(spark):
    return Library(**{n: spark.createDataFrame([], TABLES[n]) for n in ("documents", "chunks", "visits")})


def body(words):
    return f"<html><head><title>T</title></head><body><p>{words * 20}</p></body></html>"


def test_ingest_stores_the_last_version_of_each_page(spark):
    rows = [("https://a.test/1", body("old words "), ago(hours=3), 1), ("https://a.test/1", body("new words "), ago(hours=2), 2),
            ("https://a.test/2", "<p>tiny</p>", ago(hours=1), 3), ("https://www.chase.com/x", body("bank "), ago(hours=1), 4),
            ("not a url", body("x "), ago(hours=1), 5), ("https://b.test/3", body("pay 4111111111111111 "), ago(hours=1), 6)]
    pages = spark.createDataFrame(rows, "url string, html string, visited_at timestamp, seq long")
    library, outcomes = IN.ingest_pages(pages, empty(spark), Policy(), as_of(), lambda: __import__("pagelens.operators.vectors", fromlist=["x"]).hashing_embedder)
    assert {r["seq"]: r["reason"] for r in outcomes.collect()} == {
        1: None, 2: None, 3: "too_short", 4: "always_skip_registry", 5: "bad_url", 6: None}
    docs = {r["url"]: r for r in library.documents.collect()}
    assert set(docs) == {"https://a.test/1", "https://b.test/3"} and docs["https://a.test/1"]["visit_count"] == 2
    chunks = library.chunks.collect()
    assert len(chunks) == 2 and all(c["embed_state"] == "embedded" and len(c["embedding"]) == 384 for c in chunks)
    assert any("new words" in c["text"] for c in chunks) and not any("4111" in c["text"] or "old" in c["text"] for c in chunks)
    assert library.visits.count() == 3
    again, _ = IN.ingest_pages(pages.filter("seq = 1"), library, Policy(), as_of())
    assert again.documents.filter("url = 'https://a.test/1'").first()["visit_count"] == 3
    assert any("old words" in c["text"] for c in again.chunks.collect())


def test_backfill_counts_every_address(spark):
    visits = spark.createDataFrame(
        [("https://a.test/1", "One", ago(days=1), 1), ("https://a.test/2#x", "", ago(days=2), 2), ("https://a.test/3", "Three", ago(days=3), 3),
         ("https://a.test/login", "L", ago(days=3), 4), ("https://a.test/9", "Nine", ago(days=60), 5)],
        "url string, title string, visited_at timestamp, seq long")
    pages = spark.createDataFrame([("https://a.test/1", body("alpha ").replace("<title>T</title>", "")), ("https://a.test/2", "<p>short</p>")], "url string, html string")
    library, funnel = IN.backfill_history(visits, pages, empty(spark), Policy(paused=True), as_of())
    r = funnel.first()
    assert (r["processed"], r["indexed"], r["skipped"], r["fetch_failed"], r["percent"]) == (4, 1, 2, 1, 100)
    assert library.documents.first()["title"] == "One"


def test_backfill_takes_the_version_fetched_last(spark):
    visits = spark.createDataFrame([("https://a.test/1", "One", ago(days=1), 1)], "url string, title string, visited_at timestamp, seq long")
    rows = [("https://a.test/1", body("zebra "), 1), ("https://a.test/1#top", body("alpha "), 2), ("https://b.test/", body("other "), 3)]
    pages = spark.createDataFrame(rows, "url string, html string, fetched_at long")
    library, funnel = IN.backfill_history(visits, pages, empty(spark), Policy(), as_of())
    assert funnel.first()["indexed"] == 1
    texts = [r["text"] for r in library.chunks.collect()]
    assert texts and all("alpha" in t and "zebra" not in t for t in texts)


def test_paused_and_incognito_come_first(spark):
    from pagelens.operators import gate as G
    df = spark.createDataFrame([("not a url", True), ("https://ok.test", False)], "url string, incognito boolean")
    got = [r["reason"] for r in G.policy_reason(df, Policy(paused=True)).collect()]
    assert got == ["paused", "paused"]
    got = {r["url"]: r["reason"] for r in G.policy_reason(df, Policy(paused=True), bypass_pause=True).collect()}
    assert got == {"not a url": "incognito", "https://ok.test": None}
