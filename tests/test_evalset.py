import json

from helpers import NOW_MS, as_of

from pagelens.operators.ranking import eval_pass_rate
from pagelens.plans.search import hybrid_search
from pagelens.sources.evalset import read_eval

PAGES = [("https://garden.test/tomato", "Growing tomatoes", "vines need sun water and stakes"),
         ("https://bread.test/rye", "Rye bread", "sourdough starter flour oven crust"),
         ("https://stars.test/moon", "Moon phases", "waxing waning lunar orbit tides")]


def test_expectations_are_checked_against_the_hits(spark, tmp_path):
    corpus = {
        "documents": [{"id": i, "url": u, "domain": u.split("/")[2], "title": t, "summary": "", "lastVisitedAt": NOW_MS - 10**9,
                       "visitCount": 1, "importanceScore": 0.5} for i, (u, t, _) in enumerate(PAGES, 1)],
        "chunks": [{"id": 100 + i, "documentId": i, "ord": 0, "text": x} for i, (_, _, x) in enumerate(PAGES, 1)],
    }
    wanted = [
        {"query": "sourdough flour", "topHitUrlIncludes": "bread.test", "minHits": 1},
        {"query": "lunar tides", "anyHitUrlIncludes": "stars.test"},
        {"query": "tomato", "topHitUrlIncludes": "bread.test"},
        {"query": "oven", "minHits": 4},
        # Pages without a match are hits too, so a banned page comes back.
        {"query": "qqqq wwww", "mustNotIncludeUrl": "garden.test"},
    ]
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    (tmp_path / "q.json").write_text(json.dumps(wanted))
    library, expectations = read_eval(spark, str(tmp_path / "c.json"), str(tmp_path / "q.json"))
    hits = hybrid_search(expectations.select("query_id", "text"), library, as_of())
    checked = eval_pass_rate(hits, expectations).join(expectations.select("query_id", "text"), "query_id")
    got = {r["text"]: (r["hits"], r["passed"]) for r in checked.collect()}
    assert got == {"sourdough flour": (3, True), "lunar tides": (3, True), "tomato": (3, False), "oven": (3, False), "qqqq wwww": (3, False)}
