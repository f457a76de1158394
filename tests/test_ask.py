import pytest
from helpers import NOW, NOW_MS, ago, as_of, library, one
from pyspark.sql import functions as F

from pagelens.functions import questions as Q
from pagelens.operators.budget import fit_budget
from pagelens.operators import conversations as CO
from pagelens.plans import ask as ASK
from pagelens.plans import digest as D

DAY = 86_400_000
TODAY = NOW_MS // DAY * DAY


@pytest.mark.parametrize("text, start, end, label", [
    ("what did I read so far today", TODAY, TODAY + DAY - 1, "today"),
    ("YESTERDAY and today", TODAY, TODAY + DAY - 1, "today"),
    ("the last day", TODAY - DAY, TODAY - 1, "yesterday"),
    ("past week", TODAY - 7 * DAY, NOW_MS, "the last week"),
    ("this week", TODAY - 7 * DAY, NOW_MS, "this week"),
    ("last month", TODAY - 30 * DAY, NOW_MS, "the last month"),
    ("this month", TODAY - 30 * DAY, NOW_MS, "this month"),
    ("3 weeks ago", TODAY - 21 * DAY, NOW_MS, "3 week(s) ago"),
    ("200 days ago", TODAY - 120 * DAY, NOW_MS, "120 day(s) ago"),
    ("0 months ago", TODAY - 30 * DAY, NOW_MS, "1 month(s) ago"),
    ("99999999999999999999 days ago", TODAY - 120 * DAY, NOW_MS, "120 day(s) ago"),
])
def test_question_windows(spark, text, start, end, label):
    got = one(spark, lambda c: Q.question_range(c, as_of()), text)[0]
    assert (got["start_ms"], got["end_ms"], got["label"]) == (start, end, label)


def test_query_windows(spark):
    got = one(spark, lambda c: Q.query_range(c, as_of()), "yesterday", "today", "last  week", "lastmonth", "todays")
    assert [g and (g["start_ms"], g["end_ms"]) for g in got] == [
        (TODAY - DAY, TODAY - 1), (TODAY, NOW_MS), (NOW_MS - 7 * DAY, NOW_MS), (NOW_MS - 30 * DAY, NOW_MS), None]


def test_intents_entities_and_clean_text(spark):
    assert one(spark, Q.intent, "Summarise it", "which page", "list things", "why did it", "hm") == [
        "summarize_period", "find_specific", "list_items", "general_qa", "general_qa"]
    assert one(spark, Q.entities, 'who works at OpenAI on "a b" or "the" at Acme yesterday, LangGraph OpenAI') == [
        ["a b", "OpenAI", "Acme", "LangGraph"]]
    assert one(spark, Q.search_text, "tell me what llamas ate yesterday", "recap today") == ["llamas ate", "recap today"]
    assert one(spark, Q.cited_numbers, "a [1] b [2,\xa03] [x] [4") == [[1, 2, 3]]
    assert one(spark, lambda c: Q.complexity(c, F.lit("today")), "summarize_period", "list_items", "x") == ["medium", "medium", "low"]
    tiers = [one(spark, lambda c: Q.prompt_tier(c, F.lit(x)), "p" * n)[0] for n, x in ((10, "low"), (25_000, "low"), (10, "high"))]
    assert tiers == ["small", "large", "large"]


@pytest.mark.parametrize("most, asked, sizes, fits", [
    (2_000, 0, [500_000], 0), (5_000, 50, [100, 100, 100], 3), (10_000, 100, [2, 50_000, 3], 1), (1_600, 0, [4], 0), (3_000, 0, [700, 700, 10], 1)])
def test_context_budget_stops_at_the_first_overflow(spark, most, asked, sizes, fits):
    rows = [(1, i, "x" * n, i) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "question_id long, rank int, text string, document_id long")
    parsed = spark.createDataFrame([(1, "q" * asked)], "question_id long, question string")
    assert ASK.pack_sources(parsed, df, most).count() == fits


def test_prompt_or_message_for_every_question(spark):
    lib = library(spark, [(1, "https://a.test/1", "Llamas", ago(days=1), 0.5)], [(1, 0, "llamas eat grass " * 90, None)])
    questions = spark.createDataFrame([(1, "what do llamas eat"), (2, "@@@ yesterday"), (3, "x" * 12_001)], "question_id long, question string")
    contexts, sources = ASK.build_contexts(questions, lib, as_of())
    got = {r["question_id"]: r for r in contexts.collect()}
    assert set(got) == {1, 2, 3} and got[3]["prompt"] is None and got[3]["message"] == ASK.TOO_LONG
    assert got[1]["prompt"].startswith("Date: 2023-11-14.\n\nPages read earlier, by number:\n\n[1] Llamas — ex.test, seen 2023-11-13\nAddress: https://a.test/1\nText: llamas eat")
    assert got[1]["prompt"].endswith("...\n\nQuestion: what do llamas eat\n\nReply, with the numbers of the pages it rests on:") and got[1]["tier"] == "small"
    assert got[1]["system"] == ASK.INSTRUCTION and got[2]["system"] is None
    assert got[2]["prompt"] is None and got[2]["message"] == "The library has no page from yesterday that fits the question."
    answers = spark.createDataFrame([(1, "grass [1, 2]")], "answer_id long, text string")
    cited = CO.resolve_citations(answers, sources.withColumnRenamed("question_id", "answer_id")).collect()
    assert [(r["n"], r["url"]) for r in cited] == [(1, "https://a.test/1")]


def parse(spark, raw, n=2):
    answers = spark.createDataFrame([(1, raw)], "answer_id long, raw string")
    sources = spark.createDataFrame([(1, i, f"https://ex.test/p{i}", f"Title {i}") for i in range(1, n + 1)], "answer_id long, n int, url string, title string")
    return D.parse_digest(answers, sources).first()


def test_digest_layouts(spark):
    r = parse(spark, "\nNARRATIVE: You read about cats\n and servers.\n\nTOPICS:\n- Cats (2 pages)\n- Servers (1 page)\n\nINSIGHTS:\n- Tuna [1]\n* Latency [2]\n")
    assert r["narrative"] == "You read about cats and servers."
    assert [(t["topic"], t["page_count"]) for t in r["topics"]] == [("Cats", 2), ("Servers", 1)]
    assert [(i["text"], i["source_url"]) for i in r["insights"]] == [("Tuna", "https://ex.test/p1"), ("Latency", "https://ex.test/p2")]
    r = parse(spark, "\nNARRATIVE: Only this.\n\nINSIGHTS:\n- One [1]\n")
    assert r["narrative"] == "No summary generated." and r["topics"] == [] and len(r["insights"]) == 1
    r = parse(spark, "\nNARRATIVE: Hello.\n\nTOPICS:\n- Solo (1 page)\n")
    assert r["narrative"] == "Hello." and r["topics"] == [] and r["insights"] == []
    r = parse(spark, "NARRATIVE: x\nTOPICS:\n- bad line\nINSIGHTS:\n- none\n- broken [abc]\n- missing [99]\n- ok [1]\n")
    assert [i["text"] for i in r["insights"]] == ["ok"]
    r = parse(spark, "")
    assert r["narrative"] == "No summary generated." and r["topics"] == [] and r["insights"] == []


def test_an_answer_in_the_layout_asked_for_is_read(spark):
    r = parse(spark, D.LAYOUT)
    assert r["narrative"].startswith("two or three sentences") and [t["page_count"] for t in r["topics"]] == [2]
    assert [i["source_url"] for i in r["insights"]] == ["https://ex.test/p1"]


def test_digest_of_a_period(spark):
    documents = [(i, f"https://a.test/{i}", f"T{i}", ago(hours=i), 0.5) for i in range(1, 40)]
    lib = library(spark, documents, [(i, o, "w" * (100 + o), None) for i in range(1, 40) for o in range(2)])
    facts, prompts, packed = D.reading_digest(lib, ["today", "yesterday", "last_7_days"], as_of())
    assert {r["system"] for r in prompts.collect()} == {D.LAYOUT}
    got = {r["range"]: r for r in facts.collect()}
    assert got["today"]["page_count"] == 22 and got["yesterday"]["page_count"] == 17 and got["last_7_days"]["page_count"] == 39
    assert [s["url"] for s in got["last_7_days"]["sources"]][:2] == ["https://a.test/39", "https://a.test/38"]
    assert len(got["last_7_days"]["sources"]) == 24
    assert packed.filter("range = 'last_7_days'").count() == 39 and packed.filter("chunk_id % 1000000 = 0").count() == 0
    answers = spark.createDataFrame([("today", "NARRATIVE: n\nTOPICS:\nINSIGHTS:\n- a [1]")], "range string, raw string")
    done = D.finish_digests(facts, answers, packed, as_of()).collect()
    assert len(done) == 1 and done[0]["insights"][0]["source_url"] == "https://a.test/1"
    empty, _, _ = D.reading_digest(library(spark, [(1, "u", "t", ago(days=90), 0.1)], [(1, 0, "x", None)]), ["today"], as_of())
    assert empty.first()["message"].startswith("The library has no page read today")


def test_stale_digests(spark):
    stored = spark.createDataFrame([("today", ago(minutes=29)), ("yesterday", ago(minutes=30))], "range string, generated_at timestamp")
    wanted = spark.createDataFrame([("today", False), ("yesterday", False), ("last_7_days", False)], "range string, force boolean")
    assert sorted(r["range"] for r in D.stale_digests(wanted, stored, as_of()).collect()) == ["last_7_days", "yesterday"]
    forced = wanted.withColumn("force", F.lit(True))
    assert D.stale_digests(forced, stored, as_of()).count() == 3
    assert NOW and fit_budget
