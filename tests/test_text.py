import pytest
from helpers import one
from pyspark.sql import functions as F

from pagelens.functions import policy as P
from pagelens.functions import redact as R
from pagelens.functions import text as T
from pagelens.functions import urls as U
from pagelens.operators import chunks as C


def test_whitespace_follows_browsers(spark):
    assert one(spark, T.collapse, "\t a\xa0﻿b \n", "x y") == ["a b", "x y"]
    assert one(spark, T.strip, "﻿ é \t", " \xa0") == ["é", ""]
    assert one(spark, lambda c: F.size(T.words(c)), "", " \t", "a b") == [0, 0, 2]


def test_tokens_keep_ascii_runs_of_two(spark):
    assert one(spark, T.tokens, "Ab c d3 École x-ray") == [["ab", "d3", "cole", "ray"]]


def test_excerpt(spark):
    text = "word " * 100
    short, cut, solid = one(spark, T.excerpt, "a " * 50, text, "x" * 300)
    assert short == ("a " * 50).strip()
    assert cut == text[:239].rstrip().rsplit(" ", 1)[0] + "…" or cut.endswith("word…")
    assert solid == "x" * 240 + "…"


def test_truncate_drops_the_part_word(spark):
    text = "abcd " * 200
    assert one(spark, T.truncate_words, "short", text)[1] == text[:800].rstrip().rsplit(" ", 0)[0] + "..."
    assert one(spark, lambda c: T.truncate_words(c, 7), "abc defgh ij") == ["abc..."]


def test_links(spark):
    found = one(spark, T.links, "see (https://a.b/c?d=1), HTTP://x.y! and ftp://no")
    assert found == [["https://a.b/c?d=1", "HTTP://x.y"]]


def test_noise(spark):
    clean = one(spark, lambda c: T.strip_noise(c, F.lit("x.org")), "Skip to content Hello 12 notifications Me")
    assert clean == ["Hello Me"]
    menu = one(spark, lambda c: T.strip_noise(c, F.lit("www.linkedin.com")), "Home Jobs Me Messaging Ann Lee")
    assert menu == ["Ann Lee"]


@pytest.mark.parametrize("text, masked, kinds", [
    ("pay 4111 1111 1111 1111 now", "pay [REDACTED] now", ["credit_card"]),
    ("pay 4111-1111-1111-1111.", "pay [REDACTED].", ["credit_card"]),
    ("pay 4111111111111112", "pay 4111111111111112", []),
    ("x4111111111111111", "x4111111111111111", []),
    ("4111111111111111 4111111111111112", "[REDACTED] 4111111111111112", ["credit_card"]),
    ("é123-45-6789", "é[REDACTED]", ["ssn"]),
    ("eyJab.cd.ef and sk-abcdefghijklmnop1", "[REDACTED] and [REDACTED]", ["jwt", "api_key"]),
    ("BEARER abcdefghijklmnopqrst", "[REDACTED]", ["bearer"]),
    ("nothing here", "nothing here", []),
])
def test_redaction(spark, text, masked, kinds):
    assert one(spark, R.redact, text) == [masked]
    assert one(spark, R.pii_types, text) == [kinds]
    assert one(spark, R.redact, masked) == [masked]


def test_safe_addresses(spark):
    given = ["https://example.com/path?q=1", "http://localhost:8080/", "  https://192.168.1.1/x  ",
             "https://xn--n3h.net/", "javascript:alert(1)", "data:text/html,x", "chrome-extension://d/e",
             "file:///etc/passwd", "not a url", "", "https://", "HTTP://User@Example.COM:80?x#y", "https://a:99999/"]
    assert one(spark, U.safe_http, *given) == [
        "https://example.com/path?q=1", "http://localhost:8080/", "https://192.168.1.1/x", "https://xn--n3h.net/",
        None, None, None, None, None, None, None, "http://example.com/?x#y", None]
    assert one(spark, U.strip_fragment, "https://a.b/c#d", None) == ["https://a.b/c", None]
    assert one(spark, U.host_suffixes, "a.b.c") == [["a.b.c", "b.c", "c"]]


def test_policy_expressions(spark):
    assert one(spark, P.skip_path, "/LOGIN", "/a?next=/oauth", "/read") == [True, True, False]
    both = [one(spark, lambda c: P.sensitive(c, F.lit(p)), h)[0] for h, p in (
        ("city.gov", "/"), ("x.mil.us", "/"), ("ok.com", "/paypal"), ("accounts.google.com", "/signin"), ("ok.com", "/"))]
    assert both == [True, True, True, True, False]
    assert one(spark, P.min_chars, "www.linkedin.com", "x.com", "netflix.com") == [32, 40, 80]


@pytest.mark.parametrize("words, windows", [(0, 0), (5, 1), (420, 1), (421, 2), (765, 2), (766, 3), (12_600, 37)])
def test_windows_cover_the_text(spark, words, windows):
    text = " ".join(f"w{i}" for i in range(words))
    df = spark.createDataFrame([(1, text)], "document_id long, text string")
    whole = [r["text"].split(" ") for r in C.chunk(df, cap=None).orderBy("ord").collect()]
    assert len(whole) == windows
    assert len(C.chunk(df).collect()) == windows
    assert len(C.chunk(df, cap=C.PAGE_CAP).collect()) == min(windows, 36)
    joined = whole[0] + [w for part in whole[1:] for w in part[75:]] if whole else []
    assert joined == text.split()


def test_short_texts_become_one_raw_chunk(spark):
    rows = [(1, "  tiny \n text "), (2, "a" * 40), (3, "b" * 41), (4, " \n ")]
    df = spark.createDataFrame(rows, "document_id long, text string")
    got = {r["document_id"]: (r["ord"], r["text"]) for r in C.chunk(df).collect()}
    assert got == {1: (0, "tiny \n text"), 2: (0, "a" * 40), 3: (0, "b" * 41)}
    # Windows shorter than the least length are kept where a text has several.
    words = ["x"] * 30 + ["y" * 50] * 3
    parts = spark.createDataFrame([(1, " ".join(words))], "document_id long, text string")
    got = C.chunk(parts, window=10, overlap=0).orderBy("ord").collect()
    assert [r["ord"] for r in got] == [0, 1, 2, 3] and " ".join(r["text"] for r in got).split() == words


def test_snippet_opens_near_the_first_word_found(spark):
    text = "Start here. " + "filler words go on. " * 20 + "The needle sits in this sentence and goes on for a while. After that more text follows."
    got = one(spark, lambda c: T.snippet(c, F.lit("zz needle")), text)[0]
    assert "needle" in got and got.endswith("…")
    assert one(spark, lambda c: T.snippet(c, F.lit("x")), "", "short") == ["", "short"]


def test_addresses_in_normal_form(spark):
    given = ["https://a.test/a/./b/../c", "https://a.test/..", "https://a.test/a/%2E%2e/b/.", "https://a.test/.a/..b/...", "https://a.test/a//../b",
             "http://A.test:80/é x?q=ü'<#>", "https://a.test/%7e%zz", "https://a.test", "https://a.test/a\\..\\b"]
    assert one(spark, U.strip_fragment, *given) == [
        "https://a.test/a/c", "https://a.test/", "https://a.test/b/", "https://a.test/.a/..b/...", "https://a.test/a/b",
        "http://a.test/%C3%A9%20x?q=%C3%BC%27%3C", "https://a.test/%7e%zz", "https://a.test/", "https://a.test/b"]
