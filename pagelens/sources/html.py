"""Raw HTML to title and text.

Only the walk over the markup needs Python; it runs on Arrow batches and returns the candidate
texts. Choosing among them and removing noise phrases are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagelens.functions.text import collapse, nonempty, strip_noise
from pagelens.functions.urls import hostname

# Elements that never carry readable text.
DROP_TAGS = frozenset(
    "script style noscript iframe object embed video audio canvas svg template "
    "form input textarea select button datalist option label".split()
)
SENSITIVE_AUTOCOMPLETE = frozenset(("cc-number", "cc-csc", "one-time-code"))
PROFILE_CHROME_TAGS = frozenset(("nav", "header", "footer"))
PROFILE_CHROME_ROLES = frozenset(("navigation", "banner"))
PROFILE_CHROME_CLASSES = frozenset((
    "global-nav", "share-box-feed-entry__closed-caption", "msg-overlay-list-bubble-header",
    "top-card-layout__entity-info-aside",
))
PROFILE_MAIN_CLASSES = frozenset(("scaffold-layout__main", "profile-content"))
VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table td th tr ul".split()
)
# Elements an opening tag of the same kind closes.
SELF_CLOSING = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
RAW = frozenset(("script", "style"))


class PageParser(HTMLParser):
    """Collects title, body text, article text and main-column text of one page."""

    def __init__(self, host: str):
        super().__init__(convert_charrefs=True)
        self.profile = "linkedin.com" in host
        self.micro = "twitter.com" in host or host == "x.com"
        self.open: list[tuple[str, bool, str]] = []
        self.hidden = 0
        self.title: list[str] = []
        self.parts: dict[str, list[str]] = {"body": [], "readable": [], "main": [], "site": []}
        self.depth = dict.fromkeys(self.parts, 0)

    def _dropped(self, tag: str, attrs: dict[str, str]) -> bool:
        classes = attrs.get("class", "")
        if tag in DROP_TAGS or "data-sensitive" in attrs:
            return True
        if attrs.get("autocomplete") in SENSITIVE_AUTOCOMPLETE:
            return True
        if attrs.get("data-test-link-name") == "skip-nav" or "skip-to-content" in classes:
            return True
        if "skip-link" in classes.split():
            return True
        if tag == "a" and "skip" in classes and attrs.get("href", "").startswith("#"):
            return True
        if not self.profile:
            return False
        names = set(classes.split())
        return (
            tag in PROFILE_CHROME_TAGS
            or attrs.get("role") in PROFILE_CHROME_ROLES
            or attrs.get("id") == "global-nav"
            or bool(names & PROFILE_CHROME_CLASSES)
            or (tag == "aside" and "scaffold-layout__aside" in names)
        )

    def _column(self, tag: str, attrs: dict[str, str]) -> str:
        names = set(attrs.get("class", "").split())
        if tag == "article":
            return "readable"
        if tag == "main" or attrs.get("role") == "main" or attrs.get("id") == "main-content":
            return "main"
        if self.profile and (
            names & PROFILE_MAIN_CLASSES or attrs.get("data-test-id") == "profile-main-container"
        ):
            return "site"
        if self.micro and attrs.get("data-testid") == "primaryColumn":
            return "site"
        return ""

    def _pop(self) -> str:
        tag, hides, column = self.open.pop()
        self.hidden -= hides
        if column:
            self.depth[column] -= 1
        return tag

    def handle_starttag(self, tag, attrs):
        given = {name: value or "" for name, value in attrs}
        if tag in SELF_CLOSING and self.open and self.open[-1][0] == tag:
            self._pop()
        if tag in BLOCK:
            self._add(" ")
        if tag in VOID:
            return
        hides, column = self._dropped(tag, given), self._column(tag, given)
        self.open.append((tag, hides, column))
        self.hidden += hides
        if column:
            self.depth[column] += 1

    def handle_endtag(self, tag):
        if any(name == tag for name, _, _ in self.open):
            while self._pop() != tag:
                pass
        if tag in BLOCK:
            self._add(" ")

    def handle_data(self, data):
        inside = [name for name, _, _ in self.open]
        if "title" in inside and not (set(inside) & {"svg"}):
            self.title.append(data)
        elif "head" not in inside:
            self._add(data)

    def _add(self, data: str) -> None:
        if self.hidden:
            return
        self.parts["body"].append(data)
        for name in ("readable", "main", "site"):
            if self.depth[name]:
                self.parts[name].append(data)

    def result(self) -> tuple[str, ...]:
        return ("".join(self.title), *("".join(p) for p in self.parts.values()))


def parse_page(html: str | None, host: str) -> tuple[str, ...]:
    parser = PageParser(host)
    parser.feed(html or "")
    parser.close()
    return parser.result()


PARTS = ("title", "body", "readable", "main", "site")


@F.pandas_udf(StructType([StructField(name, StringType()) for name in PARTS]))
def _candidates(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for html, host in batches:
        yield pd.DataFrame([parse_page(h, s) for h, s in zip(html, host)], columns=PARTS)


def extract_html(pages: DataFrame) -> DataFrame:
    """Adds ``title`` and ``text`` to ``pages(url, html)``: the longest candidate text, cleaned."""
    host = hostname(F.col("url"))
    parsed = pages.withColumn("_c", _candidates(F.col("html"), host))
    texts = F.array(*[collapse(F.col(f"_c.{n}")) for n in ("readable", "body", "main", "site")])
    # Longest first; the earlier candidate wins among equals.
    ranked = F.transform(texts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))
    title = collapse(F.col("_c.title"))
    clean_title = F.coalesce(nonempty(strip_noise(title, host)), title)
    return parsed.select(
        *[c for c in pages.columns if c not in ("html", "title", "text")],
        clean_title.alias("title"),
        strip_noise(F.array_max(ranked)["t"], host).alias("text"),
    )
