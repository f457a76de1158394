"""Annotation of search queries and questions: time windows, entities, intent, clean text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import WS, collapse, nonempty, strip, ws

DAY_MS = 86_400_000

# Words that are never an entity.
ENTITY_STOP = (
    "the a an someone somebody anyone person people profile page visited read saw seen about "
    "what who when where which did was were have has my me i"
).split()

# Forms that name an organisation, each read once per query.
ORG = r"([A-Za-z0-9][A-Za-z0-9&.+\-]{1,48})b>"
ENTITY_FORMS = (
    r"(?i)<bworks?<s>+at<s>+" + ORG,
    r"(?i)<bworks?<s>+in<s>+" + ORG,
    r"(?i)<bemployed<s>+(?:by|at)<s>+" + ORG,
    r"(?i)<bcompany<s>+" + ORG,
    r"(?i)<bat<s>+([A-Za-z][A-Za-z0-9&.+\-]{2,48})<s>+(?:yesterday|today|profile)",
)
# Quoted phrases, names in camel case, words that ask for profiles.
QUOTED = r'"([^"]{2,120})"'
CAMEL = r"<b[A-Z][a-z]+(?:[A-Z][a-z]+)+b>"
PROFILE_STYLE = r"(?i)<b(profile|linkedin|connection|who<s>+works|employee)b>"

# Intent patterns, first match wins.
INTENTS = (
    ("summarize_period", r"(?i)<b(summari[sz]e|summary|recap|overview|digest|tldr)b>"),
    ("find_specific", r"(?i)<b(which|what)<s>+(site|website|article|blog|page|video)b>"),
    ("list_items", r"(?i)<b(list|show me all|what[^\n\r\x{2028}\x{2029}]+did i read"
                   r"|which[^\n\r\x{2028}\x{2029}]+pages)b>"),
    ("general_qa", r"(?i)<b(what did|what does|what was|how does|how did|why did|why does)b>"),
)

# Words dropped from a question before it is searched for.
TIME_WORDS = (
    "yesterday today tomorrow last past this week month day days weeks months ago far "
    "morning afternoon"
).split()
COMMAND_WORDS = (
    "summarize summarise summary recap tldr which what find show tell me"
).split()

# Fixed value: a count of days, weeks or months back.
AGO = r"(?i)<b([0-9]+)<s>+(day|days|week|weeks|month|months)<s>+agob>"


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(ws(pattern))


def _window(start: Column, end: Column, label: Column | None = None) -> Column:
    fields = [start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms")]
    if label is not None:
        fields.append(label.alias("label"))
    return F.struct(*fields)


def day_start(ms: Column) -> Column:
    return (F.floor(ms / DAY_MS) * DAY_MS).cast("long")


def query_range(query: Column, as_of: Column) -> Column:
    """Time window named in a search query, in epoch milliseconds; null when none is."""
    text, now = F.lower(strip(query)), F.unix_millis(as_of)
    today, before = day_start(now), day_start(now - DAY_MS)
    return (
        F.when(_has(text, "<byesterdayb>"), _window(before, before + DAY_MS - 1))
        .when(_has(text, "<btodayb>"), _window(today, F.least(now, today + DAY_MS - 1)))
        .when(_has(text, "<blast<s>*weekb>"), _window(now - 7 * DAY_MS, now))
        .when(_has(text, "<blast<s>*monthb>"), _window(now - 30 * DAY_MS, now))
    )


def profile_style(query: Column) -> Column:
    return _has(strip(query), PROFILE_STYLE)


def entities(query: Column) -> Column:
    """Quoted phrases, organisations and CamelCase names, in the order the forms are read."""
    text = strip(query)
    quoted = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))
    named = [
        F.when(_has(text, form), F.array(F.regexp_extract(text, ws(form), 1)))
        .otherwise(F.array().cast("array<string>"))
        for form in ENTITY_FORMS
    ]
    camel = F.regexp_extract_all(text, F.lit(ws(CAMEL)), F.lit(0))
    found = F.array_distinct(F.transform(F.concat(quoted, *named, camel), strip))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(ENTITY_STOP))


def question_range(question: Column, as_of: Column) -> Column:
    """Time window and label named in a question; first matching form wins."""
    text, now = strip(question), F.unix_millis(as_of)
    today = day_start(now)
    # A count beyond nine digits is far over the clamp whatever it says.
    count = F.regexp_extract(text, ws(AGO), 1)
    n = F.when(F.length(F.regexp_replace(count, "^0+", "")) > 9, F.lit(120)).otherwise(
        F.least(F.lit(120), F.greatest(F.lit(1), F.coalesce(count.try_cast("int"), F.lit(1))))
    )
    unit = F.lower(F.regexp_extract(text, ws(AGO), 2))
    days = F.when(unit.startswith("week"), 7).when(unit.startswith("month"), 30).otherwise(1) * n
    named = F.concat_ws(
        " ",
        n.cast("string"),
        F.when(unit.startswith("month"), F.lit("month(s)"))
        .when(unit.startswith("week"), F.lit("week(s)"))
        .otherwise(F.lit("day(s)")),
        F.lit("ago"),
    )

    def back(pattern: str, window_days: int, label: str) -> tuple[str, Column]:
        return pattern, _window(today - window_days * DAY_MS, now, F.lit(label))

    # Words for a window, in the order they are looked for, and its label.
    forms = [
        (r"(?i)<b(today|so far today|this morning|this afternoon)b>",
         _window(today, today + DAY_MS - 1, F.lit("today"))),
        (r"(?i)<b(yesterday|last day)b>",
         _window(today - DAY_MS, today - 1, F.lit("yesterday"))),
        back(r"(?i)<b(last week|past week)b>", 7, "the last week"),
        back(r"(?i)<bthis weekb>", 7, "this week"),
        back(r"(?i)<b(last month|past month)b>", 30, "the last month"),
        back(r"(?i)<bthis monthb>", 30, "this month"),
        (AGO, _window(today - days.cast("long") * DAY_MS, now, named)),
    ]
    out = None
    for pattern, value in forms:
        test = _has(text, pattern)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def intent(question: Column) -> Column:
    text = strip(question)
    out = None
    for name, pattern in INTENTS:
        test = _has(text, pattern)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("general_qa"))


def search_text(question: Column) -> Column:
    """Question without time and command words; the question itself when nothing is left."""
    text = strip(question)
    kept = F.filter(
        F.split(F.lower(text), WS + "+"), lambda w: ~w.isin(TIME_WORDS + COMMAND_WORDS)
    )
    return F.coalesce(nonempty(strip(F.array_join(kept, " "))), nonempty(collapse(text)), text)


def complexity(intent_name: Column, label: Column) -> Column:
    one_day = F.coalesce(label.isin("today", "yesterday"), F.lit(False))
    return (
        F.when((intent_name == "summarize_period") & one_day, "medium")
        .when(intent_name == "summarize_period", "high")
        .when(intent_name == "list_items", "medium")
        .otherwise("low")
    )


def prompt_tier(prompt: Column, complexity_name: Column, fits: int = 18_000) -> Column:
    """Size and complexity rule for choosing the small or the large model."""
    return F.when((F.length(prompt) < fits) & (complexity_name != "high"), "small").otherwise("large")


def cited_numbers(answer: Column) -> Column:
    """Numbers in ``[1]`` and ``[2, 3]`` markers, in order, repeats kept."""
    blocks = F.regexp_extract_all(answer, F.lit(rf"\[[0-9]+(?:,{WS}*[0-9]+)*\]"), F.lit(0))
    numbers = F.flatten(
        F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit("[0-9]+"), F.lit(0)))
    )
    return F.filter(F.transform(numbers, lambda x: x.try_cast("int")), lambda x: x.isNotNull())
