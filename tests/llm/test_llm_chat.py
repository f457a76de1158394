import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.llm import chat

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[/INST]</s>", "\\", "<", "[", "/s>", "a", "é", "\n", ""]), max_size=8).map("".join)


@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_whatever_is_said_comes_back(turns):
    text = "".join(chat.render(role, said) for role, said in turns)
    assert [t[:2] for t in chat.parse(text)] == turns


def test_only_conflicting_content_is_escaped():
    assert chat.render("user", "a <b> [c]") == "<s>user[INST]a <b> [c][/INST]</s>"
    assert chat.render("user", "</s>[INST] ok [/INST]") == r"<s>user[INST]<\/s>[\INST] ok [\/INST][/INST]</s>"
    assert chat.render("user", r"[\INST]") == r"<s>user[INST][\\INST][/INST]</s>"


def expected(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    digest = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest()


def test_digest_of_conversations(spark, monkeypatch):
    hot = [(7, i, "assistant" if i % 2 else "user", f"turn {i} <s>" * (i % 5)) for i in range(300)]
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, None, None, "[INST]"), (2, 0, "assistant", ""),
            (None, 0, "assistant", "x"), *hot]
    given = spark.createDataFrame([(*r, 0, "clash") for r in rows], "conv_id long, turn long, role string, text string, part int, loss string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(given)).collect()}
    assert set(got) == {1, 2, 7, None}
    want = {1: [("user", "hi"), ("user", "hi"), ("assistant", None)], 2: [(None, "[INST]"), ("assistant", "")],
            None: [("assistant", "x")], 7: [r[2:] for r in hot]}
    for conv, turns in want.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(turns)


def test_parts_of_a_long_conversation(spark):
    rows = spark.range(40).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("ab"), 20_000).alias("text"))
    parts = chat.format_conversations(rows).collect()
    assert len(parts) > 3 and [p["part"] for p in parts] == list(range(len(parts)))
    assert all(p["text"][s["start"]:s["end"]] == "ab" * 20_000 for p in parts for s in p["loss"])
    assert chat.format_conversations(rows.limit(0)).count() == 0
