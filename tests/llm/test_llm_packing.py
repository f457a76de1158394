import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(tokenizer, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_get_the_ids_of_whole_texts(tokenizer, monkeypatch):
    random.seed(5)
    signs = [*"aAbZ019.,!'#<| \n\t\réÉßñ×÷ẞİıſ", "<|endoftext|>", "'s", "'LL", "中", "😀", "̈", " ", " ", "\x85", "\x1c", "\x00", "²", "½", "Σ", "​", "١"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 30))) for _ in range(5000)]
    encoder = packing.Encoder(PATH)
    assert encoder(texts) == whole(tokenizer, texts)
    monkeypatch.setattr(packing, "REMEMBERED", 50)  # forgets again and again
    assert packing.Encoder(PATH)(texts) == whole(tokenizer, texts)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 1000)
    text = "".join(random.choices(signs, k=50_000))
    assert packing.Encoder(PATH)([text, "", "a"]) == whole(tokenizer, [text, "", "a"])


def test_other_vocabularies_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["A b\n c", "", "é"]
    assert packing.Encoder(path)(texts) == whole(Tokenizer.from_file(path), texts)


def test_pieces_make_up_the_stream(spark, tokenizer):
    random.seed(6)
    texts = [" ".join(random.choices(["Alpha", "beta,", "x1", "ωμέγα", "<|endoftext|>"], k=random.choice([0, 1, 5, 90, 700]))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 9, "clash") for i, t in enumerate(texts)] + [(3, texts[3], 9, "clash"), (None, "a", 9, None)], "doc_id long, text string, n long, ids string").repartition(5)
    pieces = packing.pack(docs, length=64)
    rows = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    stream = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows])
    place = 0
    for r in rows:
        assert r["sequence_id"] * 64 + r["offset"] == place and len(r["ids"]) == 4 * r["length"] > 0
        place += r["length"]
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.append(np.frombuffer(whole(tokenizer, [t or ""])[0], "<u4"), 2)
        own = sorted(by[i], key=lambda r: r["start"])
        if i != 3:
            assert (np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]) == ids).all() and own[0]["doc_tokens"] == len(ids)
    assert sum(r["length"] for r in by[3]) == 2 * by[3][0]["doc_tokens"] and None in by
    made = packing.sequences(pieces, 64).orderBy("sequence_id").collect()
    assert b"".join(r["ids"] for r in made)[: 4 * len(stream)] == stream.tobytes() and all(len(r["ids"]) == 256 for r in made)
    digest = packing.digest(pieces).first()
    assert digest["ids_crc32"] in {zlib.crc32(r["ids"]) for r in rows}
    assert packing.pack(docs.limit(0)).count() == 0


def thue_morse(letters):
    """A word and its complement, equal under sums of powers modulo 2**64 whatever the base."""
    word = [0]
    for _ in range(letters):
        word += [1 - x for x in word]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


def test_long_words_keep_their_ids(tokenizer, monkeypatch):
    texts = [*thue_morse(11), *thue_morse(12), "abcdefg", "abcdefgh", "abcdefg h", "a" * 300, "a" * 301]
    monkeypatch.setattr(packing, "LONG_BYTES", 4000)  # some words are forgotten on the way
    encode = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    assert encode(texts) == whole(tokenizer, texts)
    assert [encode([t])[0] for t in texts * 2] == whole(tokenizer, texts) * 2
