import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pagelens.llm import pii, toxicity
from pagelens.llm.queries import ORACLE_SQL, QUERIES, toxicity_model
from test_llm_decontam import brute as brute_hits
from test_llm_stages import kept_by_brute_force

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in QUERIES} and set(QUERIES) <= set(names)
    assert "pipeline" in names and set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What went into and came out of each stage at the smallest scale, with a few rows planted."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    planted = [(900_001, None, None, None, None), (900_002, "", "en", "x", 0), (900_003, f"before {item} after", "en", "x", 1),
               (900_004, "write to me at jane.doe@mail.example.com please", "en", "x", 1), (900_005, "Write to me at jane.doe@mail.example.com please", "en", "x", 1)]
    docs, out = given.unionByName(spark.createDataFrame(planted, given.schema)), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark, stages):
    before, after = {n: b for n, b, _ in stages}, {n: a for n, _, a in stages}
    assert list(before) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    for name, df in after.items():
        assert name == "packing" or df.columns == before["toxicity"].columns

    # Some ten toxic labels at this scale: too few to hold the model to its labels, see README.
    model = toxicity_model(before["toxicity"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(texts(after["toxicity"]), key=str) == sorted([(d, t) for d, t in texts(before["toxicity"]) if model.score(t or "") < toxicity.THRESHOLD], key=str)

    expected = kept_by_brute_force(texts(before["near_duplicates"]), corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert sorted(d for d, _ in texts(after["near_duplicates"])) == expected
    assert 900_005 not in {d for d, _ in texts(after["near_duplicates"])}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {d for d, _, n, _ in brute_hits(texts(before["decontamination"]), items, 10) if n}
    assert 900_003 in hits and {d for d, _ in texts(after["decontamination"])} == {d for d, _ in texts(before["decontamination"])} - hits

    masked = dict(texts(after["personal_data"]))
    assert masked == {d: t if t is None else pii.masked(t) for d, t in texts(before["personal_data"])}
    assert masked[900_004] == "write to me at [EMAIL] please" and masked[900_001] is None

    pieces = after["packing"].collect()
    assert {r["doc_id"] for r in pieces} == set(masked)
    assert all(len(r["ids"]) == 4 * r["length"] for r in pieces)
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_run_applies_all_stages(spark, tmp_path):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 100 and "sequence_id" in rows.columns


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
