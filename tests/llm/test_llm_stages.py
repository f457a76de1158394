import corpus_pipeline
from test_llm_jaccard import brute_sets

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def kept_by_brute_force(docs, width, percent):
    """Ids that are the lowest of their group; for distinct ids."""
    sets = [brute_sets(t, width) for _, t in docs]
    low = [d for d, _ in docs]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and low[i] != low[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return sorted(d for (d, _), x in zip(docs, low, strict=True) if d == x)


def test_near_duplicates_share_four_fifths_of_five_words(spark):
    # One word of 50 changed: 80.4 % of five-word shingles are common, 88.2 % of three-word ones; of 45: 78.3 % and 87.0 %.
    made = []
    for n in (50, 45):
        words = [f"w{n}x{i}" for i in range(n)]
        made += [" ".join(words), " ".join([*words[:25], "other", *words[26:]])]
    rows = list(enumerate(made))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, SF).collect())
    assert kept == kept_by_brute_force(rows, 5, 80) == [0, 2, 3]


def test_near_duplicates_of_the_smallest_scale(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = sorted(r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, SF).collect())
    assert kept == kept_by_brute_force(rows, 5, 80) != kept_by_brute_force(rows, 3, 90)
