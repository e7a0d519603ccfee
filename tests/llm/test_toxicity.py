import random

from tabweave.llm import toxicity


def corpus(rng, n):
    plain = [f"{a}{b}" for a in ("mo", "ter", "lan", "vi", "gor", "pel") for b in ("na", "dle", "ris", "tum", "ko", "sa", "ver", "ing")]
    bad = ["jerkface", "dumbhead", "grubworm", "slimeball", "nitwitted"]
    rows = []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "ish", "y"]))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_held_out_rows_are_told_apart(spark):
    rows = corpus(random.Random(4), 1200)
    df = spark.createDataFrame([(*r, "t", 0.5) for r in rows], "doc_id long, text string, label int, terms string, score double")
    sample = toxicity.labelled_sample(df.filter("doc_id % 3 <> 1"), df.select("doc_id", "label"))
    assert sample.count() == df.filter("doc_id % 3 <> 1").select("text").distinct().count()
    assert toxicity.labelled_sample(df, df.select("doc_id", "label"), 10).count() == 10
    scored = toxicity.score_toxicity(df, sample)
    held = [r for r in scored.collect() if r.row.doc_id % 3 == 1]
    wrong = sum((r.score >= 0.7) != (r.row.label == 1) for r in held)
    assert len(held) == 400 and wrong <= 8


def test_edges(spark, docs, none):
    rows = corpus(random.Random(6), 300)
    labelled = spark.createDataFrame([(t, y) for _, t, y in rows] + [(None, 1), ("", 0), ("x", None)], "text string, label int")
    got = toxicity.score_toxicity(docs, labelled).collect()
    assert len(got) == docs.count() and all(0 <= r.score < 0.7 for r in got)
    assert toxicity.score_toxicity(none, labelled).count() == 0
    unlabelled = toxicity.score_toxicity(docs, labelled.filter("1 = 0")).collect()
    assert {r.score for r in unlabelled} == {0.0}
