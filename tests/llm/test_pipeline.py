"""The whole pipeline against a run in plain Python on a small corpus."""

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

ITEM = "exactly these twelve benchmark words must never be seen in any training text"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("mor", "tel", "lan", "vi", "gor", "pel", "sta", "dre") for b in ("na", "dle", "ris", "tum", "ko", "sa", "ver", "ing")]
    common = "the of and to in a is that it for".split()

    def prose(n):
        words = [rng.choice(common) if rng.random() < 0.25 else rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n)]
        return " ".join(words) + "."

    rows = [(k, prose(rng.randint(60, 160)), "en", "abc"[k % 3], 1) for k in range(90)]
    rows += [(100 + k, rows[k][1], "en", "a", 1) for k in range(5)]  # exact copies
    rows += [(110 + k, rows[10 + k][1] + " added", "en", "b", 1) for k in range(5)]  # near copies
    rows += [(120 + k, f"{prose(70)} {ITEM.upper()} {prose(30)}", "en", "c", 1) for k in range(4)]
    rows += [(130, "#### $$$$ " * 200, "en", "a", 1), (131, "too short", "en", "a", 1), (132, None, None, None, None), (133, "same words here " * 60, "en", "b", 1)]
    rows += [(140, prose(90), None, None, None), (141, prose(90), "en", "b", 1), (141, prose(80), "en", "b", 1)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_each_stage_works_on_what_the_one_before_kept(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, path)
        if name != "token_output":
            assert made.columns == docs.columns
        docs = spark.createDataFrame(made.collect(), made.schema)
        seen[name] = docs.collect()
    clean = {r[0] for r in rows if r[0] < 100 or r[0] in (140, 141)}
    kept = {r.doc_id for r in seen["quality_rules"]}
    assert not kept & {130, 131, 132, 133} and kept >= clean
    near = [r.doc_id for r in seen["near_dedup"]]
    assert not set(near) & set(range(100, 120)) and set(near) >= clean and near.count(141) == 2
    assert {r.doc_id for r in seen["decontamination"]} == set(near) - set(range(120, 124))

    def words(text):
        return len(re.findall(r"[^\x20\x09-\x0D]+", text))

    before = {(r.doc_id, r.source): r for r in seen["decontamination"]}
    total = sum(words(r.text) for r in seen["decontamination"])
    mixed = seen["mixing"]
    assert abs(sum(words(r.text) for r in mixed) - total) <= 4
    assert all(any(r.text == o.text or o.text.startswith(r.text) for o in seen["decontamination"] if o.doc_id == r.doc_id) for r in mixed)
    assert before

    from tokenizers import Tokenizer

    from tabweave.llm.queries import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for doc in sorted({r.doc_id for r in mixed}):
        own = sorted([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in mixed if r.doc_id == doc)
        want += [(doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in own]
        start += sum(map(len, own))
    got = seen["token_output"]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in got)
    assert sum(r.n_tokens for r in got) == start
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]


def test_near_dedup_takes_copies_of_similarity_080(spark, tmp_path):
    words = [f"word{k}" for k in range(104)]
    near = [*words[:94], *[f"other{k}" for k in range(10)]]  # 90 of 110 shingles in common
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()] == [1]


def test_run_writes_each_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 50


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").filter("1 = 0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
