import re

import pytest
from pyspark.sql import functions as F

from tabweave.llm import mixing


def water(sizes, weights, most=3):
    total, left, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while left:
        rest = total - sum(out[k] for k in range(len(sizes)) if k not in left)
        share = {k: rest * weights[k] / sum(weights[j] for j in left) for k in left}
        full = {k for k in left if share[k] > most * sizes[k]}
        for k in full or left:
            out[k] = float(most * sizes[k]) if full else share[k]
        left -= full or left
    return out


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, " ".join(["w"] * (k % 37)), ["a", "b", "c", None, "d"][min(k % 17, 4)] if k % 17 < 4 else "d") for k in range(2000)]
    rows += [(5000, "tiny text", "zz"), (5001, None, "e"), (5002, "", "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken(corpus):
    made = mixing.mix(corpus, block_words=500, shards=5)
    rows = made.sizes.join(corpus.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == corpus.count()
    assert all(r.size == count(r.text) and 0 <= r.taken <= 3 * r.size for r in rows)
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r.size for r in rows if r.source == s) for s in names]
    want = water(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    for s, size, target in zip(names, sizes, want):
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(target, rel=1e-9)
        assert abs(sum(r.taken for r in own) - target) <= 1


def test_shards_hold_exactly_what_rows_say(corpus):
    made = mixing.mix(corpus, block_words=500, shards=5)
    parts = made.parts.groupBy("doc_id").agg(F.sum("words").alias("n"))
    taken = made.sizes.filter("taken > 0").select("doc_id", "taken")
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, taken.collect()))
    assert made.parts.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0
    sizes = [r.n for r in made.parts.groupBy("shard").agg(F.sum("words").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) < 2 * min(sizes)


def test_reruns_and_partitions_agree(corpus):
    one = sorted(map(repr, mixing.mix(corpus).parts.collect()))
    assert one == sorted(map(repr, mixing.mix(corpus.repartition(7)).parts.collect()))


def test_taken_is_what_the_written_shards_hold(corpus, monkeypatch):
    tree = mixing._tree
    monkeypatch.setattr(mixing, "_tree", lambda *a: tree(*a).filter("shard <> 1"))
    made = mixing.mix(corpus, block_words=500, shards=5)
    held, taken = made.parts.agg(F.sum("words")).first()[0], made.sizes.agg(F.sum("taken")).first()[0]
    assert taken == held < 0.9 * made.sizes.agg(F.sum("size")).first()[0]


def order(r):
    return r.shard, r.position, r.doc_id, r.copy, r.nth


def test_shards_are_written_and_emitted_in_their_order(spark, corpus):
    parts = mixing.mix(corpus, block_words=500, shards=5).parts
    files = sorted(parts.inputFiles(), key=lambda f: (re.search(r"shard=(\d+)/", f)[1], f))
    rows = [r for f in files for r in parts.filter(F.input_file_name() == f).collect()]
    assert rows == sorted(parts.collect(), key=order) and {r.shard for r in rows} == set(range(5))
    mixed = mixing.mixed_documents(corpus, block_words=500, shards=5).collect()
    assert [(r.doc_id, count(r.text)) for r in mixed] == [(r.doc_id, r.words) for r in rows]


def test_rows_that_repeat_are_taken_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 5 + [(2, "d e f g", "y")], "doc_id long, text string, source string")
    made = mixing.mix(docs, block_words=4, shards=2)
    assert made.sizes.count() == 6
    assert made.sizes.agg(F.sum("taken")).first()[0] == made.parts.agg(F.sum("words")).first()[0] == 19


def test_edges_and_columns(docs, none):
    made = mixing.mixed_documents(docs, shards=2)
    assert made.columns == docs.columns
    rows, sizes = made.collect(), mixing.mix(docs, shards=2).sizes.collect()
    assert len(sizes) == docs.count()
    assert sum(count(r.text) for r in rows) == sum(r.taken for r in sizes)
    whole = {(r.doc_id, r.source): r.text for r in docs.collect()}
    assert all(whole[r.doc_id, r.source].startswith(r.text) for r in rows)
    assert mixing.mix(none).sizes.count() == 0 and mixing.mixed_documents(none).count() == 0
