import re

from tabweave.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    out = []
    for doc, text in docs:
        have, hit, ids = words(text), set(), set()
        for item, t in items:
            want = words(t)
            n = min(size, len(want))
            if not n or item is None:
                continue
            for k in range(len(want) - n + 1):
                for p in range(len(have) - n + 1):
                    if have[p : p + n] == want[k : k + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item))
        out.append((doc, len(have), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


ITEMS = [(1, "Quick brown fox jumps over the lazy dog AND runs away from"), (2, "old mill"), (3, None), (4, ""), (None, "one two"), (5, "one two"), (5, "one two"), (6, "é中文 non")]


def test_contamination_equals_brute_force(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    small = docs.filter("doc_id is null or doc_id <> 7")
    for segment in (5, 1_000_000):
        index = dc.build_index(small, segment)
        got = dc.contamination(index, dc.phrase_matches(index, items, 4)).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got), key=repr)
        assert got == brute([(r.doc_id, r.text) for r in small.collect()], ITEMS, 4)


def test_blocks_of_items_give_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = dc.build_index(docs)
    whole = sorted(map(repr, dc.phrase_matches(index, items, 4).drop("segment").collect()))
    monkeypatch.setattr(dc, "BLOCK_WORDS", 3)
    monkeypatch.setattr(dc, "BROADCAST_TERMS", 0)
    assert sorted(map(repr, dc.phrase_matches(index, items, 4).drop("segment").collect())) == whole


def test_proximity_equals_brute_force(spark):
    texts = [(1, "a x b y c z a b c"), (2, "c b a"), (3, "a a a b q q q q q c"), (4, None), (5, "a b"), (6, "q c q b q a q q q a q c q b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "b b"), (3, "nowhere a")], "item_id long, text string")
    index = dc.build_index(docs)
    for span in (3, 5):
        got = {(r.doc_id, r.item_id, k) for r in dc.proximity_matches(index, items, span).collect() for k in range(r.first, r.last + 1)}
        want = set()
        for doc, text in texts:
            have = words(text)
            for item, terms in ((1, {"a", "b", "c"}), (2, {"b"})):
                holds = [(i, j) for i in range(len(have)) for j in range(i, min(len(have), i + span)) if terms <= set(have[i : j + 1])]
                for i, j in holds:
                    if not any((a, b) != (i, j) and a >= i and b <= j for a, b in holds):
                        want |= {(doc, str(item), k) for k in range(i, j + 1)}
        assert got == want


def test_stage_keeps_clean_rows_and_columns(spark, docs, none):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns
    # the story is in four rows; all others stay, as they are
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id not in (1, 2, 3))
    assert dc.decontaminate(none, items).count() == 0
    assert dc.decontaminate(docs, items.filter("1 = 0")).count() == docs.count()
