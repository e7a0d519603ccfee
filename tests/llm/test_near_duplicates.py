import random
import re

import pytest

from tabweave.llm import near_duplicates as nd
from tabweave.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(k) and d is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[k]), least, doc == least))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()), key=repr)


def test_edges(docs, none):
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(none) == []
    kept = nd.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "9", "None"]


def test_group_around_one_original(spark):
    """Copies with two edits each resemble the original and not each other; there are more than a node's neighbours in any order."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        copy = list(base)
        for p in rng.sample(range(150), 2):
            copy[p] = f"edit{k}x{p}"
        rows.append((k, " ".join(copy)))
    rows += [(k, " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for k in range(1000, 1100)]
    rows += [(2000 + k, rows[7][1].upper()) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows)


def test_alike_pairs_and_stars_among_documents_with_one_long_passage(spark):
    """All share a passage and are 0.80 alike; some pairs, and groups round several originals, are more alike and lie anywhere in the orders."""
    rng = random.Random(11)

    def own(n):
        return [f"v{rng.randrange(10**8)}" for _ in range(n)]

    passage = own(204)
    texts = [passage + own(26) for _ in range(560)]
    for k in range(20):
        texts[400 + k] = texts[k][:213] + own(17)
    for k in range(6):
        star = passage + own(26)
        texts += [star, *[[*star[:p], f"edit{k}x{p}", *star[p + 1 :]] for p in range(0, 200, 20)]]
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = brute(rows)
    assert 20 <= len({r[2] for r in want}) < len(rows) - 60
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_lower_limits_widen_the_search():
    assert nd.least_agreeing(85) == 95 and nd.least_agreeing(80) == 87 and nd.least_agreeing(50) <= 45
    assert nd.dense_depth(10**5, 85) == 3 and nd.dense_depth(10**5, 50) == 1


def test_pairs_just_above_a_low_limit(spark):
    """Fewer of their signature bytes agree than of a pair at 0.85."""
    rng = random.Random(4)
    texts = []
    for k in range(120):
        base = [f"u{rng.randrange(10**8)}" for _ in range(104)]
        texts += [base, [*base[:74], *[f"z{rng.randrange(10**8)}" for _ in range(30)]]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 53).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: k // 2 * 2 for k in range(240)}


@pytest.mark.parametrize("n", [1, 60])
def test_components_of_chains_and_stars(spark, n):
    edges = [(k, k + 1) for k in range(n)] + [(500, 500 + k) for k in range(1, 80)] + [(900, 900)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(n + 1)} | {500 + k: 500 for k in range(80)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
