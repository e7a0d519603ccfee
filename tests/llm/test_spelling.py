import random
import re
import zlib
from collections import Counter

import pytest

from tabweave.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_forms(words):
    form, out = {}, []
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_edges(docs, none):
    thrice = docs.unionByName(docs).unionByName(docs)
    expected = plain_forms(plain_words([(r.doc_id, r.text) for r in thrice.collect()]))
    assert expected and got(spelling.spelling_variants(thrice)) == expected
    assert got(spelling.spelling_variants(none)) == []


def variants(rng, n, letters="abcdeé"):
    """Words of 1 to 14 letters around a few bases, one to three edits each."""
    out = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(n // 8)}
    bases = sorted(out)
    while len(out) < n:
        w = rng.choice(bases)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])
        if w:
            out.add(w)
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 14, 64])
def test_near_words_equal_brute_force(spark, monkeypatch, block):
    """Also with groups dealt to several blocks, questions in several lots and positions in several windows."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    monkeypatch.setattr(spelling, "WINDOW", 4)
    monkeypatch.setattr(spelling, "ASKED", 100)
    rng = random.Random(block)
    words = variants(rng, 600)
    words += [f"same{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnopqrst"]  # one half in common
    words += ["x" * 90, "x" * 91, "x" * 89 + "y", "y" + "x" * 89]
    counts = {w: rng.choice([5, 6, 30, 31, 200, 1000, 6000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.spelling_forms(df)) == plain_forms(counts)


def test_runs_of_a_text_in_pieces(monkeypatch):
    text = "Straße ÀÉ×÷ÿ naïve—Œuvre ĀB don't x1y ABC" * 5
    whole = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[A-Za-zÀ-ÿ]+", text))
    for piece in (1, 5, 1 << 20):
        monkeypatch.setattr(spelling, "PIECE", piece)
        assert {w.decode(): n for w, n in spelling.runs_of(text.encode()).items()} == whole


def test_words_of_planted_deletions(spark):
    rows = [(k % 700, "gathering Wanderers überall " * 3) for k in range(1500)] + [(None, "gathering")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_words(rows)
    assert len(expected) > 3
    assert dict(map(tuple, spelling.word_counts(df).filter("n >= 5").collect())) == expected
