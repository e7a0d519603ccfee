import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabweave.llm import simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    made = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, bits); brute force over all pairs."""
    bits = sorted({b for _, b in rows})
    parent = {b: b for b in bits}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(bits, 2):
        if (x ^ y).bit_count() <= 3:
            parent[find(x)] = find(y)
    least = {}
    for doc, b in rows:
        if doc is not None:
            least[find(b)] = min(doc, least.get(find(b), doc))
    return sorted(((doc, f"{b:016x}", least.get(find(b))) for doc, b in rows), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_edges(docs, none):
    assert got(simhash.simhash_duplicates(docs)) == plain_components([(r.doc_id, plain_print(r.text)) for r in docs.collect()])
    assert got(simhash.simhash_duplicates(none)) == []


def test_fingerprint_of_a_text_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = "\n".join(" ".join(rng.choice(["Ab", "é", "中文", "x" * 40]) + str(rng.randrange(50)) for _ in range(30)) for _ in range(20))
    whole = plain_print(text)
    for piece in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == whole
        assert [simhash.fingerprint(t.encode()) for t in ("", " \n", "One", "a B", "a b\tc")] == [plain_print(t) for t in ("", " ", "One", "a B", "a b c")]


def test_masks_cover_every_choice_of_places():
    rng = random.Random(3)
    masks = simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15 and all(30 <= m.bit_count() <= 36 for m in masks)
    for _ in range(3000):
        gone = sum(1 << p for p in rng.sample(range(64), 3))
        meets = [m for m in masks if not m & gone]
        assert meets
        open_places = [p for p in range(64) if not meets[0] >> p & 1]
        finer = simhash.covering_masks(open_places, 3)
        assert any(not (meets[0] | m) & gone for m in finer)
        assert max(64 - (meets[0] | m).bit_count() for m in finer) <= 16


def test_links_equal_brute_force(spark, monkeypatch):
    """Chains, groups around one fingerprint and a crowded bucket that is split; every pair within three bits counts."""
    monkeypatch.setattr(simhash, "CROWDED", 20)
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for base in prints[:20]:
        at = base
        for _ in range(6):
            at ^= sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 5)))
            prints.append(at)
    crowd = rng.getrandbits(64)
    prints += [crowd ^ sum(1 << p for p in rng.sample(range(20), rng.randrange(0, 9))) for _ in range(150)]
    prints += [crowd ^ sum(1 << p for p in rng.sample(range(64), 3)) for _ in range(100)]
    rows = [(None if k % 50 == 7 else rng.randrange(10**6), b) for k, b in enumerate(prints)]
    df = spark.createDataFrame([(d, b - (1 << 64) if b >> 63 else b) for d, b in rows], "doc long, bits long")
    monkeypatch.setattr(simhash, "fingerprints", lambda d: d.select(F.col("doc").alias("doc_id"), F.col("bits").alias("fingerprint")))
    assert got(simhash.simhash_duplicates(df)) == plain_components(rows)


def test_forest_gives_the_first_of_each_component():
    bits = np.array([0, 0b1111, 0b111, 0b11110000, 1 << 63], np.uint64)
    assert simhash.forest(bits, 3).tolist() == [0, 0, 0, 3, 0]
