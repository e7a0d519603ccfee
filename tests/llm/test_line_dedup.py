import random
from itertools import combinations

from pyspark.sql import functions as F

from tabweave.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, most=3):
    s = list(s)
    for _ in range(rng.randint(0, most)):
        k, what = rng.randrange(len(s) + 1), rng.random()
        if what < 0.33 or k == len(s):
            s.insert(k, rng.choice("abé "))
        elif what < 0.66:
            del s[k]
        else:
            s[k] = rng.choice("abé ")
    return "".join(s)


def test_links_equal_brute_force(spark):
    rng = random.Random(2)
    bases = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 60))) for _ in range(20)]
    lines = [edited(rng, rng.choice(bases)) for _ in range(240)]
    texts = [(k, "\n".join(lines[k * 6 : k * 6 + 6])) for k in range(40)]
    rows = [*texts, (40, None), (41, ""), (3, texts[3][1]), (None, texts[5][1])]
    assert linked(spark, rows) == near_pairs(rows)


def linked(spark, rows):
    """Linked lines by their first place and text; a node's hash is looked up in the rows' own lines."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    named = {(r.h1, r.h2): r.line for r in ld._lines(df).collect()}
    return {frozenset((*n[:2], named[tuple(n[2:])]) for n in (r.a, r.b)) for r in ld.line_links(df)[1].collect()}


def near_pairs(rows):
    first = {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if line.split():
                place = (doc is not None, doc or 0, k)
                first[line] = min(first.get(line, place), place)
    known = [x for x in first if len(x) >= ld.LEAST_CHARS]
    node = {x: (first[x][1] if first[x][0] else None, first[x][2], x) for x in known}
    return {frozenset((node[a], node[b])) for a, b in combinations(known, 2) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}


def test_repeated_and_null_ids_keep_their_lines_apart(spark):
    one, two = "the first line of a document, long enough", "quite another line, of about as many characters"
    rows = [(None, one), (None, two), (2, one + "x"), (2, one + "x")]
    assert linked(spark, rows) == near_pairs(rows) and len(near_pairs(rows)) == 1
    df = spark.createDataFrame([(doc or 1, text) for doc, text in rows], "doc_id long, text string")
    found = {r.doc_id: tuple(r)[1:] for r in ld.line_duplicates(df)[0].collect()}
    assert found == {1: (2, 2, 1, 1), 2: (2, 0, 1, 1)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in ld.without_duplicate_lines(df).collect()), key=repr)
    assert left == sorted([(None, one), (None, two), (2, ""), (2, "")], key=repr)


def test_crowds_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("the quick brown fox, 17 zebras") for _ in range(60))
    lines = [base]
    for _ in range(110):
        s, k = edited(rng, base, 2), rng.randrange(50)
        lines.append(s[:k] + "".join(rng.choice("etaxz9") for _ in range(4)) + s[k + 4 :] if rng.random() < 0.6 else s)
    rows = [(k, line) for k, line in enumerate(lines)]
    want = near_pairs(rows)
    assert len(want) > 100
    monkeypatch.setattr(ld, "CROWD", 8)
    assert linked(spark, rows) == want


def test_automaton_equals_dynamic_programming(spark):
    rng = random.Random(3)
    bases = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["é中😀" * 30]
    pairs = [(edited(rng, x), x) for x in bases for _ in range(6)] + [("", ""), ("abc", ""), ("", "ab")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (0, 1, 2, 3):
        for r in df.select("a", "b", ld.within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect():
            assert r.near == (distance(r.a, r.b) <= edits), (r, edits)


def test_documents(spark, docs, none):
    line = "this is one line of a document that occurs again"
    rows = [(1, f"{line}\nsomething else entirely in here\nshort"), (2, f"{line}!\nshort\n\n{line}"), (3, None), (4, "")]
    small = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line int")
    found = {r.doc_id: tuple(r)[1:] for r in ld.line_duplicates(small)[0].collect()}
    assert found == {1: (3, 3, 1, 1), 2: (3, 0, 1, 1), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0)}
    assert {r.doc_id: r.text for r in ld.without_duplicate_lines(small).collect()} == {1: rows[0][1], 2: "", 3: None, 4: ""}
    assert ld.line_duplicates(docs)[0].count() == docs.select("doc_id").distinct().count()
    assert ld.line_duplicates(none)[0].count() == 0


def test_lines_of_one_first_hash_are_compared_with_each_other(spark, monkeypatch):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abé ") for _ in range(rng.randint(24, 50))) for _ in range(6)]
    rows = [(k, "\n".join(edited(rng, rng.choice(bases), 2) for _ in range(4))) for k in range(12)]
    own = ld._lines
    monkeypatch.setattr(ld, "_lines", lambda docs: own(docs).withColumn("h1", F.pmod("h1", F.lit(5))))
    assert linked(spark, rows) == near_pairs(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = [frozenset((r.a, r.b)) for r in ld.line_links(df)[1].collect()]
    assert len(links) == len(set(links))


def test_only_lines_that_share_a_key_are_counted(spark, monkeypatch):
    rng = random.Random(11)
    lines = ["".join(rng.choice("abcdefghijklmnop éü") for _ in range(rng.randint(30, 60))) for _ in range(60)]
    rows = [(k, line) for k, line in enumerate(lines)] + [(60, lines[7] + "x"), (61, lines[7])]
    counted = []

    def watched(own):
        def kept(df, *args):
            table = own(df, *args)
            if "counts" in table.columns:
                counted.append(table.select("h1").distinct().count())
            return table

        return kept

    monkeypatch.setattr(ld, "stored", watched(ld.stored))
    monkeypatch.setattr(ld, "materialize", watched(ld.materialize))
    want = near_pairs(rows)
    assert len(want) == 1 and linked(spark, rows) == want
    assert counted and max(counted) == 2
    # too many lines to broadcast
    monkeypatch.setattr(ld, "BROADCAST_LINES", 0)
    monkeypatch.setattr(ld, "BROADCAST_HASHES", 0)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert linked(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
