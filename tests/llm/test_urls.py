from tabweave.llm import urls


def test_rules_and_parts(spark):
    rows = [
        (1, "http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "https://x.www.example.com/en/z", "x.www.example.com", "/en/z", "www.example.com/en/", "allow"),
        (4, "ftp://b.net/fr/#q", "b.net", "/fr/", "net/fr/", "block"),
        (5, "https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (6, "https://example.com", "example.com", "", None, None),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "a://b://c/d", "b:", "//c/d", None, None),
        (10, "x://net/es/É?", "net", "/es/É", "net/es/", "block"),
        (11, "https://big-casino-slots.test/win", "big-casino-slots.test", "/win", None, "block"),
        (12, "https://gardening.test/roses/red", "gardening.test", "/roses/red", None, "allow"),
        (12, "https://gardening.test/roses/red", "gardening.test", "/roses/red", None, "allow"),
        (13, "h://" + "a" * 50_000 + ".com/p", "a" * 50_000 + ".com", "/p", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(a, b, "h", "v") for a, b, *_ in rows], "page_id long, url string, host string, verdict string")
    model = urls.train(urls.labelled_urls(spark))
    got = urls.filter_urls(pages, model).collect()
    assert len(got) == len(rows)
    by = {r.row.page_id: r for r in got}
    for page, _, host, path, rule, verdict in rows:
        r = by[page]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict in (None, r.verdict) and 0 <= r.score <= 1
    assert urls.filter_urls(pages.filter("1 = 0"), model).count() == 0


def test_labelled_urls_are_learned(spark):
    labelled = urls.labelled_urls(spark)
    model = urls.train(labelled)
    from pyspark.sql import functions as F

    pages = labelled.select(F.concat(F.lit("x://"), "host", "path").alias("url"), "label")
    wrong = urls.filter_urls(pages, model, rules=()).filter((F.col("verdict") == "block") != (F.col("row.label") == 1))
    assert wrong.count() == 0
