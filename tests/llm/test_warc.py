import hashlib

from tabweave.llm import warc


def test_round_trip(spark):
    big = "<p>é</p>" * 40
    rows = [(3, "http://a/", big), (1, "http://b/\r\nX: y", big), (2, None, big), (2, None, big), (9, "http://c/", "short"), (8, "http://c/", "short"), (7, "u", None), (6, "u", ""),
            (None, "n", big), (20, "x", "z" * 400_000), (21, "x", "<b>\r\n\r\nWARC/1.1\r\n</b>" * 20)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    files = warc.write_warc(pages.repartition(3))
    got = warc.read_warc(spark, files)
    want = []
    for page, url, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        again = len(raw) >= 100 and same and page != min(same)
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None, None if again else raw))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert {r.url for r in got.filter("page_id = 1").collect()} == {"http://b/%0D%0AX:%20y"}
    assert warc.read_warc(spark, warc.write_warc(pages.filter("1 = 0"))).count() == 0


def test_each_file_leads_with_its_dictionary(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<html><body>{'the same words ' * 9}{k} {hash(str(k))}</body></html>") for k in range(3000)], "page_id long, url string, html string")
    row = warc.write_warc(pages.coalesce(1)).first()
    raw = warc.open_input(row.file).read()
    assert raw[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    kinds = [f["WARC-Type"] for f, _ in warc.read_records(row.file)]
    assert kinds == ["warcinfo"] + ["response"] * 3000 and row.records == 3000 and row.bytes == len(raw)
