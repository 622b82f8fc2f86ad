import hashlib

from helixframe.llm import warc

BIG = "<p>é text\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n</p>" * 60
PAGES = [
    (1, "http://a/x y\n", BIG, "q"), (2, None, BIG, "q"), (5, "http://c", BIG, "q"), (3, "http://d", None, "q"), (4, "http://e", "", "r"), (6, "http://f", "small", "r"), (7, "http://g", "small", "r"),
    (None, "http://h", BIG, None), (8, "http://i", "é" * 500, "z"), (9, "http://j", "é" * 500, "z"), (10, "http://k", "x" * 999, "z"), (11, "http://l", "x" * 999, "z"), (5, "http://c", BIG, "q"),
]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")
    found = warc.read(spark, warc.write(df), with_payload=True)
    rows = warc.resolved(found).collect()
    assert len(rows) == len(PAGES)
    got = sorted(((r["page"], r["record_type"], r["refers_to"], r["payload_bytes"], r["digest"], bytes(r["payload"])) for r in rows), key=str)
    expected = []
    for page, _, text, _ in PAGES:
        payload = (text or "").encode()
        same = [p for p, _, t, _ in PAGES if (t or "") == (text or "") and p is not None]
        revisit = len(payload) >= 1000 and page is not None and page != max(same)
        expected.append((str(page) if page is not None else None, "revisit" if revisit else "response", str(max(same)) if revisit else None, len(payload), hashlib.sha1(payload).hexdigest(), payload))
    assert got == sorted(expected, key=str)
    urls = {r["page"]: r["url"] for r in rows}
    assert urls["1"] == "http://a/x%20y%0A" and urls["2"] is None
    assert warc.read(spark, warc.write(df.limit(0))).count() == 0


def test_revisits_name_the_response(spark):
    """Headers of the archives themselves: a revisit has id, url and date of its response, no block but HTTP headers."""
    path = warc.write(spark.createDataFrame([*PAGES, (5, "http://b z", BIG, "q")], "page_id long, url string, html string, digest string"))
    files = spark.read.format("binaryFile").load(f"{path}/*.gz").select("content").collect()
    heads = [(h, payload) for f in files for h, _, payload in warc._parsed(bytes(f["content"]))]
    responses = {h["WARC-Record-ID"]: h for h, _ in heads if h["WARC-Type"] == "response" and "X-Page-ID" in h}
    revisits = [(h, payload) for h, payload in heads if h["WARC-Type"] == "revisit"]
    assert {h["X-Page-ID"] for h, _ in revisits} == {"1", "2", "8"}
    for h, payload in revisits:
        its = responses[h["WARC-Refers-To"]]
        assert (its["X-Page-ID"], h["WARC-Refers-To-Target-URI"]) == (("9", "http://j") if h["X-Page-ID"] == "8" else ("5", "http://c"))
        assert h["WARC-Refers-To-Date"] == its["WARC-Date"] and h["WARC-Profile"] == warc.PROFILE and not payload
    assert not any("WARC-Refers-To-Date" in h for h in responses.values())


def test_urls_are_percent_encoded(spark):
    df = spark.createDataFrame([(1, "http://a.b/x y\tz\r\n\x00\x7f%20é", "p")], "page_id long, url string, html string")
    found = warc.read(spark, warc.write(df)).collect()
    assert found[0]["url"] == "http://a.b/x%20y%09z%0D%0A%00%7F%20é"
