import hashlib

from quantloom.llm import scratch, warc


def test_round_trip_revisits_and_seeks(spark):
    long = "x" * 700_000
    rows = [(1, "http://a/1", "same"), (2, "http://a/2\r\nEvil: 1", "same"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", long), (None, "u", "same"), (9, "u9", "é\r\n\r\nWARC/1.1"), (9, "u9", "é\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, owner string")
    index = warc.write_archives(pages, scratch.new_path(spark, "warc"))
    back = warc.read_archives(index).collect()
    got = sorted(("null" if r.page_id is None else str(r.page_id), r.record_type, None if r.refers_to is None else str(r.refers_to), r.payload_bytes, r.payload_digest) for r in back)
    assert len({r.record_id for r in back}) == len(rows) - 1  # only equal rows share an identifier
    owner = {"same": 2, "": 4, long: 5, "é\r\n\r\nWARC/1.1": 9}
    want = []
    for i, _, h in rows:
        h = h or ""
        own = owner[h] == i
        want.append(("null" if i is None else str(i), "response" if own else "revisit", None if own else str(owner[h]), len(h.encode()), warc.digest(h.encode())))
    assert got == sorted(want)
    for r in index.collect():  # random access by the archive's own seek table
        headers, block = warc.ArchiveReader(r.archive).record(r.frame, r.offset)
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.record_id}>"
        if headers["WARC-Type"] == "response":
            assert "sha1:" + warc.digest(block) == headers["WARC-Payload-Digest"]
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")


def test_reading_is_dealt_out_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 20_000)
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "array_join(transform(sequence(1, 200), x -> sha2(cast(id * 1000 + x as string), 256)), ' ') AS html")
    index = warc.write_archives(pages, scratch.new_path(spark, "warc"))
    read = warc.read_archives(index)
    assert read.rdd.getNumPartitions() > 12 and read.select("page_id").distinct().count() == 400


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, scratch.new_path(spark, "warc"))).count() == 0
