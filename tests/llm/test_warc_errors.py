import io

import pytest


def test_broken_records_raise():
    from tallyfield.llm.warc import WarcError, members, page_record, parse

    good = page_record(5, "http://x/ y", "<p>é</p>", None)
    two = list(members(io.BytesIO(good + page_record(6, None, None, 5))))
    headers, block = parse(two[0])
    assert headers["warc-type"] == "response" and block.endswith("<p>é</p>".encode()) and parse(two[1])[0]["warc-refers-to"] == "<urn:page:5>"
    with pytest.raises(WarcError, match="within a member"):
        list(members(io.BytesIO(good[:-9])))
    member = two[0]
    with pytest.raises(WarcError, match="differs"):
        parse(member.replace("<p>é".encode(), "<p>è".encode()))
    at = member.index(b"\r\nContent-Length: ", member.index(b"WARC-Block-Digest"))
    with pytest.raises(WarcError, match="frame"):
        parse(member[:at] + member[at:].replace(b"Content-Length: ", b"Content-Length: 1", 1))
    with pytest.raises(WarcError, match="not a WARC"):
        parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_archive_with_fewer_records_than_written_raises(spark):
    from tallyfield.llm import common, warc

    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    folder = common.scratch_path(spark, "warc-test")
    files = warc.write_archives(pages, folder)
    assert warc.read_archives(files, folder).count() == 5
    more = files.selectExpr("path", "n_records + 1 as n_records")
    with pytest.raises(Exception, match="were written"):
        warc.read_archives(more, folder).collect()
