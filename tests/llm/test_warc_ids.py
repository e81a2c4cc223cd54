import base64
import hashlib
from collections import Counter


def test_null_and_repeated_ids_keep_their_payloads(spark):
    from tallyfield.llm.warc import round_trip

    rows = [(3, "same"), (None, "same"), (None, "only of a null id"), (1, "one"), (2, "two"), (5, "one"), (5, "two"), (5, "five"), (6, "none"), (6, "none")]
    rows += [(None, "all null"), (None, "all null")]
    df = spark.createDataFrame([(i, "http://x", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    got = Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(df).collect())
    least = {}
    for i, h in rows:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    want = Counter()
    for i, h in rows:
        first = least.get(h)
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want[(i, digest, "response", None) if first is None or i == first else (i, digest, "revisit", first)] += 1
    assert got == want
