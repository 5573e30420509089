"""Urls without a rule do not follow the table's share of blocked labels."""

from quillspan.llm import urls


def test_a_large_blocked_host_blocks_no_other_host(spark):
    rows = [(i, f"http://x.net/es/{i}") for i in range(300)] + [(1000, "http://y.org/a/b"), (1001, "http://y.org/c"), (1002, None), (1003, "http://x.net/de/1")]
    got = {r["page_id"]: r["verdict"] for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[i] == "block" for i in range(300))
    assert [got[i] for i in (1000, 1001, 1002, 1003)] == ["allow"] * 4
