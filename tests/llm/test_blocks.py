"""Benchmarks of several blocks and items without an id."""

from quillspan.llm import decontaminate


def test_repeated_and_null_ids_stay_rows(spark):
    rows = [(1, "a b c"), (1, "d e f"), (1, "nothing here"), (None, "a b c d e f"), (None, None), (2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "item_id long, text string")
    one = decontaminate.contamination(docs, items, 3).collect()
    many = decontaminate.contamination(docs, items, 3, block_bytes=5).collect()
    assert len(many) == len(rows) and sorted(map(str, many)) == sorted(map(str, one))


def test_items_without_an_id_count(spark):
    docs = spark.createDataFrame([(1, "x a b c"), (2, "d e f"), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c"), (7, "d e f"), (8, "a b c")], "item_id long, text string")
    for size in (5, 1000):
        got = {r["doc_id"]: (r["hit_words"], r["items"]) for r in decontaminate.contamination(docs, items.where("item_id is null or item_id = 7"), 3, block_bytes=size).collect()}
        assert got == {1: ([1, 2, 3], [None]), 2: ([0, 1, 2], ["7"]), 3: ([], [])}
        both = {r["doc_id"]: r["items"] for r in decontaminate.contamination(docs, items, 3, block_bytes=size).collect()}
        assert both[1] == ["8", None]
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, items.where("item_id is null"), 3).collect()] == [2, 3]
