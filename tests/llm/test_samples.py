"""The labelled sample holds every label that has a lettered text."""

from quillspan.llm import langid


def test_copies_and_letterless_texts_hide_no_label(spark):
    copies = spark.range(40_000).selectExpr("concat('text number ', char(97 + id % 2), ' of label ', char(97 + id % 5)) as text", "concat('copied', id % 5) as lang")
    plain = spark.range(25_000).selectExpr("cast(id as string) as text", "concat('digits', id % 5) as lang")
    few = spark.range(5).selectExpr("concat('one word ', char(97 + id)) as text", "concat('digits', id) as lang")
    sample = langid.labelled_sample(copies.union(plain).union(few))
    assert {lang for _, lang in sample} == {f"{kind}{i}" for kind in ("copied", "digits") for i in range(5)}
    assert len(sample) == len(set(sample)) == 10 + 5
