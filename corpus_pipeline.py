"""The corpus pipeline: stages over `documents`, each written as Parquet before the next reads it.

All stages but the last return the columns of `documents`, further columns included, whatever their
names. Each works on every row that its predecessor kept and is a function of those rows alone. Ids
may repeat or be null: rows are judged one by one, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.llm.decontaminate import decontaminated
from quillspan.llm.langid import UNKNOWN, fit, held_out, labelled_sample, predictions
from quillspan.llm.neardup import deduplicated
from quillspan.llm.packing import packed
from quillspan.llm.pii import redacted
from quillspan.llm.scratch import written
from quillspan.session import ship

#: Jaccard percent of five-word shingles from which the stage takes texts for copies; op1's 85 is that query's own.
NEAR_PERCENT = 80
#: A text whose best language is barely ahead of the others' mean is rejected with those of no language.
LEAST_SCORE = 0.3
#: Bytes of chunks and ids that a worker of the packing stage keeps: a quarter of op8's, as the executor's heap is full by then.
DICTIONARY = 64 << 20


def language_stage(spark, docs, sf_dir):
    """Documents with a recognised language; the model learns from the labelled rows that are not held out.

    Null, empty and letterless texts have none and go. Equal texts are judged alike; ties between
    languages go to the first by name. Without labelled rows no language is known and all go.
    """
    model = fit(labelled_sample(docs.where(~held_out())))
    judged = predictions(docs, model)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def duplicate_stage(spark, docs, sf_dir):
    """The document with the smallest id of each group of near duplicates.

    Ties go to the smallest text hash, null ids come last, of equal rows one stays. Texts without
    words are in no group and stay.
    """
    return deduplicated(docs, percent=NEAR_PERCENT)


def benchmark_stage(spark, docs, sf_dir):
    """Documents that hold no window of a benchmark item.

    Null and wordless texts hold none and stay; items without text have no windows, items without
    an id count.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy_stage(spark, docs, sf_dir):
    """All documents, personal data masked, lengths renewed; texts without any, null and empty ones stay as they are."""
    return redacted(docs, length="n_chars" if "n_chars" in docs.columns else None)


def packing_stage(spark, docs, sf_dir):
    """Pieces of sequences of at most 4096 tokens; a null or empty text is its end id, repeated rows are pieces of their own."""
    return packed(docs, dictionary=DICTIONARY)


def _stage(f):
    return lambda spark, docs, sf_dir: f(ship(spark), docs, sf_dir)


STAGES = [
    ("language ID", _stage(language_stage)),
    ("near duplicates", _stage(duplicate_stage)),
    ("decontamination", _stage(benchmark_stage)),
    ("personal data", _stage(privacy_stage)),
    ("packing", _stage(packing_stage)),
]
#: Trained models, hashes and a tokenizer decide: SQL cannot express the stages, tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "_"))
    return docs
