"""The near-duplicate stage of the pipeline against brute force at its own threshold."""

import collections

import corpus_pipeline
from quillspan.llm import neardup

from test_ops import FOLD, WORD


def smallest(texts, percent):
    """The smallest id of each group of texts linked at `percent`."""
    sets, top, inverted = {}, {i: i for i in texts}, collections.defaultdict(list)
    for i, t in texts.items():
        w = WORD.findall(t.translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
        for g in sets[i]:
            inverted[g].append(i)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    shared = collections.Counter((a, b) for ids in inverted.values() for j, b in enumerate(ids) for a in ids[:j])
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            top[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in texts}


def test_stage_links_from_80_percent(spark, tables):
    words = [f"w{i}" for i in range(300)]
    edited = lambda n: " ".join(f"e{i}" if i % 37 == 5 and i < 37 * n else w for i, w in enumerate(words))
    texts = {i: edited(n) for i, n in enumerate(range(9), 1000)}
    texts |= {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 90000 and text is not null").select("doc_id", "text").collect()}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.duplicate_stage(spark, docs, tables).collect()}
    assert smallest(texts, 80) != smallest(texts, 85)
    assert got == smallest(texts, 80)


def test_bands_follow_the_threshold():
    assert neardup.bands_for(85) == neardup.BANDS == 24
    for percent in (70, 80, 85, 95):
        assert (1 - (percent / 100) ** neardup.ROWS) ** neardup.bands_for(percent) <= neardup.UNMET
