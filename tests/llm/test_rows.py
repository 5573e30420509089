"""Repeated, null and hot rows: none is lost, none is stored or placed twice, no task holds them all."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import langid, media, neardup, packing, pii, scratch, sharding

from test_near_stage import smallest
from test_ops import FOLD


def test_one_row_of_each_group_stays(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, words), (1, "a text of its own under the same id"), (1, words),  # one id, two texts, an equal row
        (2, words + " more"), (None, words), (None, "alone without an id here"), (None, "alone without an id here"),
        (3, None), (3, None), (4, ""), (5, "x y"), (6, "x y"),
    ]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, hash string")
    got = neardup.deduplicated(docs, 80)
    assert got.columns == docs.columns
    want = [(1, words), (1, "a text of its own under the same id"), (None, "alone without an id here"), (3, None), (3, None), (4, ""), (5, "x y")]
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter(want)
    assert neardup.deduplicated(docs.limit(0), 80).collect() == []


def test_a_stray_does_not_multiply_a_large_group(spark):
    n = 20_000
    members = spark.range(n + 1).selectExpr("1L as bucket", "0 as band", "id as node", "0L as pivot", f"if(id = {n}, {n}L, 0L) as root")
    open_ = members.selectExpr("*", f"{n + 1}L as size", "2L as comps", "0L as main", f"{n}L as held")
    out = neardup.blocks_of(open_).groupBy("bucket", "i", "j", "main_block").agg(F.count("*").alias("n"), F.count_if("left").alias("strays"))
    found = out.collect()
    assert sum(r["n"] for r in found) <= 1.02 * n + 2
    assert max(r["n"] for r in found) <= 2 * neardup.BLOCK


def test_all_pairs_of_strays_meet(spark):
    n = 1200
    members = spark.range(n).selectExpr("1L as bucket", "0 as band", "id as node", "-1L as pivot", "if(id < 300, 0L, id) as root")
    open_ = members.selectExpr("*", f"{n}L as size", "901L as comps", "0L as main", "300L as held")
    met = set()
    for r in neardup.blocks_of(open_, 256).groupBy("i", "j", "main_block").agg(F.collect_list(F.struct("node", "left", "own")).alias("x")).collect():
        left, right = [m["node"] for m in r["x"] if m["left"]], [m["node"] for m in r["x"] if not m["left"]]
        right = left if r["x"][0]["own"] else right
        met |= {(min(a, b), max(a, b)) for a in left for b in right if a != b}
    assert {(a, b) for a in range(n) for b in range(max(a + 1, 300), n)} <= met


def test_strays_find_their_links(spark):
    # many copies of one text with an edit each share their buckets with texts that only some of them are linked to
    words = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(words[:i] + [f"e{i}"] + words[i + 1 :]) for i in range(100)}
    texts |= {1000 + i: " ".join(words[:i] + [f"e{i}"] + words[i + 1 : 100] + [f"z{k}" for k in range(8)]) for i in range(0, 90, 7)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in neardup.deduplicated(docs, 85).collect()} == smallest(texts, 85)


@pytest.mark.parametrize("key", ["cast(null as long)", "7L"])
def test_blocks_of_pieces_share_out_rows_without_a_name(spark, key):
    pieces = spark.range(10_000).selectExpr(f"if(id < 8000, {key}, id) as doc_id", "0L as start", "if(id < 8000, 100L, 50 + id % 90) as length", "1L as ids_crc32", "100L as doc_tokens")
    got = packing.pack(pieces, 10_000, block=1000).collect()
    blocks = collections.Counter(r["sequence_id"] >> packing.ROOM for r in got)
    assert len(got) == 10_000 and len(blocks) == 10 and max(blocks.values()) <= 2000


def test_ranges_of_one_repeated_row_are_divided(spark):
    docs = spark.range(4000).selectExpr("7 as doc_id", "'the same row very often' as text")
    rows = sharding.sharded(docs, 8, ranges=4).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == 4000 and max(sizes.values()) - min(sizes.values()) <= 2
    for shard in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sizes[shard]))


def test_boundaries_divide_rows_by_all_their_parts():
    rng = np.random.default_rng(0)
    bounds = sorted({tuple(rng.integers(0, 4, 3).tolist()) for _ in range(20)})
    keys = [tuple(x) for x in rng.integers(0, 4, (300, 3)).tolist()]
    got = sharding._at_or_below([np.array([b[i] for b in bounds]) for i in range(3)], [np.array([k[i] for k in keys]) for i in range(3)])
    assert got.tolist() == [sum(b <= k for b in bounds) for k in keys]


def test_equal_rows_are_stored_once(spark):
    docs = spark.createDataFrame([(1, "one text")] * 5 + [(None, "one text")] * 3 + [(2, "another")], "doc_id long, text string")
    store = media.MediaStore(docs)
    assert store.store.where("kind <> 'shared'").count() == 2
    assert len(media.media(docs).collect()) == 9


def test_media_values_from_their_definition(spark):
    import hashlib
    import struct

    texts = [None, "", "short", "repeated passage " * 400, "x" * 5000, "repeated passage " * 400 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media(docs).collect():
        b = (texts[r["doc_id"]] or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        ends, last, h = [], 0, 0
        for i, byte in enumerate(p, 1):
            h = ((h << 1) + int(media._GEAR[byte])) & 0xFFFFFFFF
            if i - last == media.MOST or (h >> (32 - media.BITS) == 0 and i - last >= media.LEAST) or i == len(p):
                ends.append(i)
                last = i
        pieces = [p[a:z] for a, z in zip([0, *ends], ends)]
        head = b"".join(hashlib.blake2b(c, digest_size=16).digest() + struct.pack("<I", len(c)) for c in pieces)
        assert (r["media_bytes"], r["media_sha256"]) == (len(head) + len(p), hashlib.sha256(head + p).hexdigest())
        steps = sum(abs(a - z) for a, z in zip(p, p[1:]))
        assert r["feature"] == f"samples={len(p)};sum={sum(p)};max={max(p)};blanks={p.count(b' ')};steps={steps};chunks={len(pieces)}"


def test_shapes_of_whole_words():
    assert pii._classes("a" * 100 + "1B-") == "x" * 100 + "dX-"


def test_language_scores_from_their_definition():
    sample = [("the cat and the dog sat", "en"), ("a dog and the bird", "en"), ("le chat et le chien", "fr"), ("un chien et la pluie", "fr"), ("der hund und die katze", "de")]
    model = langid.fit(sample, landmarks=3)

    def places(text):
        x = " ".join(re.findall(r"[a-z]+", text.lower()))
        x, out = f" {x} ".encode(), set()
        for n in langid.GRAMS:
            for k in range(len(x) - n + 1):
                code = x[k]
                for c in x[k + 1 : k + n]:
                    code = (code * 257 + c) & 0xFFFFFFFF
                out.add((((code * 0x9E3779B1 + n) & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF) >> 19)
        return out

    def kernel(a, b):
        return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))

    marks = [places("der hund und die katze"), places(sample[0][0]), places(sample[2][0])]
    k = np.array([[*(kernel(places(t), m) for m in marks), 1.0] for t, _ in sample])
    core = np.zeros((4, 4))
    core[:3, :3] = [[kernel(a, b) for b in marks] for a in marks]
    core[3, 3] = 1e-3
    weight = np.array([1 / 2, 1 / 2, 1 / 2, 1 / 2, 1.0])
    target = np.array([[1.0 if lang == want else -1.0 for want in ("de", "en", "fr")] for _, lang in sample])
    w = np.linalg.solve((k * weight[:, None]).T @ k + langid.RIDGE * (core + 1e-6 * np.eye(4)), (k * weight[:, None]).T @ target)
    for text in ("the bird and a cat", "la pluie et le chat", "die katze", "zzz"):
        margin = np.array([*(kernel(places(text), m) for m in marks), 1.0]) @ w
        lang, score = model.predict([text])
        assert lang == [("de", "en", "fr")[int(margin.argmax())]]
        assert score[0] == pytest.approx(np.exp(4 * margin.max()) / np.exp(4 * margin).sum(), rel=1e-3)


def test_equal_margins_go_to_the_first_language():
    model = langid.fit([("abc def", "aa"), ("abc def", "bb")])
    assert model.predict(["abc def"])[0] == ["aa"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://head:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Session())


def test_stages_on_empty_tables(spark, nothing):
    now = spark.read.parquet(f"{nothing}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.written(stage(spark, now, nothing), "test")
        assert now.count() == 0
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_stages_keep_and_drop_whole_rows(spark, tables):
    """Each stage against a plain version on its own input, rows counted."""
    plain = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    stages, now = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tables}/documents.parquet")
    before = collections.Counter(plain(now))
    now = scratch.written(stages["language ID"](spark, now, tables), "test")
    lettered = plain(now)
    assert not collections.Counter(lettered) - before
    assert all(t is None or not re.search(r"[^\W\d_]", t) for i, t in (before - collections.Counter(lettered)) if (i or 0) >= 90000)

    now = scratch.written(stages["near duplicates"](spark, now, tables), "test")
    single = plain(now)
    texts = dict(enumerate(sorted(lettered, key=lambda x: (x[0] is None, x[0] or 0))))  # numbered in the order of their ids
    want = smallest({n: t for n, (_, t) in texts.items()}, corpus_pipeline.NEAR_PERCENT)
    assert sorted(str(i) for i, _ in single) == sorted(str(texts[n][0]) for n in want)
    assert not collections.Counter(single) - collections.Counter(lettered)

    now = scratch.written(stages["decontamination"](spark, now, tables), "test")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(FOLD))
    windows = set()
    for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = lambda t: not any(tuple(words(t)[k : k + n]) in windows for n in sizes for k in range(len(words(t)) - n + 1)) if len(t) < 100_000 else True
    assert collections.Counter(plain(now)) == collections.Counter(x for x in single if clean(x[1]))

    left = plain(now)
    now = scratch.written(stages["personal data"](spark, now, tables), "test")
    masked = plain(now)
    field = pii.default_field()
    import pyarrow as pa

    spans = pii.spans_of(pa.array([t for _, t in left], pa.string()), field)
    assert collections.Counter(masked) == collections.Counter((i, pii.masked(t, found[1])) for (i, t), found in zip(left, spans))
    lengths = collections.defaultdict(int)
    for r in stages["packing"](spark, now, tables).collect():
        lengths[r["doc_id"]] += r["length"]
    assert set(lengths) == {i for i, _ in masked}
