"""Matches against plain versions with ties: greedy IoU, nearest events, frame labels, votes."""

import math
import random

from quillspan.operators import frames as fr
from quillspan.operators import intervals as iv


def spans(rng, n, recordings=3, most=40):
    out = []
    for i in range(n):
        a = rng.randint(0, most)
        out.append((rng.randrange(recordings), i, rng.choice("ab"), float(a), float(a + rng.randint(1, 6))))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "recording_id long, event_id long, name string, start_s double, stop_s double")


def overlap(a, b):
    cut = min(a[4], b[4]) - max(a[3], b[3])
    return cut / (max(a[4], b[4]) - min(a[3], b[3])) if cut > 0 else 0.0


def greedy(truth, pred, least):
    pairs = sorted((-overlap(t, p), t[1], p[1], t[0], t[2]) for t in truth for p in pred if t[0] == p[0] and t[2] == p[2] and overlap(t, p) >= least)
    used_t, used_p, out = set(), set(), set()
    for _, i, j, *_ in pairs:
        if i not in used_t and j not in used_p:
            used_t.add(i)
            used_p.add(j)
            out.add((i, j))
    return out


def test_greedy_matches_with_ties(spark):
    rng = random.Random(1)
    for least in (0.25, 0.0):
        truth, pred = spans(rng, 120), spans(rng, 110)
        got = {(r["i"], r["j"]) for r in iv.matched(table(spark, truth), table(spark, pred), least).collect()}
        assert got == greedy(truth, pred, least)


def test_a_chain_of_preferences_is_followed_to_its_end(spark):
    pairs = [("k", i, i + d, 0.99 - (2 * i + d) / 100) for i in range(12) for d in (0, 1)]
    got = iv.greedy_match(spark.createDataFrame(pairs, "k string, i long, j long, iou double"), ["k"], rounds=2).collect()
    assert sorted((r["i"], r["j"]) for r in got) == [(i, i) for i in range(12)]
    late = [("k", i, i + d, 0.5 + (2 * i + d) / 100) for i in range(12) for d in (0, 1)]
    got = iv.greedy_match(spark.createDataFrame(late, "k string, i long, j long, iou double"), ["k"], rounds=2).collect()
    assert sorted((r["i"], r["j"]) for r in got) == [(i, i + 1) for i in range(12)]


def test_nearest_cuts_distances_and_takes_the_lowest_index(spark):
    rng = random.Random(2)
    left = [(rng.randrange(3), i, rng.randint(0, 400) / 7) for i in range(150)]
    right = [(rng.randrange(3), i, rng.choice([rng.randint(0, 400) / 7, float(rng.randint(0, 57))])) for i in range(120)]
    for rate, tolerance in ((1.0, 2.0), (10.0, 0.5), (0.5, None)):
        want = {}
        for rec, i, t in left:
            found = [(math.floor(abs(r - t) * rate), j) for rc, j, r in right if rc == rec]
            if found and (tolerance is None or min(found)[0] <= tolerance * rate):
                want[i] = (min(found)[1], min(found)[0] / rate)
        frame = lambda x: spark.createDataFrame(x, "recording_id long, id long, t double")
        got = {r["id"]: (r["near_id"], r["dist"]) for r in iv.nearest(frame(left), frame(right), tolerance, rate, width=9.0).collect()}
        assert got == want


def test_pieces_are_the_frames_of_spine_and_stab(spark):
    rng = random.Random(3)
    sides = {"t": table(spark, spans(rng, 40)), "p": table(spark, spans(rng, 30))}
    spine = {(r["recording_id"], r["frame"]): [fr.SILENCE] * 2 for r in fr.spine(list(sides.values()), 0.5).collect()}
    for k, df in enumerate(sides.values()):
        for r in fr.stab(df, 0.5).collect():
            spine[r["recording_id"], r["frame"]][k] = r["name"]
    got = {}
    for r in fr.pieces(sides, 0.5, width=8).collect():
        for f in range(r["first"], r["first"] + r["n"]):
            assert got.setdefault((r["recording_id"], f), [r["t"], r["p"]]) is not None
    assert got == spine


def test_majority_of_spans_over_buckets(spark):
    rng = random.Random(4)
    frames = {(rng.randrange(2), rng.choice("abc"), rng.randint(0, 200)) for _ in range(400)}
    spans_ = [(rng.randrange(2), i, a, a + rng.randint(0, 90)) for i, a in enumerate(rng.randint(0, 200) for _ in range(60))]
    want = {}
    for rec, i, first, last in spans_:
        votes = {}
        for r, name, f in frames:
            if r == rec and first <= f < max(first + 1, last):
                votes[name] = votes.get(name, 0) + 1
        if votes:
            want[i] = min(votes, key=lambda x: (-votes[x], x)), max(votes.values())
    got = fr.majority(spark.createDataFrame(sorted(frames), "recording_id long, name string, frame long"), spark.createDataFrame(spans_, "recording_id long, span_id long, first long, last long"), ["recording_id"], 16)
    assert {r["span_id"]: (r["name"], r["n"]) for r in got.collect()} == want
