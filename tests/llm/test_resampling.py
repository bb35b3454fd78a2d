"""Resampling against brute force word by word, the tournament against sorting, crcs against zlib."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import resampling as op
from quillon.llm import spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def feats(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:]))]]  # noqa: B905


def brute(docs, target, percent=25, min_words=20):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in feats(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    rows = []
    for d, x in docs:
        n, f = feats(x)
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    draw = percent * len(able) // 100
    return sorted([(*r[:4], k + 1 if k < draw else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < min_words], key=str)


def some_docs(n, seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "γάμμα", "x" * 70, "y" * 64, "z" * 65, "7", "naïve", "日本", "the", "of"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", ", ", "\x00", "-", "_"]) for _ in range(rng.randint(0, 60)))
    return [(k, text()) for k in range(n)], [text() for _ in range(20)]


def test_against_brute_force(spark):
    docs, target = some_docs(700, 1)
    docs += [(5, docs[5][1]), (5, docs[5][1]), (6, "other words " * 30), (None, docs[0][1]), (None, None), (9000, None), (9001, ""), (9002, "-- ++"), (9003, "one"), (9004, "a long word " * 30_000)]
    frame = spark.createDataFrame([(d, t, 1, "a") for d, t in docs], "doc_id long, text string, score int, rank string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = op.ranked(op.importance(frame, goal))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)
    single = frame.filter("doc_id > 6")
    drawn = op.resample(single, goal)
    assert drawn.columns == frame.columns
    assert {r["doc_id"] for r in drawn.collect()} == {r[0] for r in brute([d for d in docs if (d[0] or 0) > 6], target) if r[4]}


@pytest.mark.parametrize("percent", [0, 1, 100])
def test_draw_counts(spark, percent):
    docs, target = some_docs(150, 2)
    frame, goal = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted(map(tuple, op.ranked(op.importance(frame, goal), percent, 3).collect()), key=str) == brute(docs, target, percent, 3)


def test_one_score_holds_all(spark):
    """Repeated rows tie in everything; the draw still has its exact count and ranks."""
    frame = spark.createDataFrame([(1, "same words here " * 10)] * 5000, "doc_id long, text string").repartition(6)
    got = op.ranked(op.importance(frame, frame.limit(1))).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1251)) and len(got) == 5000


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a few words here " * 10)], "doc_id long, text string")
    assert op.ranked(op.importance(frame.limit(0), frame)).count() == 0
    assert sorted(map(tuple, op.ranked(op.importance(frame, frame.limit(0)), 100).collect())) == brute([(1, "a few words here " * 10)], [], 100)


def test_crcs():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab7é日 .") for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["", "q" * 5000 + " r " + "s" * 66]
    raw, offsets = spans.flat(pa.array(texts))
    bucket, doc, words = op.features(raw, offsets)
    for k, text in enumerate(texts):
        n, want = feats(text)
        assert words[k] == n and sorted(bucket[doc == k].tolist()) == sorted(want)


def test_tournament_merges_runs_that_come_and_go():
    rng = np.random.default_rng(6)
    for runs in (1, 2, 5, 40):
        rows = [(0, int(s), True, int(d), 0, 0) for s, d in rng.integers(0, 50, (600, 2))]
        of_run = [sorted(rows[k::runs]) for k in range(runs)]
        blocks = sorted((run[a : a + 7][0], k, a, run[a : a + 7]) for k, run in enumerate(of_run) for a in range(0, len(run), 7))
        tree, out = op.Tournament(), []
        for head, _, _, block in blocks:
            out += tree.upto(head)
            tree.add(block)
        out += tree.upto(op.LAST)
        assert out == sorted(rows)
        assert len(tree.heads) < 2 * runs + 2  # never two blocks of a run
