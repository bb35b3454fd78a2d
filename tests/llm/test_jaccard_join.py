"""Near duplicates against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import jaccard_join as j

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, n, group):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(5))
    out = []

    def near(w, edits):
        w = list(w)
        for _ in range(edits):
            w[r.randrange(len(w))] = word()
        return w

    base = [word() for _ in range(120)]
    for _ in range(group):
        out.append(near(base, r.randint(0, 4)))
    for _ in range(n):
        w = [word() for _ in range(r.randint(0, 90))]
        out.append(w)
        if len(w) > 10:
            for _ in range(r.randint(0, 3)):
                out.append(near(r.choice(out[-3:]), r.randint(0, 3)))
    r.shuffle(out)
    rows = [(k, " ".join(w)) for k, w in enumerate(out)]
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "a  b"), rows[0], (None, rows[1][1]), (None, "own words of nobody else here")]


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = {}
    for k, s in enumerate(sets):
        if s is not None:
            if s in distinct:
                root[find(k)] = find(distinct[s])
            else:
                distinct[s] = k
    degree = Counter()
    keys = list(distinct)
    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if len(x & y) >= 0.8 * len(x | y):
                degree[x] += 1
                degree[y] += 1
                root[find(distinct[x])] = find(distinct[y])
    big = 1 << 63
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), big), big if i is None else i)
    copies = Counter(sets)
    return Counter((i, None if least[find(k)] == big else least[find(k)], 1 if s is None else copies[s], degree[s] if s else 0) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("seed,n,group,block", [(1, 60, 10, 1024), (2, 40, 90, 16)])
def test_against_all_pairs(spark, seed, n, group, block):
    rows = texts(seed, n, group)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, n int").repartition(5)
    got = j.near_duplicates(docs, block=block).select("doc_id", "class_id", "n_copies", "n_links")
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_one_document_of_each_class_stays(spark):
    rows = texts(3, 30, 12)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    kept = j.distinct_documents(docs)
    assert kept.columns == docs.columns
    classes = {}
    for (i, c, *_), _ in brute(rows).items():
        classes.setdefault(c, set()).add(i)
    want = sorted(str(c) for c in classes if c is not None)
    assert sorted(str(r.doc_id) for r in kept.collect() if r.doc_id is not None) == want
    assert j.distinct_documents(docs.limit(0)).count() == 0


def test_documents_of_one_id(spark):
    """Two texts of one id and one class: one stays; two classes with one smallest id: one of each stays."""
    words = [f"w{k}" for k in range(60)]
    near, other = [*words[:59], "x"], [f"v{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join(near)), (1, " ".join(other)), (2, " ".join(other)), (3, ""), (4, None)]
    kept = j.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert len(got) == 4 and got[2:] == [(3, ""), (4, "")] and (1, " ".join(other)) in got


def test_depth_reaches_the_recall():
    d = j.depth_for(0.8)
    assert 1 - (1 - 0.8**d) ** j.TREES >= j.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** j.TREES


def test_prefixes_are_shortened_as_far_as_the_pairs_need(spark, monkeypatch):
    """Close copies are all found at great depth; pairs at the threshold make the tries go up to the least depth."""
    r = random.Random(4)
    depths = []
    real = j.likely_rows
    monkeypatch.setattr(j, "likely_rows", lambda trie, depth, *a: depths.append(depth) or real(trie, depth, *a))
    close, far = [], []
    for k in range(300):
        w = [f"{k}.{i}" for i in range(400)]
        close += [" ".join(w), " ".join([*w[:399], "y"])]
        far += [" ".join(w), " ".join([*w[:358], *(f"z{i}" for i in range(42))])]
    for texts_, last, links in ((close, 5, 600), (far, 4, 600)):
        depths.clear()
        docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
        out = j.near_duplicates(docs, recall=0.99999).collect()
        assert depths == list(range(8, depths[-1] - 1, -1)) and depths[-1] >= last
        assert depths[-1] == 4 or links == sum(x.n_links for x in out)
        assert sum(x.n_links for x in out) == links
    assert depths[-1] == 4
    assert j.expected_recall(np.bincount([190] * 5000, minlength=193), 8, 0.8, 24) > 0.99999 > j.expected_recall(np.bincount([160] * 5000, minlength=193), 8, 0.8, 24)
