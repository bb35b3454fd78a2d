"""Removal of repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import fingerprint_index, suffix_dedup
from quillon.llm.lyndon import RangeMinimum, common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, anchor int"  # clashing names are ignored


def texts(seed: int, n: int) -> list[tuple]:
    """Random prose with copies, near copies, shared passages, periodic and very long texts, nulls and repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    prose = lambda k: [word() for _ in range(k)]
    shared = [prose(r.randint(20, 120)) for _ in range(4)]
    out = []
    for k in range(n):
        w = prose(r.randint(0, 150))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        if out and r.random() < 0.2:
            w = (r.choice(out)[1] or "").split(" ")
            if r.random() < 0.7 and len(w) > 3:
                w[r.randrange(len(w))] = word()
        out.append((k, " ".join(w).replace(" ", r.choice([" ", "\n", "  "]), 1)))
    out += [(n, None), (n + 1, ""), (n + 2, "aaaa " * 90), (n + 3, "x" * 450), (n + 4, "x" * 199), (n + 5, " \x1c\x0b".join(prose(80)))]
    out += [out[0], out[1], (None, out[2][1]), (None, out[2][1])]
    return [(i, t, "z", 1) for i, t in out]


def brute_bytes(rows: list[tuple], width: int = 200) -> Counter:
    body = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + width] for _, b in body for k in range(len(b) - width + 1))
    out = Counter()
    for i, b in body:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


def brute_words(rows: list[tuple], width: int = 50) -> Counter:
    body = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    big = 1 << 63
    first = defaultdict(lambda: big)
    for i, w in body:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first[key], big if i is None else i)
    out = Counter()
    for i, w in body:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (big if i is None else i):
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.fixture
def saved(spark, tmp_path):
    def save(rows):
        spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/t/documents.parquet", mode="overwrite")
        return f"{tmp_path}/t"

    return save


def test_suffix_array_against_sorting():
    r = random.Random(1)
    for _ in range(800):
        text = [r.randint(0, r.choice([0, 1, 3])) for _ in range(r.randint(0, 30))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:]), text


def test_common_prefixes_and_minima():
    r = random.Random(2)
    for _ in range(300):
        text = [r.randint(0, r.choice([1, 3])) for _ in range(r.randint(1, 40))]
        order = suffix_array(text)
        got = common_prefixes(text, order, 0)
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :], text[order[k] :]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n] != 0:
                n += 1
            assert got[k] == n
        low = RangeMinimum(got)
        pairs = [sorted((r.randrange(len(got)), r.randrange(len(got)))) for _ in range(20)]
        a, b = np.array(pairs).T
        assert low(a, b).tolist() == [got[x : y + 1].min() for x, y in pairs]


def test_the_construction_is_linear():
    """The work for a sequence eight times as long is about eight times as much, on sequences that are hard for sorting."""
    import time

    def cost(text):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            suffix_array(text)
            best = min(best, time.perf_counter() - began)
        return best

    fibonacci = [[1], [0]]
    while len(fibonacci[-1]) < 60_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for make in (lambda n: [0] * n, lambda n: list(range(n, 0, -1)), lambda n: fibonacci[-1][:n], lambda n: [k % 7 for k in range(n)]):
        assert cost(make(40_000)) < 8 * 3 * max(cost(make(5_000)), 0.001)


def windows_by_brute_force(texts, width):
    seen = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        out += [k + width <= len(t) and seen[t[k : k + width]] > 1 for k in range(len(t))]
    return out


def odd_texts(r):
    base = bytes(r.choice(b"abc .") for _ in range(r.randint(0, 120)))
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(3)] + [b"", base, b"a" * r.randint(0, 50)]
    for _ in range(3):
        a = r.randint(0, len(base))
        texts.append(bytes(r.choice(b"xyz") for _ in range(r.randint(0, 9))) + base[a : a + r.randint(0, 60)] + bytes(r.choice(b"xyz") for _ in range(r.randint(0, 9))))
    return texts


def test_equal_windows_come_from_the_order_of_suffixes(monkeypatch):
    r = random.Random(9)
    for _ in range(400):
        texts, width = odd_texts(r), r.choice([1, 2, 5, 20])
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        got = suffix_dedup.equal_windows(raw, np.array([len(t) for t in texts]), width)
        assert got.tolist() == windows_by_brute_force(texts, width)
    # with suffixes out of order the result is wrong: nothing else decides it
    real, wrong = suffix_dedup.suffix_array, 0
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: real(text)[::2] + real(text)[1::2])
    for _ in range(100):
        texts = odd_texts(r)
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        wrong += suffix_dedup.equal_windows(raw, np.array([len(t) for t in texts]), 20).tolist() != windows_by_brute_force(texts, 20)
    assert wrong > 10


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 120)])
def test_bytes_against_brute_force(spark, saved, seed, n):
    rows = texts(seed, n)
    got = suffix_dedup.op9_suffix_dedup(spark, saved(rows))
    assert Counter(map(tuple, got.collect())) == brute_bytes(rows)


def test_hot_anchors_are_counted_by_window(spark, saved):
    rows = texts(3, 80)
    docs = spark.read.parquet(f"{saved(rows)}/documents.parquet")
    got = suffix_dedup.remove_repeats(docs, hot=2).selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(removed) as long)", "sha2(kept, 256)")
    assert Counter(map(tuple, got.collect())) == brute_bytes(rows)


def test_long_texts_go_in_pieces(spark, saved, monkeypatch):
    rows = texts(4, 60)
    from quillon.llm import spans

    monkeypatch.setattr(spans, "PIECE", 700)
    docs = [t.encode() for _, t, *_ in rows if t]
    import numpy as np

    syms, lengths = np.frombuffer(b"".join(docs), dtype=np.uint8), np.array([len(d) for d in docs])
    covered = sorted((int(row), w) for rows_, r, shift in spans.found_regions(syms, lengths, 200, 48) for row, a, b in zip(rows_, r.first + shift, r.last + shift, strict=True) for w in range(a, b + 1))
    assert covered == [(k, w) for k, d in enumerate(docs) for w in range(len(d) - 199)]


@pytest.mark.parametrize("seed,n,batches", [(1, 60, 1), (2, 120, 3), (5, 90, 6)])
def test_words_against_brute_force(spark, saved, seed, n, batches):
    rows = texts(seed, n)
    docs = spark.read.parquet(f"{saved(rows)}/documents.parquet")
    got = fingerprint_index.remove_repeats(docs, batches=batches, fanout=2).selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256)")
    assert Counter(map(tuple, got.collect())) == brute_words(rows)


def test_runs_are_compacted_and_history_is_not_shuffled(spark, saved, monkeypatch):
    rows = texts(7, 120)
    docs = spark.read.parquet(f"{saved(rows)}/documents.parquet")
    levels, plans = [], []
    real = fingerprint_index.FingerprintIndex.append

    def append(self, name):
        if self.runs:
            semi = self.read(self.runs[0][1]).join(self.read(name).hint("merge"), "anchor", "left_semi")
            plans.append(semi._jdf.queryExecution().executedPlan().toString())
        real(self, name)
        levels.append(sorted(k for k, _ in self.runs))

    monkeypatch.setattr(fingerprint_index.FingerprintIndex, "append", append)
    got = fingerprint_index.remove_repeats(docs).selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256)")
    assert Counter(map(tuple, got.collect())) == brute_words(rows)
    assert levels == [[0], [0, 0], [1], [0, 1]]
    assert plans and all("SortMergeJoin" in x and "Exchange" not in x for x in plans)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("fingerprints_")]


def test_words_are_compared_and_not_only_hashes(spark, saved, monkeypatch):
    """Windows that only share a hash are no copies."""
    rows = texts(6, 60)
    docs = spark.read.parquet(f"{saved(rows)}/documents.parquet")
    real = fingerprint_index._windows
    monkeypatch.setattr(fingerprint_index, "_windows", lambda bodies, width: real(bodies, width).selectExpr("anchor", "region", "least", "at", "window % 2 AS window"))
    out = fingerprint_index.remove_repeats(docs).collect()
    want = {(i, n): k for i, n, k, _ in brute_words(rows)}
    assert all(r.n_removed <= want[(r.doc_id, r.n_words)] for r in out)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, "", "", 0)]])
def test_empty(spark, saved, rows):
    folder = saved(rows) if rows else None
    if folder is None:
        docs = spark.createDataFrame([], SCHEMA)
        assert suffix_dedup.remove_repeats(docs).count() == 0
        assert fingerprint_index.remove_repeats(docs).count() == 0
        return
    assert suffix_dedup.op9_suffix_dedup(spark, folder).count() == len(rows)
    assert fingerprint_index.op10_fingerprint_index(spark, folder).count() == len(rows)
