"""Base statistics and Viterbi against brute force, and accuracy on held-out labels."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import quality_rules as q
from quillon.llm import spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    three = Counter(zip(w, w[1:], w[2:]))
    again = [False] * len(w)
    for k, x in enumerate(zip(w, w[1:], w[2:])):
        if three[x] > 1:
            again[k : k + 3] = [True] * 3
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(again)


def texts():
    r = random.Random(8)
    bits = ["a", "b", "é€", "#x", "\x85", "\u3000", "<>", "one", "two"]
    out = ["".join(r.choice(bits) + r.choice([" ", "\n", "\t", "  ", "\n\n", "\x0b", ""]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    return out + [None, "", "\n", " \n x", "a\na\na", "w " * 200000, "x" * 500000]


def test_statistics_against_brute_force(spark):
    rows = [(k, t, "k") for k, t in enumerate(texts())] + [(0, texts()[0], "k"), (None, "a b c a b c", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(4)
    field = q.Field(((0.0,) * len(q.FEATURES),), ((0.0, 0.0), (0.0, 0.0)))
    out = q.score(docs, field)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = Counter()
    for i, t, _ in rows:
        b = brute(t)
        want[(i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == want
    assert q.score(docs.limit(0), field).count() == 0
    assert q.quality_filter(docs, field).columns == docs.columns


def test_viterbi_against_all_labellings():
    r = np.random.default_rng(2)
    for k in range(40):
        kinds = 2 + k % 2
        doc = np.repeat(np.arange(5), r.integers(1, 6, 5))
        x = r.normal(size=(len(doc), 3))
        f = q.Field(tuple(map(tuple, r.normal(size=(kinds - 1, 3)))), tuple(map(tuple, r.normal(size=(kinds, kinds)))))
        got = q.viterbi(f, x, doc)
        s, m = f.scores(x), np.array(f.moves)
        for d in range(5):
            at = np.flatnonzero(doc == d)
            best = max(itertools.product(range(kinds), repeat=len(at)), key=lambda y: sum(s[a, b] for a, b in zip(at, y, strict=True)) + sum(m[b, c] for b, c in zip(y, y[1:])))
            assert tuple(got[at]) == best


def labelled():
    con = duckdb.connect()
    rows = con.execute("SELECT text, quality FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE length(text) <= 50000 ORDER BY hash(doc_id)").fetchall()
    return rows[:1800], rows[1800:3600]


def measured(rows, stock=None):
    raw, offsets = spans.flat(pa.array([t for t, _ in rows], pa.string()))
    return q.measure(raw, offsets, stock), np.array([y for _, y in rows])


def test_the_chain_is_better_than_lines_alone_on_held_out_documents():
    train, test = labelled()
    m, y = measured(train)
    field = q.fit_lines(m.features, m.line_doc, m.line_hash, y[m.line_doc])
    stock = np.array(field.stock, dtype=np.uint64)
    m, y = measured(train, stock)
    labels = np.where(q.is_stock(m.line_hash, stock), q.STOCK, y[m.line_doc])
    alone = q.fit(m.features, np.arange(len(labels)), labels)  # each line a chain of its own
    # what a held-out line is comes from the held-out documents alone
    t, y = measured(test, stock)
    truth = (y[t.line_doc] == 1) & ~q.is_stock(t.line_hash, q.stock_lines(t.line_hash, t.line_doc))
    failed = (t.n_words < q.MIN_WORDS) | (100 * t.n_repeat_words > q.MAX_REPEATED * t.n_words)

    def scores(content):
        share = np.bincount(t.line_doc, weights=t.line_words * content, minlength=len(y)) / np.maximum(t.n_words, 1)
        kept = ~failed & (share >= q.MIN_CONTENT)
        return (content == truth).mean(), (kept == (y == 1)).mean(), kept[(y == 1) & ~failed].mean(), kept[y == 0].mean()

    lines, verdict, good, bad = scores(q.viterbi(field, t.features, t.line_doc) == q.CONTENT)
    lines_alone, verdict_alone, _, bad_alone = scores(alone.scores(t.features).argmax(axis=1) == q.CONTENT)
    assert lines > lines_alone + 0.005 and verdict > verdict_alone and bad < bad_alone
    assert good > 0.995 and bad < 0.03


def test_the_sample_is_bounded(spark):
    """Texts as long as the sample allows: the driver gets numbers of a bounded number of lines, whatever their size."""
    rows = spark.range(2000).selectExpr("id AS doc_id", "repeat(concat('some words of line ', id, chr(10)), 2000) AS text")
    labels = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    table = q.sample_lines(rows, labels, q.TRAIN_DOCS, q.TRAIN_CHARS, q.TRAIN_LINES).toArrow()
    assert table.num_rows == q.TRAIN_LINES and table.nbytes < 20e6
    assert q.train(rows, labels, train_lines=3000).weights


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None)]])
def test_without_both_kinds_all_lines_are_content(spark, labels):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)))], "doc_id long, text string")
    field = q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert q.score(docs, field).first().kept
