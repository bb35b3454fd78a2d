"""Operator 8: quality rules from base statistics and line labels of a linear-chain conditional random field.

Base statistics of the whole text come first; a text that fails them is not kept.  Otherwise each line with words is
labelled content or boilerplate by Viterbi decoding, and the document is kept if enough of its words are in content lines.

The field is fitted on lines of at most ``train_docs`` labelled documents (the smallest by a hash of their id).  Their
lines are measured in the executors and labelled one by one: stock are the lines which the sample has after ``contexts``
different lines or more (a copied document repeats its lines in one context only), junk are the other lines of rejected
documents, content those of accepted ones.  Junk and stock are both boilerplate; they are two labels as a stock line says
little about its neighbours.  The driver gets the numbers of at most ``train_lines`` lines and
climbs the penalized likelihood.  The field is a few dozen weights and the hashes of the stock lines; scoring is one pass
over the documents without a shuffle.

Defined results: a null text has no words; a text without words fails the base rules; a document appears as often as its
row is repeated; without labelled lines of both kinds all lines count as content; an empty table gives no rows; other
columns are ignored (``quality_filter`` keeps them all, whatever their names).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import spans, winnow
from quillon.plans.shared import small_batches

#: bound of the labelled sample
TRAIN_DOCS = 2000
#: longest text in it
TRAIN_CHARS = 50_000
#: lines of it that come to the driver, about 120 bytes each
TRAIN_LINES = 60_000
#: different lines before a line from which it is a stock line
CONTEXTS = 3
MIN_WORDS = 50
#: percent of words in repeated 3-word windows that a text may have
MAX_REPEATED = 50
#: share of words in content lines from which a document is kept
MIN_CONTENT = 0.5
STEPS = 300
PENALTY = 1e-3
#: bytes of texts worked on at a time
SLICE = 1 << 20

FEATURES = ("bias", "log_words", "symbols", "upper", "digits", "stops", "exclaim", "word_length", "ends_sentence", "repeated_words", "repeated_line", "one_word", "stock_line")


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[np.frombuffer(characters, dtype=np.uint8)] = 1
    return table


SYMBOLS = _class(b"#*$%&|<>")
UPPER = _class(bytes(range(65, 91)))
DIGITS = _class(bytes(range(48, 58)))
STOPS = _class(b".,;:?")
EXCLAIM = _class(b"!")
LEADS = (np.arange(256) & 0xC0 != 0x80).astype(np.uint8)  # one for each code point


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sums over [start, stop) for sorted disjoint spans."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    padded = np.append(values, values.dtype.type(0))
    both = np.stack([starts, stops], axis=1).ravel()
    return np.where(starts < stops, np.add.reduceat(padded, both, dtype=np.int64)[::2], 0)


@dataclass
class Measured:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_doc: np.ndarray  # of each line with words
    line_words: np.ndarray
    line_hash: np.ndarray  # of the line's bytes
    features: np.ndarray  # (lines, FEATURES)


def measure(raw: np.ndarray, offsets: np.ndarray, stock: np.ndarray | None = None) -> Measured:
    """Base statistics of texts laid end to end, and features of their lines with words; stock: sorted hashes of stock lines."""
    n = len(offsets) - 1
    starts, stops, counts = spans.word_bounds(raw, offsets)
    doc = np.repeat(np.arange(n), counts)
    leads = LEADS[raw]
    chars = _sums(leads, starts, stops)
    symbols = SYMBOLS[raw]
    hashes = spans.word_symbols(raw, starts, stops)
    # words in 3-word windows that the text has twice or more
    repeated = np.zeros(len(starts), dtype=bool)
    if len(starts) >= 3:
        with np.errstate(over="ignore"):
            three = winnow.finalize(hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + winnow.finalize(hashes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + winnow.finalize(hashes[2:] + np.uint64(1)))
            three = winnow.finalize(three + doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = np.flatnonzero(doc[:-2] == doc[2:])
        by = at[np.argsort(three[at], kind="stable")]
        same = three[by[1:]] == three[by[:-1]]
        hit = np.concatenate([by[1:][same], by[:-1][same]])
        for k in range(3):
            repeated[hit + k] = True
    # lines with words: cut at \n and at document ends
    breaks = np.flatnonzero(raw == 10)
    inner = offsets[1:-1]
    line_starts = np.unique(np.concatenate([offsets[:1], breaks + 1, inner]))
    line_starts = line_starts[line_starts < len(raw)]
    line_stops = np.append(line_starts[1:], len(raw))
    line_stops = line_stops - ((line_stops > line_starts) & (raw[np.maximum(line_stops - 1, 0)] == 10) if len(raw) else 0)
    first_word = np.searchsorted(starts, line_starts)
    last_word = np.searchsorted(starts, line_stops)
    own = last_word > first_word
    line_starts, line_stops, first_word, last_word = line_starts[own], line_stops[own], first_word[own], last_word[own]
    words = last_word - first_word
    line_doc = doc[first_word] if len(first_word) else np.zeros(0, dtype=np.int64)
    # lines equal to an earlier line of the text
    if len(line_starts):
        sums = winnow.prefix_sums(raw)
        line_hash = winnow.span_hash(sums, line_starts, line_stops)
        with np.errstate(over="ignore"):
            within = winnow.finalize(line_hash + line_doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        by = np.argsort(within, kind="stable")
        again = np.zeros(len(by), dtype=bool)
        again[by[1:]] = within[by[1:]] == within[by[:-1]]
    else:
        line_hash, again = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    length = np.maximum(_sums(leads, line_starts, line_stops), 1)
    line_chars = np.add.reduceat(np.append(chars, 0), np.stack([first_word, last_word], axis=1).ravel())[::2] if len(words) else np.zeros(0)
    line_repeated = np.add.reduceat(np.append(repeated, False).astype(np.int64), np.stack([first_word, last_word], axis=1).ravel())[::2] if len(words) else np.zeros(0)
    share = lambda table: _sums(table[raw], line_starts, line_stops) / length
    ends = np.isin(raw[stops[last_word - 1] - 1], list(b".?!:;")) if len(words) else np.zeros(0)
    features = np.stack(
        [np.ones(len(words)), np.log1p(words), 5 * share(SYMBOLS), 3 * share(UPPER), 5 * share(DIGITS), 5 * share(STOPS), 10 * share(EXCLAIM), line_chars / np.maximum(words, 1) / 10, ends, line_repeated / np.maximum(words, 1), again, words == 1, is_stock(line_hash, stock)],
        axis=1,
    ).astype(np.float64)
    per_doc = lambda values: np.bincount(line_doc, weights=values, minlength=n).astype(np.int64)
    return Measured(
        counts,
        np.bincount(doc, weights=chars, minlength=n).astype(np.int64),
        _sums(symbols, offsets[:-1], offsets[1:]),
        per_doc(again),
        np.bincount(doc, weights=repeated, minlength=n).astype(np.int64),
        line_doc,
        words,
        line_hash,
        features,
    )


def is_stock(line_hash: np.ndarray, stock: np.ndarray | None) -> np.ndarray:
    if stock is None or not len(stock):
        return np.zeros(len(line_hash), dtype=bool)
    at = np.minimum(np.searchsorted(stock, line_hash), len(stock) - 1)
    return stock[at] == line_hash


JUNK, CONTENT, STOCK = range(3)


@dataclass(frozen=True)
class Field:
    """Weights of each label but the first, which has none, log potentials of neighbouring labels, hashes of stock lines."""

    weights: tuple[tuple[float, ...], ...]
    moves: tuple[tuple[float, ...], ...]
    stock: tuple[int, ...] = ()

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.column_stack([np.zeros(len(features)), *(features @ np.array(w) for w in self.weights)])


def _steps(line_doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For t = 0, 1, ...: indexes of the t-th lines of all documents that have one, and of the lines before them."""
    if not len(line_doc):
        return []
    change = np.append(True, line_doc[1:] != line_doc[:-1])
    first = np.flatnonzero(change)
    sizes = np.diff(np.append(first, len(line_doc)))
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    left = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # documents longer than t
    return [(first[:k] + t, first[:k] + t - 1) for t, k in enumerate(left.tolist())]


def viterbi(field: Field, features: np.ndarray, line_doc: np.ndarray) -> np.ndarray:
    """The best labels of the lines of all documents at once."""
    best = field.scores(features)
    moves = np.array(field.moves)
    came = np.zeros(best.shape, dtype=np.int8)
    steps = _steps(line_doc)
    for here, before in steps[1:]:
        paths = best[before][:, :, None] + moves[None]
        came[here] = paths.argmax(axis=1)
        best[here] += paths.max(axis=1)
    labels = best.argmax(axis=1).astype(np.int8)  # right for last lines; the others are set on the way back
    for here, before in reversed(steps[1:]):
        labels[before] = came[here, labels[here]]
    return labels


def fit(features: np.ndarray, line_doc: np.ndarray, labels: np.ndarray, kinds: int = 3, steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Penalized maximum likelihood by gradient ascent (Adam), forward-backward over all documents at once."""
    n, f = features.shape
    if CONTENT not in labels or JUNK not in labels:
        # nothing to tell apart: all lines are content
        return Field(tuple((float(k == CONTENT), *[0.0] * (f - 1)) for k in range(1, kinds)), ((0.0,) * kinds,) * kinds)
    chain = _steps(line_doc)
    truth = np.eye(kinds)[labels]
    observed = sum((truth[before].T @ truth[here] for here, before in chain[1:]), np.zeros((kinds, kinds)))
    theta = np.zeros((f + kinds, kinds))  # weights, then moves
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        moves = theta[f:]
        score = features @ theta[:f]
        alpha, beta = score.copy(), np.zeros((n, kinds))
        for here, before in chain[1:]:
            alpha[here] += np.logaddexp.reduce(alpha[before][:, :, None] + moves[None], axis=1)
        for here, before in reversed(chain[1:]):
            beta[before] = np.logaddexp.reduce((score[here] + beta[here])[:, None, :] + moves[None], axis=2)
        logz = np.logaddexp.reduce(alpha + beta, axis=1)
        p = np.exp(alpha + beta - logz[:, None])
        expected = np.zeros((kinds, kinds))
        for here, before in chain[1:]:
            joint = np.exp(alpha[before][:, :, None] + moves[None] + (score[here] + beta[here])[:, None, :] - logz[here][:, None, None])
            expected += joint.sum(axis=0)
        grad = np.concatenate([features.T @ (truth - p), observed - expected]) / n - penalty * theta
        grad[:f, 0] = 0  # the first label has no weights
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return Field(tuple(map(tuple, theta[:f, 1:].T.tolist())), tuple(map(tuple, theta[f:].tolist())))


def sample_lines(documents: DataFrame, labels: DataFrame, train_docs: int, train_chars: int, train_lines: int) -> DataFrame:
    """(doc, at, quality, hash, f0, f1, ...): measured lines of the sample, in order; a document row is told apart by doc."""
    chosen = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    short = documents.select("doc_id", "text").filter(F.length("text") <= train_chars)
    rows = short.join(F.broadcast(chosen), "doc_id").select("quality", F.xxhash64("doc_id", "text").alias("doc"), "text").orderBy("doc", "text").limit(train_docs)
    names = ["doc", "at", "quality", "hash", *(f"f{k}" for k in range(len(FEATURES)))]

    def scan(batches):
        for batch in spans.slices(batches, "text"):
            raw, offsets = spans.flat(batch.column("text"))
            m = measure(raw, offsets)
            take = pa.array(m.line_doc)
            columns = [batch.column("doc").take(take), pa.array(np.arange(len(m.line_doc))), batch.column("quality").take(take).cast(pa.int32()), pa.array(m.line_hash.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(x)) for x in m.features.T], names=names)

    lines = rows.mapInArrow(scan, "doc long, at long, quality int, hash long, " + ", ".join(f"f{k} double" for k in range(len(FEATURES))))
    return lines.orderBy("doc", "at").limit(train_lines)


def train(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, train_lines: int = TRAIN_LINES, contexts: int = CONTEXTS) -> Field:
    """Fit on the lines of at most ``train_docs`` labelled documents of at most ``train_chars``, chosen by a hash of the id."""
    table = sample_lines(documents, labels, train_docs, train_chars, train_lines).toArrow()
    get = lambda name: np.asarray(table.column(name).combine_chunks())
    features = np.stack([get(f"f{k}") for k in range(len(FEATURES))], axis=1).reshape(-1, len(FEATURES))
    doc = get("doc")
    line_doc = np.cumsum(np.append(False, doc[1:] != doc[:-1])[: len(doc)])
    return fit_lines(features, line_doc, get("hash").view(np.uint64), get("quality"), contexts)


def fit_lines(features: np.ndarray, line_doc: np.ndarray, line_hash: np.ndarray, quality: np.ndarray, contexts: int = CONTEXTS) -> Field:
    """Derive the labels of the sample's lines and fit; quality: of each line's document."""
    stock = stock_lines(line_hash, line_doc, contexts)
    known = is_stock(line_hash, stock)
    labels = np.where(known, STOCK, np.where(quality == 1, CONTENT, JUNK))
    field = fit(np.column_stack([features[:, :-1], known]), line_doc, labels)
    return replace(field, stock=tuple(stock.tolist()))


def stock_lines(line_hash: np.ndarray, line_doc: np.ndarray, contexts: int = CONTEXTS) -> np.ndarray:
    """Sorted hashes of the lines that stand after ``contexts`` different lines, or the start of a document, or more."""
    before = np.zeros_like(line_hash)
    if len(line_doc):
        before[1:] = np.where(line_doc[1:] == line_doc[:-1], line_hash[:-1], np.uint64(0))
    pairs = np.unique(np.stack([line_hash, before], axis=1), axis=0)
    values, counts = np.unique(pairs[:, 0], return_counts=True)
    return values[counts >= contexts]


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = ", ".join(f"{c} long" for c in COLUMNS) + ", content_words long, base_failed boolean, kept boolean"


def verdicts(texts: pa.Array, field: Field, min_content: float = MIN_CONTENT) -> list[pa.Array]:
    """The columns of VERDICT for a column of texts."""
    raw, offsets = spans.flat(texts.fill_null(""))
    stock = np.array(field.stock, dtype=np.uint64)
    out: list[list[np.ndarray]] = [[] for _ in range(len(COLUMNS) + 3)]
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, side="right")) - 1)
        m = measure(raw[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k], stock)
        content = np.bincount(m.line_doc, weights=m.line_words * (viterbi(field, m.features, m.line_doc) == CONTENT), minlength=end - k).astype(np.int64)
        failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEATED * m.n_words)
        for column, value in zip(out, (*(getattr(m, c) for c in COLUMNS), content, failed, ~failed & (content >= min_content * m.n_words)), strict=True):
            column.append(value)
        k = end
    return [pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(out, [pa.int64()] * 6 + [pa.bool_()] * 2, strict=True)]


def score(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """(doc_id, VERDICT) for each document."""
    small_batches(documents.sparkSession)

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *verdicts(batch.column(1), field, min_content)], names=["doc_id", *COLUMNS, "content_words", "base_failed", "kept"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, f"doc_id {documents.schema[id_col].dataType.simpleString()}, {VERDICT}")


def quality_filter(documents: DataFrame, field: Field, text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """The documents that are kept, with all their columns."""
    at = documents.columns.index(text_col)
    small_batches(documents.sparkSession)

    def scan(batches):
        for batch in batches:
            yield batch.filter(verdicts(batch.column(at), field, min_content)[-1])

    return documents.mapInArrow(scan, documents.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
