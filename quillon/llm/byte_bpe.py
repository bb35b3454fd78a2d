"""Operator 13: byte-level BPE encoding and decoding.

Encoding.  Ranks are compiled into a finite-state transducer over bytes.  A token sequence is what the merges make of its
bytes exactly if each pair of neighbours is what they make of the pair's bytes, so a state of the undetermined transducer is
(last token, bytes of the next one so far) and a token ends only where it may stand after the last one.  Subsets of such
states, each with the tokens that are not common to all, are the states of the determinised transducer.  They and their moves
are made when a text first needs them and kept (up to a bound, then all are dropped and made again).  A token is emitted as
soon as all states of the subset agree on it, which is at most one longest token later.  A text is first cut by the vocabulary's
pattern, and each match is a word of the transducer; the outputs of short words are kept as well.

Decoding.  The bytes of tokens go through a state machine of UTF-8 that reads a token at a time: the states that each token
leads to are tabulated once.  Whole characters are given out, the bytes of an unfinished one wait for the next tokens.

Documents are neither shuffled nor collected; a task holds one batch of texts.  The vocabulary travels with the job.

Defined results: a null text is empty and has no tokens; null ids are no tokens; repeated rows and all other columns are
kept, and the new column gets underscores after its name if the input has one of this name; an empty table gives no rows.
Ids that are no bytes of UTF-8 decode to U+FFFD for each part that cannot be read, as Python's ``replace`` does.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import spans
from quillon.plans.shared import small_batches, unused

#: moves and words that a worker keeps
KEPT_MOVES = 1 << 19
KEPT_WORDS = 1 << 18
#: longest word whose tokens are kept, in characters
KEPT_CHARS = 48
#: texts above this many characters are cut into words one at a time
LONG_TEXT = 1 << 18


def read_ranks(rank_file: str) -> dict[bytes, int]:
    """Token bytes and their ranks from the text of a rank file: lines of base64, space, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}


#: rank of what is no token
NEVER = 1 << 40
#: merges of a token by themselves, in order: rank of each, and the outermost parts on the left and right before it and at the end
Merges = tuple[list[int], list[bytes], list[bytes]]


def merges(token: bytes, ranks: dict[bytes, int]) -> Merges:
    """Of all neighbours those with the lowest joint rank are joined, the first such pair first, until none is left."""
    parts = [token[k : k + 1] for k in range(len(token))]
    order, left, right = [], parts[:1], parts[-1:]
    while len(parts) > 1:
        joint = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]  # noqa: B905  neighbours
        best = min(joint)
        if best == NEVER:
            break
        k = joint.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        order.append(best)
        left.append(parts[0])
        right.append(parts[-1])
    return [*order, NEVER], left, right


def stay_apart(a: Merges, b: Merges, ranks: dict[bytes, int]) -> bool:
    """Whether two tokens side by side merge as each does alone: no pair across the border is ever the next one to join."""
    (ranks_a, _, right), (ranks_b, left, _) = a, b
    i = j = 0
    while True:
        across = ranks.get(right[i] + left[j], NEVER)
        if across < ranks_a[i] and across <= ranks_b[j]:
            return False
        if ranks_a[i] <= ranks_b[j]:
            if ranks_a[i] == NEVER:
                return True
            i += 1
        else:
            j += 1


class Trie:
    """Token bytes as a trie: nodes are numbers, 0 is the root; ``child[node << 8 | byte]`` is the next node."""

    def __init__(self, ranks: dict[bytes, int]):
        self.child: dict[int, int] = {}
        self.token: list[int | None] = [None]
        #: the tokens that go on from a node are ordered[below[node][0] : below[node][1]]
        self.below = [(0, 0)]
        self.ordered: list[int] = []
        path = [0]
        before = b""
        for token in sorted(ranks):
            same = 0
            while same < len(before) and same < len(token) and before[same] == token[same]:
                same += 1
            for node in path[same + 1 :]:
                self.below[node] = (self.below[node][0], len(self.ordered))
            del path[same + 1 :]
            for byte in token[same:]:
                node = len(self.token)
                self.child[path[-1] << 8 | byte] = node
                self.token.append(None)
                self.below.append((len(self.ordered), 0))
                path.append(node)
            self.token[path[-1]] = ranks[token]
            self.ordered.append(ranks[token])
            self.below[path[-1]] = (len(self.ordered), 0)
            before = token
        for node in path:
            self.below[node] = (self.below[node][0], len(self.ordered))


class Transducer:
    """The lazily determinised transducer of one vocabulary.

    A determinised state is (last token that all branches agree on, branches); a branch is (node of the token under way, tokens
    between the agreed one and it).  Branches are in order of the bytes under way, of which no two have as many.
    """

    #: tokens that may end a branch are tried one by one up to so many; more are taken to hold one that fits
    TRIED = 64

    def __init__(self, ranks: dict[bytes, int], kept_moves: int = KEPT_MOVES):
        self.ranks, self.kept_moves = ranks, kept_moves
        self.spelling = {rank: token for token, rank in ranks.items()}
        self.trie = Trie(ranks)
        self.pairs: dict[int, bool] = {}
        self.open: dict[int, bool] = {}
        self.alone: dict[int, Merges] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all determinised states but the first."""
        first = (None, ((0, ()),))
        self.states, self.numbers = [first], {first: 0}
        #: for each state, the move for each byte: (state, tokens emitted)
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.made = 0

    def may_follow(self, left: int | None, right: int) -> bool:
        """Whether the merges leave these two tokens side by side."""
        if left is None:
            return True
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.kept_moves:
                self.pairs.clear()
            known = self.pairs[key] = stay_apart(self.merges_of(left), self.merges_of(right), self.ranks)
        return known

    def merges_of(self, token: int) -> Merges:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = merges(self.spelling[token], self.ranks)
        return known

    def may_end(self, left: int | None, node: int) -> bool:
        """Whether some longer token through this node may follow; a branch of which none may is dropped."""
        low, high = self.trie.below[node]
        if left is None or high - low > self.TRIED:
            return high > low
        key = left << 32 | node
        known = self.open.get(key)
        if known is None:
            if len(self.open) >= self.kept_moves:
                self.open.clear()
            known = self.open[key] = any(self.may_follow(left, t) for t in self.trie.ordered[low:high])
        return known

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one move."""
        agreed, branches = self.states[state]
        child, tokens = self.trie.child, self.trie.token
        after, ended = [], None
        for node, pending in branches:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            last, token = pending[-1] if pending else agreed, tokens[node]
            # of all tokens that end here exactly one may follow the token before it
            if token is not None and ended is None and self.may_follow(last, token):
                ended = (*pending, token)
            if self.may_end(last, node):
                after.append((node, pending))
        if ended is None:
            raise ValueError(f"no token ends with byte {byte}: the ranks lack a single byte or are no merges")
        after.append((0, ended))
        # what all branches agree on goes out
        common = 0
        while all(len(pending) > common and pending[common] == ended[common] for _, pending in after):
            common += 1
        emitted = ended[:common]
        if common:
            agreed, after = emitted[-1], [(node, pending[common:]) for node, pending in after]
        # the agreed token tells states apart only where it is some branch's last one
        target = (agreed if any(not pending for _, pending in after) else None, tuple(after))
        number = self.numbers.get(target)
        if number is None:
            number = self.add(target)
        self.moves[state][byte] = move = number, emitted
        self.made += 1
        return move

    def add(self, target: tuple) -> int:
        number = self.numbers[target] = len(self.states)
        self.states.append(target)
        self.moves.append({})
        return number

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one match of the pattern, emitted on the way; the rest at its end."""
        if self.made >= self.kept_moves:
            self.clear()
        moves, state, out = self.moves, 0, []
        for byte in word:
            found = moves[state].get(byte)
            if found is None:
                if self.made >= 2 * self.kept_moves:  # a very long word must not outgrow the bound: on from the same state
                    here = self.states[state]
                    self.clear()
                    moves = self.moves
                    state = self.numbers[here] if here in self.numbers else self.add(here)
                found = self.move(state, byte)
            state, emitted = found
            if emitted:
                out += emitted
        # the last branch is the one whose token has just ended
        out += self.states[state][1][-1][1]
        return out


class Words(dict):
    """Tokens of words; those of short words are kept."""

    def __init__(self, transducer: Transducer, kept_words: int = KEPT_WORDS):
        super().__init__()
        self.transducer, self.kept_words = transducer, kept_words

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.transducer.encode(word.encode()))
        if len(word) <= KEPT_CHARS:
            if len(self) >= self.kept_words:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids, for one worker process."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        self.cut = regex.compile(pattern)
        self.words = Words(Transducer(read_ranks(rank_file)))

    def encode(self, text: str) -> np.ndarray:
        found: Iterable[str] = self.cut.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in self.cut.finditer(text))
        return np.fromiter(chain.from_iterable(map(self.words.__getitem__, found)), dtype=np.uint32)


#: states of the UTF-8 machine: between characters, 1 to 3 bytes to come, four lead bytes with a narrower next byte, error
START, ONE, TWO, THREE, E0, ED, F0, F4, BAD = range(9)


def utf8_table() -> np.ndarray:
    """(state, byte) -> state, for well-formed UTF-8 (no surrogates, no overlong forms, nothing beyond U+10FFFF)."""
    table = np.full((9, 256), BAD, dtype=np.uint8)
    table[START, :0x80] = START
    table[START, 0xC2:0xE0] = ONE
    table[START, 0xE0:0xF0] = TWO
    table[START, 0xF0:0xF5] = THREE
    table[START, [0xE0, 0xED, 0xF0, 0xF4]] = [E0, ED, F0, F4]
    for state, low, high, to in [(ONE, 0x80, 0xC0, START), (TWO, 0x80, 0xC0, ONE), (THREE, 0x80, 0xC0, TWO), (E0, 0xA0, 0xC0, ONE), (ED, 0x80, 0xA0, ONE), (F0, 0x90, 0xC0, TWO), (F4, 0x80, 0x90, TWO)]:
        table[state, low:high] = to
    return table


class Decoder:
    """Tokens of one vocabulary as arrays, and the UTF-8 states that each leads to."""

    def __init__(self, rank_file: str):
        ranks = read_ranks(rank_file)
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        table, states = utf8_table(), np.tile(np.arange(9, dtype=np.uint8), (size, 1))
        for k in range(int(self.lengths.max(initial=0))):
            on = np.flatnonzero(self.lengths > k)
            states[on] = table[states[on], self.bytes[self.starts[on] + k][:, None]]
        self.table, self.to = table, states  # (token, state before) -> state after

    def spell(self, ids: np.ndarray) -> bytes:
        """Bytes of tokens, end to end."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return self.bytes[at].tobytes()

    def stream(self) -> Stream:
        return Stream(self)


class Stream:
    """Tokens in, whole characters out."""

    def __init__(self, decoder: Decoder):
        self.decoder, self.state, self.waiting = decoder, START, b""

    def feed(self, ids: np.ndarray) -> str:
        """The text that is whole after these tokens."""
        d = self.decoder
        if not len(ids):
            return ""
        raw = self.waiting + d.spell(ids)
        # tokens that are whole characters leave the machine between characters: only stretches of others are stepped through
        odd = np.append(np.flatnonzero(d.to[ids, START] != START), len(ids))
        state, k = self.state, 0
        while k < len(ids):
            if state == START:
                k = int(odd[np.searchsorted(odd, k)])
                if k == len(ids):
                    break
            state = int(d.to[ids[k], state])
            k += 1
            if state == BAD:
                return self._replacing(raw)
        # an unfinished character has at most three bytes, the first of which leads
        waits = 0 if state == START else next(n for n in range(1, 4) if raw[-n] & 0xC0 != 0x80)
        self.state, self.waiting = state, raw[len(raw) - waits :]
        return raw[: len(raw) - waits].decode()

    def _replacing(self, raw: bytes) -> str:
        """Bytes that are no UTF-8: parts that cannot be read are replaced."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        text = reader.decode(raw)
        self.waiting, self.state = reader.getstate()[0], START
        for byte in self.waiting:
            self.state = int(self.decoder.table[self.state, byte])
        return text

    def finish(self) -> str:
        """What is left: an unfinished character is replaced."""
        text = self.waiting.decode("utf-8", "replace")
        self.state, self.waiting = START, b""
        return text


@functools.lru_cache(maxsize=2)
def encoder_of(rank_file: str, pattern: str) -> Encoder:
    """One encoder for a worker process: its moves and words serve all tasks."""
    return Encoder(rank_file, pattern)


@functools.lru_cache(maxsize=2)
def decoder_of(rank_file: str) -> Decoder:
    return Decoder(rank_file)


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, dtype=np.int32)))


def _encoding(shipped, pattern: str, text_at: int, ids_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with a last column of ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value, pattern)
        for batch in spans.slices(batches, text_at):
            ids = [encoder.encode(text or "") for text in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, id_lists(ids)], names=[*batch.schema.names, ids_col])

    return encode


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text in a last column."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(Path(rank_path).read_text(encoding="ascii"))
    ids_col = unused(docs.columns, ids_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encoding(shipped, pattern, docs.columns.index(text_col), ids_col), schema)


def decode(docs: DataFrame, rank_path: str, ids_col: str = "token_ids", text_col: str = "decoded", chunk: int = 1 << 16) -> DataFrame:
    """``docs`` with the text of each list of ids in a last column, streamed ``chunk`` ids at a time."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(Path(rank_path).read_text(encoding="ascii"))
    at, text_col = docs.columns.index(ids_col), unused(docs.columns, text_col)
    clean = docs.withColumn(ids_col, F.filter(F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")), lambda x: x.isNotNull()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of(shipped.value)
        for batch in batches:
            texts = ["".join(pieces(decoder, ids, chunk)) for ids in lists_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    schema = T.StructType([*clean.schema.fields, T.StructField(text_col, T.StringType())])
    return clean.mapInArrow(read, schema)


def lists_of(column: pa.Array) -> list[np.ndarray]:
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def pieces(decoder: Decoder, ids: np.ndarray, chunk: int = 1 << 16) -> Iterator[str]:
    """The text of ids, a piece for each chunk of them."""
    stream = decoder.stream()
    for k in range(0, len(ids), chunk):
        yield stream.feed(ids[k : k + chunk])
    yield stream.finish()


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip) of (doc_id, text): encoded and decoded again in one pass."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(Path(rank_path).read_text(encoding="ascii"))
    encoded = _encoding(shipped, pattern, 1, "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of(shipped.value)
        for batch in encoded(batches):
            counts, of_ids, of_text = [], [], []
            for ids in lists_of(batch.column("ids")):
                back = hashlib.sha256()
                for text in pieces(decoder, ids):
                    back.update(text.encode())
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
