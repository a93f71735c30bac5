"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding
--------
Two tokens are *compatible* when encoding their concatenation gives exactly
those two tokens back; a sequence is the BPE encoding of its bytes exactly when
all neighbours are compatible (and each token encodes to itself).  So the last
token of every prefix of a word is fixed by local tests, and the encoder can
run left to right as a finite-state transducer:

* a state is (last emitted token, bytes read since, last tokens of the pending
  prefixes);
* a boundary stays pending while the bytes after it are a proper prefix of some
  token, so the lookahead is bounded by the longest token;
* tokens common to the chains of all live boundaries are emitted at once.

Transitions are worked out when first met and kept by (state, byte); words of
the same shape then cost one dictionary lookup per byte.  The table is dropped
when it reaches ``max_states`` (memory stays bounded, results do not change).

A match of the pattern that is itself a vocabulary entry is that entry, as in
the rank files' usual encoders.

Decoding
--------
``Utf8Decoder`` takes ids one after the other and keeps the automaton state
between tokens, so a character that is split over tokens comes out when its
last byte arrives; ill-formed bytes become U+FFFD by maximal subparts.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import threading
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bulwark.llm.common import give_back, slices, small_batches


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64(token) rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Encodes one pattern match at a time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.max_states = max_states
        self.longest = max(map(len, ranks), default=1)
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self._alone: dict[bytes, bool] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self._states: list[tuple[int, bytes, tuple[int, ...]]] = []
        self._ids: dict[tuple[int, bytes, tuple[int, ...]], int] = {}
        self._step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._final: list[tuple[int, ...] | None] = []
        self._start = self._intern(-1, b"", ())

    def _intern(self, last: int, pending: bytes, tails: tuple[int, ...]) -> int:
        key = (last, pending, tails)
        at = self._ids.get(key)
        if at is None:
            at = self._ids[key] = len(self._states)
            self._states.append((last, pending, tails))
            self._final.append(None)
        return at

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by lowest rank; the definition, used on pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _self_encoding(self, token: bytes) -> bool:
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self.merge(token) == [self.ranks[token]]
        return known

    def _compatible(self, left: int, right: int) -> bool:
        known = self._pair.get((left, right))
        if known is None:
            if len(self._pair) > 2 * self.max_states:
                self._pair.clear()
            known = self._pair[left, right] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return known

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """tails[i]: last token of the encoding of pending[:i + 1], after the emitted ones."""
        last, pending, tails = self._states[state]
        pending = pending + bytes((byte,))
        n = len(pending)
        tail = -1
        for k in range(min(n, self.longest), 0, -1):
            t = pending[n - k :]
            r = self.ranks.get(t)
            if r is None or not self._self_encoding(t):
                continue
            before = tails[n - k - 1] if k < n else last
            if before == -1 or self._compatible(before, r):
                tail = r
                break
        if tail == -1:
            raise ValueError(f"byte {byte} has no token")
        tails = (*tails, tail)
        # chains of the live boundaries; the emitted part is what they share
        live = [n] + [j for j in range(n - 1, -1, -1) if pending[j:] in self.prefixes]
        chains = []
        for j in live:
            cuts, at = [], j
            while at > 0:
                cuts.append(at)
                at -= len(self.token[tails[at - 1]])
            chains.append(cuts[::-1])
        shared = 0
        for cuts in zip(*chains, strict=False):
            if len(set(cuts)) > 1:
                break
            shared = cuts[0]
        out: list[int] = []
        at = shared
        while at > 0:
            out.append(tails[at - 1])
            at -= len(self.token[tails[at - 1]])
        out.reverse()
        if shared:
            last = out[-1]
        # the last emitted token only matters to tokens that start right after it
        return self._intern(last if live[-1] <= shared else -2, pending[shared:], tails[shared:]), tuple(out)

    def _finish(self, state: int) -> tuple[int, ...]:
        _, pending, tails = self._states[state]
        out, at = [], len(pending)
        while at > 0:
            out.append(tails[at - 1])
            at -= len(self.token[tails[at - 1]])
        return tuple(reversed(out))

    def encode(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self._states) > self.max_states:
            self._reset()
        out: list[int] = []
        state, step = self._start, self._step
        for byte in word:
            move = step.get(state << 8 | byte)
            if move is None:
                if len(self._states) > 2 * self.max_states:  # within one very long match
                    key = self._states[state]
                    self._reset()
                    step, state = self._step, self._intern(*key)
                move = step[state << 8 | byte] = self._advance(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        rest = self._final[state]
        if rest is None:
            rest = self._final[state] = self._finish(state)
        out += rest
        return out


class ByteBPE:
    """Encoder of whole texts; words met lately are kept, between ``max_words`` and twice as many."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_words: int = 400_000):
        self.fst = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.max_words = max_words
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        size = max(self.fst.token, default=-1) + 1
        self.token = [self.fst.token.get(i, b"") for i in range(size)]
        self.decimal = [str(i) for i in range(size)]
        #: What each token does in each state of the decoder; few states but the empty one are met with many tokens.
        self.decoding: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.alone = Alone(self.token)

    def words(self, text: str) -> list[tuple[int, ...]]:
        """Ids of each match of the pattern."""
        known = self._known
        matches = self.split(text)
        out = list(map(known.get, matches))
        if None in out:
            encode, older = self.fst.encode, self._older
            for i, found in enumerate(out):
                if found is None:
                    word = matches[i]
                    found = known.get(word) or older.get(word)
                    if found is None:
                        found = tuple(encode(word.encode()))
                    if len(word) <= 64:
                        known[word] = found
                    out[i] = found
            if len(known) > self.max_words:
                self._known, self._older = {}, known
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.words(text)))


# Well-formed byte sequences of UTF-8 (Unicode standard, table 3-7): first byte, bytes to follow, range of the next one: fixed values.
_LEAD = (
    (0x00, 0x7F, 0, 0x80, 0xBF), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)
REPLACEMENT = "\ufffd"


class Utf8Decoder:
    """Streaming decoder: feed ids, get the text that is complete so far.

    The automaton's states are the unfinished characters that can be held (empty,
    or one to three bytes).  ``step`` runs its bytes through the automaton;
    ``tables`` keeps what a token does in a state, so that a token costs one
    lookup once it has been met there.
    """

    START = b""

    def __init__(self, tokens: Sequence[bytes], tables: dict[tuple[bytes, int], tuple[bytes, str]] | None = None, alone: Alone | None = None):
        self.tokens = tokens
        self.tables = {} if tables is None else tables
        self.alone = Alone(tokens) if alone is None else alone
        self.state = self.START

    _FIRST = {b: (need, low, high) for a, z, need, low, high in _LEAD for b in range(a, z + 1)}

    @classmethod
    def step(cls, state: bytes, data: bytes) -> tuple[bytes, str]:
        """(state after the bytes, text they complete); each maximal ill-formed part becomes U+FFFD."""
        out: list[str] = []
        need, low, high, held = 0, 0x80, 0xBF, b""
        for byte in state + data:
            if need and not low <= byte <= high:
                out.append(REPLACEMENT)
                need, held = 0, b""
            if need:
                held += bytes((byte,))
                need, low, high = need - 1, 0x80, 0xBF
            else:
                need, low, high = cls._FIRST.get(byte, (-1, 0x80, 0xBF))
                held = bytes((byte,))
            if need < 0:
                out.append(REPLACEMENT)
                need, held = 0, b""
            elif need == 0:
                out.append(held.decode())
                held = b""
        return held, "".join(out)

    def move(self, state: bytes, i: int) -> tuple[bytes, str]:
        found = self.tables.get((state, i))
        if found is None:
            if len(self.tables) > 4 * len(self.tokens):
                self.tables.clear()
            found = self.tables[state, i] = self.step(state, self.tokens[i])
        return found

    def feed(self, ids: Sequence[int]) -> str:
        at, state = 0, self.state
        out: list[str | None] = list(map(self.alone.__getitem__, ids))
        while True:
            if not state:
                # tokens that begin and end between characters, up to the next one that doesn't
                try:
                    at = out.index(None, at)
                except ValueError:
                    break
            elif at == len(ids):
                break
            state, out[at] = self.move(state, ids[at])
            at += 1
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        """What is left of an unfinished character at the end."""
        text, self.state = (REPLACEMENT if self.state else ""), self.START
        return text


class Alone(dict):
    """Text of each token that leads the automaton from its start back to it; None for others."""

    def __init__(self, tokens: Sequence[bytes]):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, i: int) -> str | None:
        state, text = Utf8Decoder.step(b"", self.tokens[i])
        found = self[i] = None if state else text
        return found


def decode_bytes(tokens: Sequence[bytes], ids: Iterable[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


_WORKER: dict[int, ByteBPE] = {}
_IDLE: list[threading.Timer] = []
_LOCK = threading.Lock()
#: Seconds for which an idle Python worker keeps its codec; tasks of one stage follow each other faster.
IDLE_SECONDS = 4.0


def worker_codec(ranks_file: bytes, pattern: str) -> ByteBPE:
    """One codec per Python worker and vocabulary, kept between tasks; a task holds it by the reference it gets here."""
    key = hash((ranks_file, pattern))
    with _LOCK:
        while _IDLE:
            _IDLE.pop().cancel()
        codec = _WORKER.get(key)
        if codec is None:
            _WORKER.clear()
            codec = _WORKER[key] = ByteBPE(load_ranks(ranks_file), pattern)
        return codec


def _forget() -> None:
    with _LOCK:
        _WORKER.clear()
    gc.collect()
    give_back()


def forget_when_idle() -> None:
    """Called at the end of a task: without a next one, the worker's tables go."""
    with _LOCK:
        _IDLE.append(threading.Timer(IDLE_SECONDS, _forget))
        _IDLE[-1].daemon = True
        _IDLE[-1].start()


def encode_documents(docs: DataFrame, ranks_file: bytes, pattern: str, text: str = "text", tokens: bool = True) -> DataFrame:
    """Encode ``text`` of every row, then decode the ids again.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by a space),
    decoded_sha256 (of the decoded bytes), valid_utf8 (the decoder met no
    ill-formed byte) and, with ``tokens``, the ids themselves.  Columns of these
    names in ``docs`` are replaced.  Null and empty texts give no ids, repeated
    rows one result each, an empty table none; a text of any length is encoded
    whole.  The rank file (bounded by the vocabulary) goes to the executors as a
    broadcast.
    """
    added = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("valid_utf8", "boolean")] + [("token_ids", "array<int>")] * tokens
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in dict(added)]
    source = docs.select(*keep)
    shared = docs.sparkSession.sparkContext.broadcast(ranks_file)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + [f"{n} {t}" for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared.value, pattern)
        for batch in slices(batches, text):
            counts, ids_sha, back_sha, valid, lists = [], [], [], [], []
            for value in batch.column(text).to_pylist():
                ids = codec.encode(value or "")
                decoder = Utf8Decoder(codec.token, codec.decoding, codec.alone)
                digest, good = hashlib.sha256(), True
                for k in range(0, len(ids), 4096):
                    piece = decoder.feed(ids[k : k + 4096])
                    digest.update(piece.encode())
                    good = good and REPLACEMENT not in piece
                rest = decoder.finish()
                digest.update(rest.encode())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                back_sha.append(digest.hexdigest())
                valid.append((good and not rest) or REPLACEMENT in (value or ""))
                if tokens:
                    lists.append(ids)
            columns = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string()), pa.array(valid, pa.bool_())]
            if tokens:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *dict(added)])
        del codec
        forget_when_idle()

    return source.mapInArrow(run, schema)
