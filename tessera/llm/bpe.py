"""Byte-level BPE by a lazily determinised finite-state transducer, and decoding by an incremental UTF-8 state machine.

The merges compile into two facts: which byte strings are tokens (a trie), and which two tokens may stand side by side,
that is, which the merges leave as they are.  A sequence of tokens is an encoding exactly if all its neighbours may.  The
encoding of a prefix therefore is that of a shorter prefix and one more token, and a machine can read bytes from left to
right with one hypothesis for each place where a token may still be open: the node its bytes lead to in the trie, and the
tokens before.  A deterministic state is the set of the open hypotheses; tokens that all of them share are emitted.  A
hypothesis dies when its bytes lead out of the trie, so tokens come at most one longest token's bytes late.  States and
transitions are made when a text first needs them, and are thrown away together when there are too many.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, only_cache_of, prepare_workers

START = -1
#: Transitions, those asked for once, and token pairs a worker keeps; pieces of a text taken at once.
MAX_TRANSITIONS, MAX_SEEN, MAX_PAIRS, RUN = 100_000, 200_000, 300_000, 1 << 17
#: Bytes at the end of a piece that may be read without making states.
TAIL = 64
#: Rows of token lists made at once.
SLICE = 256


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, data.splitlines()))}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 30) -> list[int]:
    """The tokens of a short piece by the definition: merge the leftmost pair of the lowest rank, as long as that is under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def explicit_pattern(pattern: str, last: int = sys.maxunicode) -> str:
    """``pattern`` with its classes of letters, numbers and white space spelled out as ranges, for the faster module re.

    Ranges come from the categories of this Python's Unicode tables, as far as code point ``last``.
    """
    wanted = {r"\p{L}": "L", r"\p{N}": "N", r"\s": ""}
    spans: dict[str, list[list[int]]] = {name: [] for name in wanted}
    for point in range(last + 1):
        kind = unicodedata.category(chr(point))
        # White space: the separators and the controls from tab to carriage return and next line.
        space = kind[0] == "Z" or 9 <= point <= 13 or point == 0x85
        for name, first in wanted.items():
            if (kind[0] == first) if first else space:
                if spans[name] and spans[name][-1][1] == point - 1:
                    spans[name][-1][1] = point
                else:
                    spans[name].append([point, point])
    bodies = {name: "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in found) for name, found in spans.items()}
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((n for n in (*wanted, r"\S") if pattern.startswith(n, i)), pattern[i])
        if name == r"\S":
            out.append(f"[^{bodies[chr(92) + 's']}]")
        elif name in bodies:
            out.append(bodies[name] if inside else f"[{bodies[name]}]")
        else:
            inside = name == "[" or (inside and name != "]")
            out.append(name)
        i += len(name)
    return "".join(out)


State = tuple[tuple[int, tuple[int, ...]], ...]


class Transducer:
    """Encodes pieces of bytes; its states are numbered as they appear."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends: list[int] = [START]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.child.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(START)
            self.ends[node] = rank
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        first: State = ((0, (START,)),)
        self.numbers: dict[State, int] = {first: 0}
        self.states: list[State] = [first]
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.seen: set[int] = set()

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None if the merges never make it."""
        parts = merge(self.token[token], self.ranks, below=token)
        made = self.split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return made

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges leave ``right`` as a token after ``left``, or at the start."""
        key = (left + 1) << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            made = len(self.token[right]) == 1 or (self.split[right] if right in self.split else self._halves(right)) is not None
            known = self.pairs[key] = made and (left == START or not self._joined(left, right))
        return known

    def _joined(self, left: int, right: int) -> bool:
        """Whether a merge crosses the border of two tokens: their merges next to it are undone, the latest first, and
        while two parts stood side by side no token of both may have had its turn.  Of equal ranks the leftmost comes first."""
        token, rank_of, split = self.token, self.ranks.get, self.split
        turn, a, b = len(self.ranks) + 2, token[left], token[right]
        while True:
            across = rank_of(a + b)
            if across is not None and across < turn:
                return True
            if len(b) == 1 and len(a) == 1:
                return False
            if len(b) == 1 or (len(a) > 1 and left > right):
                halves = split[left] if left in split else self._halves(left)
                if halves is None:
                    return True
                turn, left = left, halves[1]
                a = token[left]
            else:
                halves = split[right] if right in split else self._halves(right)
                if halves is None:
                    return True
                turn, right = right + 1, halves[0]
                b = token[right]

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        open_, whole, children, ends = [], None, self.child, self.ends
        for node, tokens in self.states[number]:
            child = children.get(node << 8 | byte)
            if child is not None:
                open_.append((child, tokens))
                if whole is None and (end := ends[child]) != START and self.may_follow(tokens[-1], end):
                    whole = (*tokens, end)
        if whole is None:
            raise ValueError("a byte is no token of its own")
        open_.append((0, whole))
        # The first of each list is the last token emitted; what all share behind it can go out.
        shared, shortest = 0, len(open_[0][1])
        if shortest > 1:
            shortest = min(len(t) for _, t in open_)
            while shared + 1 < shortest and all(t[shared + 1] == whole[shared + 1] for _, t in open_):
                shared += 1
            if shared:
                open_ = [(node, tokens[shared:]) for node, tokens in open_]
        state = tuple(open_)
        target = self.numbers.get(state)
        if target is None:
            target = self.numbers[state] = len(self.states)
            self.states.append(state)
        out = self.steps[number << 8 | byte] = (target, whole[1 : shared + 1])
        return out

    def encode(self, piece: bytes) -> list[int]:
        if len(self.steps) > MAX_TRANSITIONS:
            self._forget()
        elif len(self.seen) > MAX_SEEN:
            self.seen.clear()
        at, out, steps = 0, [], self.steps
        for i, byte in enumerate(piece):
            found = steps.get(at << 8 | byte)
            if found is None:
                # A transition is made when it is needed a second time; before, the piece ends on the hypotheses themselves.
                key = at << 8 | byte
                if key not in self.seen and len(piece) - i <= TAIL:
                    self.seen.add(key)
                    return out + self._rest(self.states[at], piece[i:])
                found = self._step(at, byte)
            at = found[0]
            if found[1]:
                out += found[1]
            if len(steps) > 2 * MAX_TRANSITIONS:
                # One very long piece alone has filled the tables: go on from the same state in empty ones.
                state = self.states[at]
                self._forget()
                steps, at = self.steps, self.numbers.setdefault(state, len(self.states))
                if at == len(self.states):
                    self.states.append(state)
        return out + list(self.states[at][-1][1][1:])

    def _rest(self, open_: State | list[tuple[int, tuple[int, ...]]], data: bytes) -> list[int]:
        """The tokens from a state to the end of a piece, by its hypotheses, without a new state."""
        children, ends, pairs = self.child.get, self.ends, self.pairs.get
        whole: tuple[int, ...] = ()
        for byte in data:
            then, whole = [], ()
            for node, tokens in open_:
                child = children(node << 8 | byte)
                if child is not None:
                    then.append((child, tokens))
                    if not whole and (end := ends[child]) != START:
                        fits = pairs((tokens[-1] + 1) << 20 | end)
                        if self.may_follow(tokens[-1], end) if fits is None else fits:
                            whole = (*tokens, end)
            then.append((0, whole))
            open_ = then
        return list(whole[1:])


class Pieces(dict):
    """Token ids by piece; a piece that isn't there yet goes through the transducer.

    There are two generations: when the young one is full it becomes the old one, so what is in use stays.
    """

    def __init__(self, transducer: Transducer, kept: int) -> None:
        super().__init__()
        self.transducer, self.kept, self.old = transducer, kept, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = tuple(self.transducer.encode(piece.encode("utf-8")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > self.kept:
            self.old = dict(self)
            self.clear()


class Utf8Stream:
    """Decodes bytes that come in arbitrary parts; a sequence cut off at the end of a part waits for the next."""

    #: How many bytes follow a lead byte, by its upper bits, and the range of the first that follows it.
    FOLLOW = {**dict.fromkeys(range(0xC2, 0xE0), 1), **dict.fromkeys(range(0xE0, 0xF0), 2), **dict.fromkeys(range(0xF0, 0xF5), 3)}
    FIRST = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    def __init__(self) -> None:
        self.held = b""

    def push(self, data: bytes) -> str:
        data = self.held + data
        cut = self._open_at(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")

    def _open_at(self, data: bytes) -> int:
        """Where an unfinished but so far valid sequence begins; the length if there is none."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if 0x80 <= byte < 0xC0:
                continue
            low, high = self.FIRST.get(byte, (0x80, 0xBF))
            open_ = back <= self.FOLLOW.get(byte, 0) and (back == 1 or low <= data[1 - back] <= high)
            return len(data) - back if open_ else len(data)
        return len(data)


class Codec:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, data: bytes, pattern: str, kept: int = 100_000) -> None:
        self.transducer = Transducer(read_ranks(data))
        self.pieces = Pieces(self.transducer, kept)
        self.bytes_of = [self.transducer.token.get(i, b"") for i in range(max(self.transducer.token) + 1)]
        self.digits_of = [str(i) for i in range(len(self.bytes_of))]
        self.split, self.split_low = re.compile(explicit_pattern(pattern)), re.compile(explicit_pattern(pattern, 0xFFFF))

    def encode_runs(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in lists of bounded size."""
        # Ranges beyond 16 bits slow every match; few texts need them.
        split = self.split_low if len(text.encode("utf-16-le")) == 2 * len(text) else self.split
        found = iter(split.findall(text)) if len(text) <= RUN else (m.group() for m in split.finditer(text))
        while run := list(islice(found, RUN)):
            self.pieces.trim()
            yield list(chain.from_iterable(map(self.pieces.__getitem__, run)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_runs(text)))

    def decode_runs(self, runs: Iterable[list[int]]) -> Iterator[str]:
        stream = Utf8Stream()
        for run in runs:
            yield stream.push(b"".join(map(self.bytes_of.__getitem__, run)))
        yield stream.end()

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_runs([ids]))


@lru_cache(maxsize=1)
def codec(data: bytes, pattern: str, kept: int) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(data, pattern, kept)


def digests(one: Codec, text: str | None) -> tuple[int, str, str]:
    """(n_tokens, ids_sha256, decoded_sha256) of a text, in bounded memory beside it."""
    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0

    def told(runs: Iterator[list[int]]) -> Iterator[list[int]]:
        nonlocal n
        for run in runs:
            if run:
                ids_hash.update((" " if n else "").encode() + " ".join(map(one.digits_of.__getitem__, run)).encode())
                n += len(run)
            yield run

    for part in one.decode_runs(told(one.encode_runs(text or ""))):
        text_hash.update(part.encode("utf-8"))
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _coder(vocabulary, pattern: str, kept: int, text_col: str, drop: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache_of("bpe", codec.cache_clear)
        one = codec(vocabulary.value, pattern, kept)
        for batch in batches:
            made = [digests(one, x.as_py()) for x in batch.column(text_col)]
            rest = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if not (drop and n == text_col)]
            columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), *columns], names=[*(n for n, _ in rest), "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", kept_pieces: int = 500_000) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no token, and the digests of nothing.  Repeated rows each get a row; an empty table gives
    an empty table.  Other columns are not read.  The driver reads the vocabulary file, whose size is fixed, and sends it
    to each executor once.  ``kept_pieces``: pieces a worker remembers in each of two generations, some 250 bytes each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prepare_workers(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_coder(vocabulary, pattern, kept_pieces, "text", True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _token_lists(vocabulary, pattern: str, kept: int, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache_of("bpe", codec.cache_clear)
        one = codec(vocabulary.value, pattern, kept)
        for batch in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            lists, whole = [], []
            for x in batch.column(text_col):
                text = x.as_py() or ""
                ids = one.encode(text)
                lists.append(pa.array(ids, pa.int32()))
                whole.append(one.decode(ids) == text)
            ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            column = pa.ListArray.from_arrays(ends, pa.concat_arrays(lists))
            yield pa.RecordBatch.from_arrays([*batch.columns, column, pa.array(whole, pa.bool_())], names=[*batch.schema.names, "token_ids", "round_trip"])

    return coded


def tokenised_documents(docs: DataFrame, vocabulary_path: str, pattern: str, *, text_col: str = "text", kept_pieces: int = 100_000) -> DataFrame:
    """The rows of ``docs`` with token_ids (integers) and round_trip (whether decoding gives the text back) added.

    Columns of those names are replaced.
    """
    from pyspark.sql import types as T

    rows = docs.drop("token_ids", "round_trip")
    prepare_workers(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*rows.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return map_batches(rows, _token_lists(vocabulary, pattern, kept_pieces, text_col), schema)
