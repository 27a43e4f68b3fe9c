"""Whole-corpus encoding with a public byte-level BPE vocabulary.

The encoder is a streaming transducer: text is fed in pieces, ids leave as soon
as no later input can change them, and what is kept back is bounded. Every text
goes through it, whatever its length.

* Between pre-tokens (:class:`StreamingEncoder`): the split pattern never looks
  behind and at most three characters ahead, so all pre-tokens that end before
  those are final. A pre-token that fills the buffer is fed on piece by piece.
* Inside one pre-token (:class:`BpeTransducer`): an encoding is valid exactly if
  each neighbouring pair of tokens encodes to itself, so every prefix of an
  encoding is the encoding of its own bytes. The encoding of the whole pre-token
  therefore has a boundary among the last ``lookahead`` byte positions, where
  ``lookahead`` is the length of the longest token the merges can make. Tokens
  on which the encodings of all those prefixes agree can no longer change.

What the transducer made of a short pre-token is remembered, as most of a text are
pre-tokens that have come before; the memory is bounded and changes no result.

Results: a null text and an empty text both give an empty list; blank texts are
encoded like any other; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The classes whose runs the pattern takes together; each character is in one of them.
RUNS = (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*")
#: Characters fed to the encoder at once.
CHUNK = 1 << 16
#: Characters after its end that can decide where a pre-token ends.
AHEAD = 3
#: Remembered pre-tokens: how many, and of how many characters at most.
KNOWN, KNOWN_CHARS = 1 << 18, 64
_cache: dict[str, "Vocabulary"] = {}


class _Known(dict):
    """Ids of pre-tokens, made by the transducer on first sight."""

    def __init__(self, vocabulary: "Vocabulary"):
        self.v = vocabulary

    def __missing__(self, piece: str) -> list[int]:
        one = BpeTransducer(self.v)
        ids = [*one.feed(piece.encode()), *one.finish()]
        if len(piece) <= KNOWN_CHARS:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """Ranks of a byte-level BPE."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.path = path
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.lookahead = max(map(len, self.ranks))
        #: Ends of tokens: what is none of them ends no token either, however far one looks back.
        self.ends = {token[i:] for token in self.ranks for i in range(len(token))}
        self.split = regex.compile(PATTERN).findall
        self.runs = [regex.compile(r) for r in RUNS]
        self.known = _Known(self)
        self._fits: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[int, int], list | None] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    @cached_property
    def engine(self):
        """The compiled merge engine over the same ranks: what tests compare with."""
        import tiktoken

        return tiktoken.Encoding(os.path.basename(self.path), pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    @classmethod
    def load(cls, path: str = VOCABULARY) -> "Vocabulary":
        if path not in _cache:
            _cache[path] = cls(path)
        return _cache[path]

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is the encoding of their joined bytes."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 1 << 20:
                self._fits.clear()
            known = self._fits[a, b] = self._parted(a, b)
        return known

    def _parted(self, a: int, b: int) -> bool:
        """No merge crosses the border: none of the tokens that end ``a`` while it grows joins one that begins ``b``."""
        ranks, bytes_of = self.ranks, self.bytes_of
        ends, starts = self._edge(a, 1), self._edge(b, 0)
        if ends is not None and starts is not None:
            for x, until_x in ends:
                left = bytes_of[x]
                for y, until_y in starts:
                    rank = ranks.get(left + bytes_of[y])
                    if rank is None or max(x, y) >= min(until_x, until_y):
                        continue
                    if rank < max(x, y):
                        break
                    # of equal merges the left one comes first
                    if rank < until_x and rank <= until_y:
                        return False
                else:
                    continue
                break
            else:
                return True
        return self.merge(bytes_of[a] + bytes_of[b]) == [a, b]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]] | None:
        """``(token, rank of the merge that ends it)`` of the tokens at one side of ``token`` while it grows; None if its merges are not in order of rank."""
        found = self._edges.get((token, side), 0)
        if found == 0:
            found, until = [], 1 << 30
            at = token
            while found is not None:
                found.append((at, until))
                if len(self.bytes_of[at]) == 1:
                    break
                parts = self._parts(at)
                found, at, until = (None, at, until) if parts is None else (found, parts[side], at)
            self._edges[token, side] = found
        return found

    def _parts(self, token: int) -> tuple[int, int] | None:
        if token not in self._halves:
            two = self.merge(self.bytes_of[token], stop=2)
            self._halves[token] = tuple(two) if len(two) == 2 and max(two) < token else None
        return self._halves[token]

    def merge(self, piece: bytes, stop: int = 1) -> list[int]:
        """Plain lowest-rank-first merging of one short pre-token, until ``stop`` tokens are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > stop:
            rank, at = min((ranks.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]


class BpeTransducer:
    """Encodes one pre-token from a stream of bytes in bounded memory."""

    def __init__(self, vocabulary: Vocabulary, every: int = 1024):
        self.v, self.every = vocabulary, every
        self.tail = b""  # the last bytes, enough for the longest token
        self.at = 0  # bytes seen
        self.base = 0  # everything before it has been emitted
        self.last: dict[int, int] = {}  # end position -> last token of that prefix
        self.emitted = -1  # last token that left

    def feed(self, data: bytes) -> Iterator[int]:
        ranks, ends, longest, fits, last = self.v.ranks, self.v.ends, self.v.lookahead, self.v.fits, self.last
        held = self.tail + data
        shift = len(held) - len(data) - self.at  # place of a position in held
        for k in range(self.at + 1, self.at + len(data) + 1):
            could = []
            for start in range(k - 1, max(self.base, k - longest) - 1, -1):
                piece = held[start + shift : k + shift]
                if piece not in ends:
                    break
                if piece in ranks and (start == self.base or start in last):
                    could.append((start, ranks[piece]))
            # only one of them is right, and it is mostly a long one
            while could:
                start, token = could.pop()
                before = self.emitted if start == self.base else last[start]
                if not could or before == -1 or fits(before, token):
                    last[k] = token
                    break
            self.at = k
            if k % self.every == 0:
                yield from self._stable()
                last = self.last
        self.tail = held[-longest:]

    def _chain(self, end: int) -> list[tuple[int, int]]:
        out = []
        while end > self.base:
            token = self.last[end]
            out.append((end, token))
            end -= len(self.v.bytes_of[token])
        return out[::-1]

    def _stable(self) -> Iterator[int]:
        heads = {e for e in range(max(self.base, self.at - self.v.lookahead + 1), self.at + 1) if e in self.last or e == self.base}
        while len(heads) > 1:
            far = max(heads)
            heads.discard(far)
            heads.add(far - len(self.v.bytes_of[self.last[far]]))
        cut = heads.pop()
        for _, token in self._chain(cut):
            yield token
            self.emitted = token
        if cut > self.base:
            self.base = cut
            self.last = {e: t for e, t in self.last.items() if e > cut}

    def finish(self) -> Iterator[int]:
        for _, token in self._chain(self.at):
            yield token


class StreamingEncoder:
    """Feeds text in pieces; yields ids that can no longer change."""

    def __init__(self, vocabulary: Vocabulary, hold: int = CHUNK):
        self.v, self.hold, self.kept = vocabulary, hold, ""
        self.run = None  # the class of a pre-token that is being fed on, and its transducer

    def feed(self, text: str, last: bool = False) -> list[int]:
        self.kept += text
        out: list[int] = []
        known = self.v.known
        while self.kept and (last or len(self.kept) >= self.hold or self.run):
            if self.run:
                if not self._go_on(out, last):
                    break
                continue
            pieces = self.v.split(self.kept)
            rest = 0
            while pieces and not last and rest < AHEAD:
                rest += len(pieces.pop())
            for piece in pieces:
                out += known[piece]
            if pieces or last:
                self.kept = self.kept[len(self.kept) - rest :]
                if len(self.kept) < self.hold:
                    break
            else:
                self._open()
        if last and self.run:
            out.extend(self.run[1].finish())
            self.run = None
        return out

    def _open(self) -> None:
        """One pre-token fills the buffer: feed it on by its class."""
        leading = self.kept[0] == " " and self.v.runs[2].match(self.kept, 1).end() == 1
        kind = next(i for i, r in enumerate(self.v.runs) if r.match(self.kept, int(leading)).end() > int(leading))
        self.run = (kind, BpeTransducer(self.v))
        self.opening = " " if leading else ""
        self.kept = self.kept[int(leading) :]

    def _go_on(self, out: list[int], last: bool) -> bool:
        """Feed the open pre-token; whether it has ended and other text follows."""
        kind, one = self.run
        end = self.v.runs[kind].match(self.kept).end()
        over = end < len(self.kept)
        # white space before other text leaves its last character to what follows
        take = end - 1 if kind == 2 and (over or not last) else end
        out.extend(one.feed((self.opening + self.kept[:take]).encode()))
        self.opening, self.kept = "", self.kept[take:]
        if over:
            out.extend(one.finish())
            self.run = None
        return over

    def finish(self) -> list[int]:
        return self.feed("", last=True)


def encode_text(text: str | None, vocabulary: Vocabulary, chunk: int = CHUNK) -> list[int]:
    if not text:
        return []
    stream, out = StreamingEncoder(vocabulary, chunk), []
    for i in range(0, len(text), chunk):
        out += stream.feed(text[i : i + chunk])
    return out + stream.finish()


class TextDecoder:
    """Byte-to-text state machine: holds back at most three bytes of an open code point."""

    def __init__(self, vocabulary: Vocabulary):
        import codecs

        self.v, self.machine = vocabulary, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, token: int) -> str:
        return self.machine.decode(self.v.bytes_of[token])

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def _id_column(lists: list[list[int]]) -> pa.Array:
    import numpy as np

    ends = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """``(key, ids)`` of every row of ``documents``: a map-only stage over two columns.

    ``path`` names the vocabulary file, which every executor must be able to read.
    Repeated rows give repeated results, an empty table an empty one, and columns
    other than the two named are not read.
    """
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            ids = _id_column([encode_text(t, vocabulary) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, out])

    return spread(documents.select(F.col(key), F.col(text).alias("__text"))).mapInArrow(run, schema)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = VOCABULARY, out: str = "text") -> DataFrame:
    """``(key, text)`` from lists of ids; a null list gives the empty text."""
    schema = T.StructType([T.StructField(key, encoded.schema[key].dataType), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            texts = []
            for one in batch.column(1).to_pylist():
                machine = TextDecoder(vocabulary)
                texts.append("".join([*map(machine.feed, one or []), machine.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, out])

    return encoded.select(key, ids).mapInArrow(run, schema)
