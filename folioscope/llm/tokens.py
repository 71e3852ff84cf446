"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 8).

Prefix dynamic programming: for each prefix of a text's bytes exactly one token can be the last of its encoding.
Storing that token for every prefix gives the encoding by walking back, appends by going on, and edits by starting
again at the edit until the stored tokens fall together with the old ones. A token may follow another exactly
if encoding the bytes of both gives those two; this is decided on the merge tree, without merging.

Pieces of the pre-tokenizer are encoded apart from each other, and each Python worker keeps the encodings of pieces that it
has met. The vocabulary (fixed size, under 2 MB) is read on the driver and broadcast.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import spread

#: Folder of the public tokenizers; its README names the files.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-tokenizer pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Vocabulary:
    """Tokens with the two parts that each was merged from, and the test of which token may follow which."""

    def __init__(self, tokens: list[bytes], parts: list[tuple[int, int]] | None = None):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.tails = {t[k:] for t in tokens for k in range(len(t))}
        if parts is None:
            self.parts: list[tuple[int, int]] = []
            for t in tokens:  # in order of rank: the parts of earlier tokens are there already
                self.parts.append(self._parts_of(t))
        else:
            self.parts = parts

    def _parts_of(self, token: bytes) -> tuple[int, int]:
        rank = len(self.parts)
        for k in range(1, len(token)):
            a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
            if a is not None and b is not None and a < rank and b < rank and self.follows(a, b, rank):
                return a, b
        return -1, -1

    def follows(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether ``b`` may stand right of ``a``, looking at merges that come before the rank ``before``.

        Going back in time from the finished tokens, the units that touch at their border are undone one by one,
        the later-merged first. If two touching units have a joint token that was due before either of
        them was taken up into a larger unit, the encoding would have merged across the border.
        """
        due = len(self.tokens) if before is None else before
        tokens, ids, parts = self.tokens, self.ids, self.parts
        while True:
            joint = ids.get(tokens[a] + tokens[b])
            if joint is not None and joint < due:
                return False
            inner_a, inner_b = parts[a], parts[b]
            if inner_a[0] < 0 and inner_b[0] < 0:
                return True
            # Of merges of the same rank the left one goes first, so at equal ranks the right unit is undone first.
            if inner_b[0] < 0 or (inner_a[0] >= 0 and a > b):
                due, a = a, inner_a[1]
            else:
                # While b is complete, a joint merge of the rank of b itself would also come first from the left.
                due, b = b + 1, inner_b[0]


class Prefixes:
    """The last token of every prefix of a byte string; supports exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _last(self, end: int) -> int:
        data, v = self.data, self.v
        for start in range(end - 1, -1, -1):
            piece = data[start:end]
            if piece not in v.tails:
                break
            t = v.ids.get(piece)
            if t is not None and (start == 0 or v.follows(self.last[start], t)):
                return t
        raise ValueError("bytes that the vocabulary lacks")

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._last(end))

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Exchange data[start:end]; prefixes are computed anew from the edit on until they fall together with the old."""
        tail, old = self.data[end:], self.last
        longest = max(map(len, self.v.tokens))
        self.data, self.last = self.data[:start], old[: start + 1]
        self.append(new)
        shift, same = len(self.data) - end, 0
        self.data += tail
        for at in range(len(self.last), len(self.data) + 1):
            self.last.append(self._last(at))
            same = same + 1 if self.last[at] == old[at - shift] else 0
            if same >= longest:
                self.last += old[at - shift + 1 :]
                return

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            t = self.last[at]
            out.append(t)
            at -= len(self.v.tokens[t])
        return out[::-1]


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


class Encoder:
    """Encodes texts piece by piece, keeping up to ``keep`` encodings of short pieces."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 200_000):
        import regex

        self.v, self.keep, self.known = vocabulary, keep, {}
        self.split = regex.compile(PATTERN).findall

    def piece(self, text: str) -> array:
        data = text.encode("utf-8", "replace")
        whole = self.v.ids.get(data)
        ids = array("i", [whole] if whole is not None else Prefixes(self.v, data).ids())
        if len(data) <= 64:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[text] = ids
        return ids

    def encode(self, text: str, into: array) -> None:
        known = self.known
        for p in self.split(text):
            into.extend(known[p] if p in known else self.piece(p))


_encoders: dict = {}


def _worker_encoder(key: str, shared) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(*shared.value))
    return _encoders[key]


def _encoded(df: DataFrame, text: str, path: str, count_only: bool) -> DataFrame:
    v = load(path)
    shared = df.sparkSession.sparkContext.broadcast((v.tokens, v.parts))
    keys = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import folioscope.llm.tokens as here

        e = here._worker_encoder(path, shared)
        for b in batches:
            at = b.schema.get_field_index(text)
            flat, ends = array("i"), array("i", [0])
            for t in b.column(at).to_pylist():
                if t:
                    e.encode(t, flat)
                ends.append(len(flat))
            offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)])
            if count_only:
                import pyarrow.compute as pc

                made = pc.cast(pc.subtract(offsets.slice(1), offsets.slice(0, len(ends) - 1)), pa.int64())
            else:
                made = pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in keys] + [made], names=[*keys, "tokens" if count_only else "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    made = StructField("tokens", LongType()) if count_only else StructField("ids", ArrayType(IntegerType()))
    return spread(df).mapInArrow(run, StructType([df.schema[k] for k in keys] + [made]))


def encode(df: DataFrame, text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``df`` without ``text``, with ``ids``: array of int, without special tokens.

    Null, like empty, texts have the empty array. Strings of special tokens in a text are ordinary text.
    Very long texts take time in proportion to their length; a column named ``ids`` must not be in ``df``.
    """
    return _encoded(df, text, path, False)


def count(df: DataFrame, text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """As ``encode``, with ``tokens``, the number of tokens (0 for null and empty texts)."""
    return _encoded(df, text, path, True)


def document_ids(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """p8_ids: doc_id and ids of every document."""
    return encode(documents.select("doc_id", "text"), "text", path).select("doc_id", F.col("ids"))
