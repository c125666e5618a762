"""Encoding with a byte-level public vocabulary through a sentencepiece model written from it (problem 7).

The vocabulary file lists byte strings in rank order. Each byte is mapped to a printable character, each byte string to the
piece spelled with these characters, scored by its negative rank; sentencepiece's merges then pick the same pairs as merging
by rank does. Normalisation is the identity. A text is cut into pre-tokens first, since merges never cross them.
"""

from __future__ import annotations

import base64
import functools
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terazi.session import tokenizer_dir

VOCABULARY = "byte_bpe_50k.tiktoken"
#: pre-tokens remembered by a worker, and the longest that are
CACHED, CACHED_CHARS = 200_000, 48
#: code points classed at a time
BLOCK_CHARS = 4_000_000


# -- the model ---------------------------------------------------------------


@functools.cache
def byte_letters() -> list[str]:
    """For each byte a character that is neither white space nor a control: itself where printable, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes as length-delimited, int as varint, float as fixed32."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 5) + struct.pack("<f", value)


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in rank order."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        ranked = sorted((int(rank), base64.b64decode(text)) for text, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks have gaps")
    return [text for _, text in ranked]


def serialise_model(ranked: list[bytes]) -> bytes:
    """A sentencepiece BPE model with the vocabulary's ids; the unknown piece comes after them and never arises."""
    letters = byte_letters()
    pieces = b"".join(
        _field(1, _field(1, "".join(letters[b] for b in text).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, text in enumerate(ranked)
    )
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ranked) + 1) + _field(35, 0) + _field(40, len(ranked)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


# -- pre-tokens --------------------------------------------------------------

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Unicode's White_Space
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(code))[0]
        if first == "L":
            kinds[code] = _LETTER
        elif first == "N":
            kinds[code] = _NUMBER
    kinds[_WHITE] = _SPACE
    return kinds


def pretoken_starts(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens begin in texts laid end to end (doc_starts: where each non-empty text begins).

    Runs of letters, of numbers and of other signs, each with one blank before it; white space apart from that blank; an
    apostrophe with s, t, re, ve, m, ll or d.
    """
    n = len(codes)
    kind = _classes()[codes]
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    begin |= first[:n]
    white = kind == _SPACE
    # the last white space before a sign of its text: a blank opens the sign's token, anything else stands alone
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n]) if n > 1 else np.empty(0, int)
    begin[last] = True
    begin[last[codes[last] == 0x20] + 1] = False
    # contractions: a lone apostrophe right after no blank, then the letters
    quote = np.flatnonzero((codes == 0x27) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    if len(quote):
        at = lambda k: np.where((quote + k < n), codes[np.minimum(quote + k, n - 1)], 0) * ~_crosses(first, quote, k)
        one, two = at(1), at(2)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, width in ((single, 1), (double, 2)):
            q = quote[hit]
            begin[q + 1] = False
            after = q + 1 + width
            inside = after < n
            begin[after[inside]] = True
    return np.flatnonzero(begin)


def _crosses(first: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), bool)
    for j in range(1, k + 1):
        out |= first[np.minimum(at + j, len(first) - 1)]
    return out


# -- the encoder -------------------------------------------------------------


class Encoder:
    """Encodes whole texts; keeps the ids of short pre-tokens in one flat array."""

    def __init__(self, path: str):
        self.ranked = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranked))
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = self.slots = 0

    def _spell(self, token: str) -> str:
        return token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def _learn(self, tokens: list[str]) -> None:
        for token, ids in zip(tokens, self.model.encode([self._spell(t) for t in tokens], out_type=int, num_threads=1)):
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            if self.slots == len(self.start):
                self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[self.slots], self.size[self.slots] = self.used, len(ids)
            self.slot[token] = self.slots
            self.used += len(ids)
            self.slots += 1

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all pre-tokens of non-empty texts, and how many each text has."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        doc_starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        starts = pretoken_starts(codes, doc_starts)
        bounds = [*starts.tolist(), len(codes)]
        tokens = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        if self.slots > CACHED:
            self._forget()
        get = self.slot.get
        slots = [get(t, -1) for t in tokens]
        if -1 in slots:
            self._learn(list(dict.fromkeys(t for t, s in zip(tokens, slots) if s < 0)))
            slots = [self.slot[t] for t in tokens]
            if any(len(t) > CACHED_CHARS for t in tokens):
                for t in {t for t in tokens if len(t) > CACHED_CHARS}:
                    del self.slot[t]
        per_text = np.diff(np.searchsorted(starts, [*doc_starts, len(codes)]))
        return np.array(slots, np.int64), per_text

    def encode(self, texts: list[str | None], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text); a null or empty text has none."""
        sizes, parts = np.zeros(len(texts), np.int64), []
        at = 0
        while at < len(texts):
            to, chars, block = at, 0, []
            while to < len(texts) and (chars < BLOCK_CHARS):
                if texts[to]:
                    block.append(to)
                    chars += len(texts[to])
                to += 1
            if block:
                slots, per_text = self._block([texts[i] for i in block])
                each = self.size[slots]
                sizes[block] = np.add.reduceat(each, np.cumsum(per_text) - per_text)
                if not counts_only:
                    total = int(each.sum())
                    offsets = np.repeat(self.start[slots] - (np.cumsum(each) - each), each) + np.arange(total)
                    parts.append(self.flat[offsets])
            at = to
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), sizes

    def encode_one(self, text: str | None) -> list[int]:
        return self.encode([text])[0].tolist()

    @functools.cached_property
    def bytes_of(self) -> list[bytes]:
        """The bytes of each id: its piece's letters, mapped back."""
        back = {c: b for b, c in self.letters.items()}
        return [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranked))]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, by the inverse of the byte mapping."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return f"{tokenizer_dir()}/{name}"


def _text_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_table(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (list of int) of every row; null and empty texts have an empty list. Other columns are dropped; ties and
    repeated rows come out as often as they go in."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(path)
        for batch in _text_batches(batches):
            ids, sizes = mine.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["k", "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode_table(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: the inverse of encode_table, except that null texts come back empty. A null list gives a null text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(path)
        for batch in _text_batches(batches):
            texts = [None if x is None else mine.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "t"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, t string").toDF(key, "text")


def count_tokens(rows: DataFrame, text: str, out: str, path: str | None = None) -> DataFrame:
    """rows without its text column, with the number of ids of the text in column out (0 for null)."""
    path = path or vocabulary_path()
    rest = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(path)
        for batch in _text_batches(batches):
            _, sizes = mine.encode(batch.column(0).to_pylist(), counts_only=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes)], [*rest, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*[F.col(f"`{c}`") for c in rest]).dtypes)
    return rows.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{schema}{', ' if rest else ''}`{out}` long")
