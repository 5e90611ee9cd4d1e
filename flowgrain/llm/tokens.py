"""Encoding of the whole corpus with a public byte-level tokenizer (problem 6).

Method: prefix dynamic programming. For every prefix of a piece of bytes there is exactly one last token with which
its encoding can end; these are kept from left to right, and a token may follow another only if the two encode as
just these two. Appending to a piece continues the table; after an edit only the pieces around it are encoded
anew. Pieces recur, so each worker remembers them in a table of bounded size.

Defined results: null and empty texts give an empty list, texts of any length are encoded whole, repeated rows stay,
a null id stays null, an empty table gives an empty result, other columns are ignored. The texts of special tokens
are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowgrain.session import widen

#: Where the public vocabulary lies on every machine; a parameter of each operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a worker; beyond that the table starts again, so that its memory is bounded.
REMEMBERED = 200_000


class PieceTable(dict):
    """Maps a piece of text to its token ids; fills itself."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.names = ranks, {i: b for b, i in ranks.items()}
        self.starts = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self.longest = max(map(len, ranks), default=1)
        self.begun: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        self[piece] = ids = (whole,) if whole is not None else tuple(self.read(self.table(data), data))
        return ids

    def merge(self, data: bytes) -> list[int]:
        """The plain definition: the adjacent parts of lowest rank are merged until none can be."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a inside a piece."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 5 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.names[a] + self.names[b]) == [a, b]
        return known

    def table(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix of `data`; `last` is the table of a prefix of it, which stays valid."""
        known = len(last) if last else 0
        last = [*(last or ()), *[-1] * (len(data) - known)]
        ranks, starts, fits, n = self.ranks, self.starts, self.fits, len(data)
        first = max(0, known - self.longest)
        for j in range(first, n):
            before = last[j - 1] if j else -1
            k = j + 1
            while k <= n and (part := data[j:k]) in starts:
                if k > known and last[k - 1] < 0 and (t := ranks.get(part)) is not None and (fits(before, t) if j else self.merge(part) == [t]):
                    last[k - 1] = t
                k += 1
        return last

    def go_on(self, old: str, new: str) -> None:
        """Encodes a piece that begins with another, going on with the table of that one."""
        if new in self or not new.startswith(old):
            return
        data = new.encode("utf-8", "surrogatepass")
        last = self.begun.get(old) or self.table(old.encode("utf-8", "surrogatepass"))
        if len(self.begun) > 1_000:
            self.begun.clear()
        self.begun[new] = last = self.table(data, last)
        whole = self.ranks.get(data)
        self[new] = (whole,) if whole is not None else tuple(self.read(last, data))

    def read(self, last: list[int], data: bytes) -> list[int]:
        """The tokens of the whole piece, from its end backwards."""
        ids, k = [], len(data)
        while k:
            ids.append(t := last[k - 1])
            k -= len(self.names[t])
        return ids[::-1]


@lru_cache(maxsize=4)
def piece_table(vocabulary: str = VOCABULARY) -> PieceTable:
    """The table of one vocabulary file, made once per worker process."""
    with open(vocabulary, "rb") as f:
        return PieceTable({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b})


@lru_cache(maxsize=1)
def splitter() -> Callable[[str], list[str]]:
    return regex.compile(SPLIT).findall


def encode(text: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    """Token ids of one text."""
    table = piece_table(vocabulary)
    return list(chain.from_iterable(map(table.__getitem__, splitter()(text)))) if text else []


class EncodedText:
    """A text with its pieces and their tokens, for exact appends and edits that encode only what changed."""

    def __init__(self, text: str, vocabulary: str = VOCABULARY):
        self.text, self.table, self.pieces = text, piece_table(vocabulary), splitter()(text)

    @property
    def ids(self) -> list[int]:
        return list(chain.from_iterable(map(self.table.__getitem__, self.pieces)))

    def append(self, more: str) -> EncodedText:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> EncodedText:
        """Replaces text[start:end]; pieces well before it stay, and splitting stops where it meets an old border again."""
        text = self.text[:start] + new + self.text[end:]
        shift, at, borders = len(new) - (end - start), 0, {}
        kept = 0
        for i, p in enumerate(self.pieces):
            borders[at] = i
            at += len(p)
            if at < start and i + 1 < len(self.pieces):
                kept = i
        begin = next((b for b, i in borders.items() if i == kept), 0)
        fresh, place = [], begin
        for m in regex.finditer(SPLIT, text, pos=begin):
            old = borders.get(place if place < start else place - shift)
            if old is not None and place >= start + len(new) and place - shift >= end:
                self.pieces[kept:] = fresh + self.pieces[old:]
                break
            if old is not None and old < len(self.pieces):
                self.table.go_on(self.pieces[old], m.group())
            fresh.append(m.group())
            place = m.end()
        else:
            self.pieces[kept:] = fresh
        self.text = text
        return self


def _batches(make: Callable[[pa.Array], pa.Array], name: str, vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), make(b.column(1))], names=[b.schema.names[0], name])

    return run


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`key` and `ids`, the tokens of each whole text."""

    def make(texts: pa.Array) -> pa.Array:
        return pa.array([encode(t, vocabulary) for t in texts.to_pylist()], pa.list_(pa.int32()))

    rows = widen(docs.select(key, text))
    return rows.mapInArrow(_batches(make, "ids", vocabulary), f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`key` and `n_tokens` of each whole text."""

    def make(texts: pa.Array) -> pa.Array:
        return pa.array([len(encode(t, vocabulary)) for t in texts.to_pylist()], pa.int64())

    rows = widen(docs.select(key, text))
    return rows.mapInArrow(_batches(make, "n_tokens", vocabulary), f"`{key}` {rows.schema[key].dataType.simpleString()}, n_tokens long")
