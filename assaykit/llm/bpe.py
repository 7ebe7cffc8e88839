"""Byte-level BPE encoding and decoding with numpy matrices.

A task works through its texts in slices. The parts between single blanks of a slice are made
distinct first (they cannot influence each other's tokens), split by the pattern, and the distinct
pieces that no earlier slice has met are encoded together: pieces of similar length form one padded
matrix of byte tokens, and in each round every row merges its leftmost pair of minimum rank. Ranks
of pairs come from an open-addressing hash table in two arrays; rows and columns that are done are
taken out of the matrix. Work and memory of a task are bounded by its slices and a cache of stated
size, never by the number of its documents.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body, col, inner

#: characters of text in one slice, cells of one matrix, and parts kept from earlier slices
SLICE_CHARS = 1_000_000
CELLS = 500_000
CACHED = 150_000

NONE = np.int32(2**31 - 1)
APART = re.compile(r"(?<=\S) (?=\S)")
#: white space other than blanks and line feeds
ODD = re.compile(r"[^\S \n]")


def touching(text: str) -> bool:
    """Whether a blank may be beside white space or an end, so that it doesn't part two words by itself."""
    return ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or ODD.search(text) is not None)



class PairTable:
    """(left id, right id) -> rank of the joined token, for whole arrays at once."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        todo, at = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]
            won = self.keys[at] == keys[todo]
            self.ranks[at[won]] = ranks[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        left_over = np.nonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        at, keys = at[left_over], keys[left_over]
        while len(at):
            at = (at + 1) & (len(self.keys) - 1)
            hit, on = self.keys[at] == keys, self.keys[at] >= 0
            out[tuple(x[hit] for x in left_over)] = self.ranks[at[hit]]
            go = on & ~hit
            at, keys, left_over = at[go], keys[go], tuple(x[go] for x in left_over)
        return out


class Ragged:
    """Rows of ids of different lengths in one array."""

    def __init__(self) -> None:
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen rows one after the other, and their sizes."""
        sizes = self.sizes[rows]
        shift = self.starts[rows] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(sizes.sum())], sizes


class Numbers(dict):
    """Numbers its keys in the order of their first lookup; ``new`` are those since the last call of ``learnt``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def learnt(self) -> list:
        new, self.new = self.new, []
        return new


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, of the given lengths."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


class Coder:
    """Encodes and decodes by the ranks of a vocabulary file (base64 token and rank in each line)."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks_file.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.vocabulary = {r: t for t, r in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pad = np.int32(max(self.vocabulary) + 1)
        keys, joined = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    joined.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(joined, np.int32))
        self.forget()

    def forget(self) -> None:
        self.parts, self.pieces = Numbers(), Numbers()
        self.part_ids, self.piece_ids = Ragged(), Ragged()

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and their numbers; pieces of similar length share a matrix."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        grown, found, sizes = lengths[order], Ragged(), np.zeros(len(pieces), np.int64)
        start = 0
        while start < len(order):
            widest = grown[start] + grown[start] // 4 + 1
            end = min(int(np.searchsorted(grown, widest, "right")), start + max(1, CELLS // int(widest)))
            flat, n = self.merge_rows([pieces[i] for i in order[start:end]], grown[start:end])
            found.add(flat, n)
            start = end
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return found.take(back)

    def merge_rows(self, pieces: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(pieces), int(lengths.max())
        tokens = np.full((n, width), self.pad, np.int32)
        tokens[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        where = np.arange(n)
        ranks = self.pairs.find(tokens[:, :-1], tokens[:, 1:])
        out, finished = Ragged(), []
        while True:
            rows = np.arange(len(tokens))
            if ranks.shape[1]:
                at = ranks.argmin(1)  # the first, so the leftmost
                best = ranks[rows, at]
                done = best == NONE
            else:
                done = np.ones(len(tokens), bool)
            if done.any():
                ended = tokens[done]
                full = ended != self.pad
                out.add(ended[full], full.sum(1))
                finished.append(where[done])
                if done.all():
                    back = np.empty(n, np.int64)
                    back[np.concatenate(finished)] = np.arange(n)
                    return out.take(back)
                live = ~done
                tokens, ranks, where, at, best = tokens[live], ranks[live], where[live], at[live], best[live]
                # columns that are padding in every row go
                spare = int((tokens != self.pad).any(0)[::-1].argmax())
                if spare:
                    tokens, ranks = tokens[:, :-spare], ranks[:, :-spare]
                rows = np.arange(len(tokens))
            n_live, width = tokens.shape
            tokens[rows, at] = best
            keep = np.ones((n_live, width), bool)
            keep[rows, at + 1] = False
            tokens = tokens[keep].reshape(n_live, width - 1)
            keep = np.ones((n_live, width - 1), bool)
            keep[rows, at] = False
            ranks = ranks[keep].reshape(n_live, width - 2)
            for first in (at - 1, at):  # the pairs that the new token belongs to
                ok = (first >= 0) & (first < width - 2)
                r, f = rows[ok], first[ok]
                ranks[r, f] = self.pairs.find(tokens[r, f], tokens[r, f + 1])

    def learn(self) -> None:
        """Encodes the parts that were looked up for the first time."""
        split = list(map(self.pattern.findall, self.parts.learnt()))
        number = self.pieces.__getitem__
        used = np.fromiter(map(number, chain.from_iterable(split)), np.int64)
        new = [p.encode() for p in self.pieces.learnt()]
        if new:
            whole = [self.ranks.get(p) for p in new]  # a piece that is a token needs no merge
            flat, sizes = self.merge([p for p, r in zip(new, whole) if r is None]) if None in whole else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            is_token = np.array([r is not None for r in whole])
            all_sizes = np.ones(len(new), np.int64)
            all_sizes[~is_token] = sizes
            values = np.empty(all_sizes.sum(), np.int32)
            mask = np.repeat(is_token, all_sizes)
            values[mask] = [r for r in whole if r is not None]
            values[~mask] = flat
            self.piece_ids.add(values, all_sizes)
        if split:
            flat, sizes = self.piece_ids.take(used)
            self.part_ids.add(flat, sums(sizes, np.fromiter(map(len, split), np.int64, len(split))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text; without special tokens."""
        if len(self.parts) > CACHED:
            self.forget()
        number, used, counts = self.parts.__getitem__, [], []
        for text in texts:
            own = APART.split(text) if touching(text) else text.split(" ")
            used.append(number(own[0]))
            used.extend(map(number, map(" ".__add__, own[1:])))
            counts.append(len(own))
        self.learn()
        flat, sizes = self.part_ids.take(np.array(used, np.int64))
        return flat, sums(sizes, np.array(counts, np.int64))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_CODERS: dict[tuple[int, str], Coder] = {}


def coder_of(shared, pattern: str) -> Coder:
    """One coder per worker process and vocabulary."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(shared.value, pattern)
    return _CODERS[key]


def sliced(lengths: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; one text at least."""
    start = size = 0
    for i, length in enumerate(lengths):
        if i > start and size + length > most:
            yield start, i
            start, size = i, 0
        size += length
    if start < len(lengths):
        yield start, len(lengths)


def encode_batch(coder: Coder, texts: pa.Array) -> pa.Array:
    found = []
    for a, b in sliced(pa.compute.utf8_length(texts).to_pylist()):
        found.append(coder.encode(texts[a:b].to_pylist()))
    values, sizes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def decode_batch(coder: Coder, ids: pa.Array) -> pa.Array:
    starts, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    valid = ids.is_valid().to_pylist()
    return pa.array([coder.decode(values[a:b].tolist()) if ok else None for a, b, ok in zip(starts[:-1], starts[1:], valid)], pa.binary())


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file, sent to executors once; its size is that of the vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All rows and columns of ``docs`` with the token ids of the whole text as array<int>.

    ``path`` is a rank file on the driver; ``pattern`` splits a text before the merges. A null or
    empty text has no ids. Repeated rows get equal ids. A column called like the result is replaced.
    An empty table gives an empty table.
    """
    shared = vocabulary(docs, path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield encode_batch(coder_of(shared, pattern), batch)

    return docs.withColumn(out, ids(body(col(text))))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows and columns of ``df`` with the bytes that the ids stand for; null ids give null."""
    shared = vocabulary(df, path)

    @F.arrow_udf(T.BinaryType())
    def raw(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in rows:
            yield decode_batch(coder_of(shared, pattern), batch)

    return df.withColumn(out, raw(col(ids)))


def token_digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids, n_tokens, and the SHA-256 of the ids and of the bytes they decode to.

    One worker encodes and decodes, so a task holds one vocabulary.
    """
    shared = vocabulary(docs, path)
    both = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    @F.arrow_udf(both)
    def there_and_back(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            coder = coder_of(shared, pattern)
            ids = encode_batch(coder, batch)
            yield pa.StructArray.from_arrays([ids, decode_batch(coder, ids)], ["ids", "decoded"])

    results = {"ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    (name,) = inner(docs, "coded")
    coded = docs.withColumn(name, there_and_back(body(col(text))))
    ids = col(name)["ids"]
    return coded.select(*[col(c) for c in docs.columns if c.lower() not in results], ids.alias("ids"), F.size(ids).cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2(col(name)["decoded"], 256).alias("decoded_sha256"))
