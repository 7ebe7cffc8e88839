"""Token ids in binary files with Elias-Fano document boundaries.

Documents are sorted by id over range partitions; each task encodes its range with the tokenizers
library and writes one shard: a file of all ids one after the other (16 or 32 bits each, little
endian) and an index of two monotone sequences, the documents' boundaries and their ids, in
Elias-Fano form. The low bits of a value are stored as they are; the high bits are counted in unary
in a bit vector, so a value takes about 2 + log2(universe / n) bits. The position of every
``SAMPLED``-th set bit is kept as 32 bits: ``select`` starts there and counts on, so one document is
found without reading the table of all, and there are no 64-bit offsets.

Files get fresh names, and the table ``manifest`` names the shards that count. It is committed by
Spark when all shards are written, so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import APART, sliced
from .common import body, col

END = 0               # the id appended to every document
SAMPLED = 256         # set bits between two stored positions
CACHED = 800_000      # parts of texts whose ids a worker keeps
SLICE = 4_000_000     # characters of text that are encoded at a time, unless one document has more
JOINED = 1000         # new parts that go through the library as one text
FLUSHED = 1 << 20     # ids that a task reads back at a time, unless one document has more
# marks behind a word; a piece of a text never goes on from a Latin letter to one of them
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
# where a line ends between two words: the line feed is a piece of its own, and a new piece begins behind it
LINES = re.compile(r"(?<=\S)(?=\n\S)")
# a blank that may be beside white space or an end, so that it doesn't part two words by itself
WHITE = "".join(f"\\x{{{n:x}}}" for n in range(0x110000) if chr(n).isspace() and chr(n) not in " \n")
TOUCHING = f"  | \n|\n |^ | $|[{WHITE}]"
MAGIC = b"EFTOK001"
HEAD = "<8sQQQB"      # magic, documents, of these without an id, ids, bytes of an id
SEQUENCE = "<QqQB"    # values, least value, largest less least, low bits


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder: a URI of any store that Arrow knows, or a plain path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


# ---- Elias-Fano sequences


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after the other, lowest bit first."""
    if not width or not len(values):
        return np.zeros(0, np.uint8)
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")


def unpacked(data: np.ndarray, first: int, count: int, width: int) -> np.ndarray:
    """``count`` values of ``width`` bits from the one numbered ``first``."""
    if not width or not count:
        return np.zeros(count, np.uint64)
    start, end = first * width, (first + count) * width
    bits = np.unpackbits(data[start // 8:(end + 7) // 8], bitorder="little")[start % 8:start % 8 + count * width]
    return (bits.reshape(count, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)


class EliasFano:
    """A non-decreasing sequence of 64-bit integers in compressed form."""

    def __init__(self, n: int, least: int, span: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.least, self.span, self.width, self.low, self.high, self.samples = n, least, span, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, 0, *(np.zeros(0, t) for t in (np.uint8, np.uint8, np.uint32)))
        least, span = int(values[0]), int(values[-1]) - int(values[0])
        rest = values.astype(np.uint64) - np.uint64(least & (2 ** 64 - 1))  # modulo 2^64, so any span fits
        width = max(0, (span // n).bit_length() - 1)
        ones = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        if int(ones[-1]) >= 2 ** 32:
            raise ValueError(f"{n} values in one shard: positions need over 32 bits, write more shards")
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        low = packed(rest & np.uint64((1 << width) - 1), width)
        return cls(n, least, span, width, low, np.packbits(bits, bitorder="little"), ones[::SAMPLED].astype(np.uint32))

    def tobytes(self) -> bytes:
        sizes = struct.pack("<III", len(self.low), len(self.high), len(self.samples))
        return struct.pack(SEQUENCE, self.n, self.least, self.span, self.width) + sizes + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, least, span, width = struct.unpack_from(SEQUENCE, data, at)
        low, high, samples = struct.unpack_from("<III", data, at + struct.calcsize(SEQUENCE))
        at += struct.calcsize(SEQUENCE) + 12
        parts = (np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, "<u4", samples, at + low + high))
        return cls(n, least, span, width, *parts), at + low + high + 4 * samples

    def select(self, i: int, count: int = 1) -> np.ndarray:
        """Positions of ``count`` set bits from the one numbered ``i``: from the sample before it, a few bytes are counted."""
        start = int(self.samples[i // SAMPLED])
        last = (i + count - 1) // SAMPLED + 1
        end = int(self.samples[last]) + 1 if last < len(self.samples) else 8 * len(self.high)
        first = start // 8
        bits = np.unpackbits(self.high[first:(end + 7) // 8], bitorder="little")
        bits[:start - 8 * first] = 0
        return np.flatnonzero(bits)[i % SAMPLED:i % SAMPLED + count] + 8 * first

    def get(self, i: int, count: int = 1) -> np.ndarray:
        """``count`` values from the one numbered ``i``."""
        if i < 0 or i + count > self.n:
            raise IndexError(f"{i} to {i + count} of {self.n}")
        if not count:
            return np.zeros(0, np.int64)
        high = (self.select(i, count) - np.arange(i, i + count)).astype(np.uint64) << np.uint64(self.width)
        return (high + unpacked(self.low, i, count, self.width) + np.uint64(self.least & (2 ** 64 - 1))).astype(np.int64)

    def first_at_least(self, value: int) -> int:
        """Number of values below ``value``, by binary search over ``get``."""
        a, b = 0, self.n
        while a < b:
            mid = (a + b) // 2
            a, b = (mid + 1, b) if int(self.get(mid)[0]) < value else (a, mid)
        return a


# ---- shards


class Shard:
    """One shard opened for reading: ids of any document by its place, places of a document id."""

    def __init__(self, folder: str, name: str) -> None:
        self.files, path = place(folder)
        self.ids_path = f"{path}/{name}.ids"
        with self.files.open_input_stream(f"{path}/{name}.ef") as f:
            data = f.read()
        magic, self.n, self.unnamed, self.total, self.width = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError(f"{name}.ef is no index of token ids")
        self.bounds, at = EliasFano.read(data, struct.calcsize(HEAD))
        self.names, _ = EliasFano.read(data, at)

    def span(self, i: int, count: int = 1) -> np.ndarray:
        """Boundaries of ``count`` documents from place ``i``, one more than documents."""
        return self.bounds.get(i, count + 1)

    def ids(self, start: int, end: int, source=None) -> np.ndarray:
        with source or self.files.open_input_file(self.ids_path) as f:
            return np.frombuffer(f.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.span(i).tolist())

    def places(self, name: int) -> range:
        """Places of the documents with this id."""
        return range(self.unnamed + self.names.first_at_least(name), self.unnamed + self.names.first_at_least(name + 1))

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place, boundaries, ids) of all documents in order, a bounded number at a time."""
        with self.files.open_input_file(self.ids_path) as f:
            at = 0
            while at < self.n:
                bounds = self.span(at, min(8 * SAMPLED, self.n - at))
                count = max(1, int(np.searchsorted(bounds, bounds[0] + FLUSHED, "right")) - 1)
                bounds = bounds[:count + 1]
                start, end = int(bounds[0]), int(bounds[-1])
                yield at, bounds, np.frombuffer(f.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")
                at += count

    def name_of(self, i: int, count: int) -> list[int | None]:
        empty = max(0, min(self.unnamed - i, count))
        return [None] * empty + self.names.get(max(0, i - self.unnamed), count - empty).tolist()


class Encoder:
    """The tokenizers library behind a cache of parts.

    Byte-level pieces never cross the place before a single blank between two other characters, so a
    text can be cut there without any effect on the ids. Parts not met before go through the library
    once, many joined in one text, as a call costs more than a word; the bytes of the tokens tell
    where each part ends. With any other kind of tokenizer, texts go through the library whole.
    """

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(tokenizer)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.wide = self.library.get_vocab_size() > 2 ** 16
        spec = json.loads(tokenizer)
        before = spec.get("pre_tokenizer") or {}
        self.byte_level = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                           and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))
        vocabulary = self.library.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # a byte is one character there
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def library_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def gather(self, used: np.ndarray, counts: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of ``counts`` cached parts each, one run after the other, and their numbers."""
        starts, sizes = self.starts[used], self.starts[used + 1] - self.starts[used]
        ends = np.cumsum(sizes)
        lengths = np.diff(np.concatenate([[0], ends[np.cumsum(counts) - 1]]))
        return self.ids[np.arange(int(ends[-1])) + np.repeat(starts - (ends - sizes), sizes)], lengths

    def learn(self, words: list[str], odd: list[str]) -> None:
        """Takes parts up into the cache; one of several lines, or with marks behind its letters, is put together from its pieces."""
        plain, cut, pieces, counts = [], [], [], []
        for word in words:
            if word[-1] not in MARKS and "\n" not in word:
                plain.append(word)
                continue
            own = []
            for line in LINES.split(word) if "\n" in word else (word,):
                head = line.rstrip(MARKS)
                if len(head) < len(line) and head[-1].isalpha() and head[-1] < "\u0250":
                    own += head, line[len(head):]
                else:
                    own.append(line)
            if len(own) > 1:
                cut.append(word)
                pieces += own
                counts.append(len(own))
            else:
                plain.append(word)
        new = set(pieces).difference(self.known).difference(plain, odd)
        heads = [p for p in new if p[0] in " \n"]  # a blank or line feed before a word, and no white space behind
        self.take(plain + heads, list(new.difference(heads).union(odd)))
        if cut:
            ids, lengths = self.gather(np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces)), counts)
            self.keep(cut, ids, np.cumsum(lengths))

    def keep(self, parts: Iterable[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(ends))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.ids = np.concatenate([self.ids, ids])

    def take(self, words: list[str], odd: list[str]) -> None:
        """Puts parts through the library: words, which can stand side by side in one text, and others."""
        ids, _ = self.library_ids(["".join(words[a:a + JOINED]) for a in range(0, len(words), JOINED)])
        ends = np.cumsum(pa.compute.binary_length(pa.array(words, pa.string())).to_numpy(), dtype=np.int64)
        upto = np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1
        single, sizes = self.library_ids(odd)
        self.keep(chain(words, odd), np.concatenate([ids, single]), np.concatenate([upto, len(ids) + np.cumsum(sizes)]))

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Each text at its blanks between two other characters."""
        own = pa.compute.split_pattern(texts, " ")
        touching = pa.compute.match_substring_regex(texts, TOUCHING)
        if not touching.true_count:
            return own
        apart = [APART.split(text.as_py()) if odd else None for text, odd in zip(texts, touching.to_pylist())]
        return pa.compute.coalesce(pa.array(apart, own.type), own)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and their numbers."""
        if not self.byte_level:
            ids, lengths = self.library_ids(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
            return np.insert(ids, np.cumsum(lengths), END), lengths + 1
        if len(self.known) > CACHED:
            self.forget()
        own = self.cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        counts, parts = pa.compute.list_value_length(own).to_numpy().astype(np.int64), own.flatten()
        first = np.zeros(len(parts), bool)
        first[np.cumsum(counts) - counts] = True
        begin = parts.filter(pa.array(first)).to_pylist()  # without a blank before them
        rest = parts.filter(pa.array(~first)).dictionary_encode()
        words = pa.compute.binary_join_element_wise("", rest.dictionary, " ").to_numpy(zero_copy_only=False)
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        at, odd = np.flatnonzero(found < 0), set(begin).difference(self.known)
        new = words[at].tolist()
        odd.update(w for w in new if w[-1].isspace())  # the last of a text may
        if new or odd:
            self.learn([w for w in new if w not in odd], list(odd))  # a text may begin with a blank
        found[at] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        numbers = np.empty(len(parts), np.int64)
        numbers[first] = np.fromiter(map(self.known.__getitem__, begin), np.int64, len(begin))
        numbers[~first] = found[rest.indices.to_numpy()]
        ids, lengths = self.gather(numbers, counts)
        return np.insert(ids, np.cumsum(lengths), END), lengths + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(tokenizer: str) -> Encoder:
    """One encoder per worker process and tokenizer."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str) -> Iterator[pa.RecordBatch]:
    """A task's range of documents becomes one shard; its row is what the manifest says of it."""
    encoder, number, (files, path) = encoder_of(tokenizer), TaskContext.get().partitionId(), place(folder)
    name, stream, lengths, names = f"{number:06d}-{uuid.uuid4().hex}", None, [], []
    width = 4 if encoder.wide else 2
    for batch in batches:
        texts = batch.column(1)
        names.append(batch.column(0))
        for a, b in sliced(pa.compute.utf8_length(texts).to_pylist(), SLICE):
            ids, sizes = encoder.encode(texts[a:b])
            stream = stream or files.open_output_stream(f"{path}/{name}.ids", compression=None)
            stream.write(ids.astype(f"<u{width}").tobytes())
            lengths.append(sizes)
    if not stream:
        return
    stream.close()
    ids = pa.chunked_array(names).combine_chunks()
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]))
    head = struct.pack(HEAD, MAGIC, len(ids), ids.null_count, bounds.span, width)
    index = head + bounds.tobytes() + EliasFano.of(ids.drop_null().to_numpy()).tobytes()
    with files.open_output_stream(f"{path}/{name}.ef", compression=None) as f:
        f.write(index)
    yield pa.RecordBatch.from_pydict({"shard": [number], "name": [name], "n_docs": [len(ids)], "n_tokens": [bounds.span], "index_bytes": [len(index)]})


def read_shard(folder: str, name: str, base: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    shard = Shard(folder, name)
    for at, bounds, flat in shard.chunks():
        wide, local = flat.astype("<u4"), bounds - bounds[0]
        data = memoryview(wide.tobytes())
        out = {"doc_id": pa.array(shard.name_of(at, len(bounds) - 1), pa.int64()), "start": bounds[:-1] + base, "n_tokens": np.diff(bounds),
               "ids_crc32": pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in zip(local[:-1].tolist(), local[1:].tolist())], pa.int64())}
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(local, pa.int32()), pa.array(wide.astype(np.int32)))
        yield pa.RecordBatch.from_pydict(out)


MANIFEST = "shard long, name string, n_docs long, n_tokens long, index_bytes long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes all documents' ids under ``folder`` in ascending id order and returns the manifest, a row per shard.

    ``tokenizer`` is the library's file on the driver; ``folder`` is one that all executors share.
    A null or empty text is the end id alone. Documents without an id come first, equal ids by the
    hash of their text, and repeated rows each keep a place. Ids are integers. An empty table gives
    an empty manifest. Texts move once, to their range; several equal ids may span shards, so a hot one
    doesn't fill a task. ``shards`` is the number of ranges, else that of the session's shuffles.
    """
    spark = docs.sparkSession
    files, path = place(folder)
    files.create_dir(path)
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a file of the vocabulary's size
    named = docs.select(col(id).cast("long").alias("id"), body(col(text)).alias("t"))
    # the row's own number parts what is equal; equal rows may change places
    keyed = named.withColumn("h", F.xxhash64("t")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("row")]
    ranged = keyed.repartitionByRange(shards, *order) if shards else keyed.repartitionByRange(*order)
    rows = ranged.sortWithinPartitions(*order).select("id", "t").mapInArrow(lambda batches: write_shard(batches, folder, shared.value), MANIFEST)
    rows.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Every document from the files: doc_id, start (ids before it in all shards), n_tokens, ids_crc32 and, if asked for, ids.

    ids_crc32 is that of the ids as little-endian 32-bit integers. Shards are numbered by one window
    over the manifest, which has one row a shard.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    listed = manifest.select("shard", "name", F.coalesce(before, F.lit(0)).alias("base")).repartition("shard")
    types = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            yield from read_shard(folder, row["name"], row["base"], ids)

    return listed.mapInArrow(run, types)
