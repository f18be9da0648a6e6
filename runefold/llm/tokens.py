"""Encoding a corpus with a byte-level BPE vocabulary, reusing content-defined chunks.

A text is cut where a rolling hash over 16 bytes hits a pattern, so equal
passages of different documents yield equal chunks wherever they stand. A chunk
that several partitions hold is encoded once in the cluster:

1. every partition writes the hashes of its different chunks (8 bytes a chunk);
2. a hash of several partitions gets one of them as owner;
3. owners encode what they own;
4. the ids are joined to the partitions that hold the chunk and written for each;
5. every partition encodes its documents, with what it was given and a cache of
   its own for chunks that only it repeats.

Texts are never shuffled, only hashes and the ids of shared chunks; a chunk of
every document has one row a partition. What a partition was given is checked
against the bytes of its chunk, so neither an equal hash nor other borders of
partitions can change a result.

Encodings of neighbouring chunks can't simply be joined: a cut may fall inside
a piece or a run of blanks. A place where a visible ASCII character is followed
by a blank or a line feed is a border of pieces in every text that has it there,
because no alternative of the split pattern crosses it and none looks beyond
it. At a join the text from the last but one border of the left chunk to the
second border of the right one is encoded anew; the new ids must agree with those of both
chunks over the stretch between the two borders on either side. Chunks with too
few borders are encoded anew with their neighbours, and a document whose joins
do not agree as a whole, so the result equals that of the whole text.

Defined results: null and empty texts give an empty list; text that spells a
special token is ordinary text; every document gives one row, repeated rows
included, whatever its length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runefold.shared import open_fs, workspace, written

#: Default place of the vocabulary (token bytes in base64 and rank, a line each).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WINDOW = 16
#: A cut is expected every 2**CUT_BITS bytes.
CUT_BITS = 10
LONGEST = 1 << 15
#: Bytes of chunk texts in each of the two generations of a worker's cache.
CACHE_BYTES = 32 << 20
#: Bytes of text hashed at a time.
SLICE_BYTES = 4 << 20

_BORDER = re.compile(rb"[\x21-\x7e](?=[ \n])")


def gear_table() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = gear_table()


def cut_places(data: np.ndarray) -> np.ndarray:
    """Offsets after which the rolling hash of the last WINDOW bytes hits; never inside a UTF-8 character."""
    h = _GEAR[data]
    k = 1
    while k < WINDOW:
        shifted = h[:-k] << np.uint32(k)
        h[k:] += shifted
        k *= 2
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    at = at[at < len(data)]
    return at[data[at] & 0xC0 != 0x80]


class Chunk(NamedTuple):
    """An encoded chunk: its first two and last two borders, the ids between the outer ones, and how many of them lie between the two on either side."""

    first: int
    second: int
    last_but_one: int
    last: int
    ids: np.ndarray
    n_first: int
    n_last: int


def key_of(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def borders(data: bytes) -> tuple[int, int, int, int] | None:
    """The first two and last two borders, if there are three or more."""
    if (a := _BORDER.search(data)) is None or (b := _BORDER.search(data, a.end())) is None:
        return None
    out, at = [], len(data)
    while len(out) < 2:
        at = max(data.rfind(b" ", 0, at), data.rfind(b"\n", 0, at))
        if at > 0 and 0x21 <= data[at - 1] <= 0x7E:
            out.append(at)
    return (a.end(), b.end(), out[1], out[0]) if out[1] > a.end() else None


class Encoder:
    """Encoder with the chunk cache; one per worker and vocabulary. ``given``: ids that other partitions encoded, by chunk hash."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.core = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.sizes[i] = len(word)
        self.young: dict[bytes, Chunk | None] = {}
        self.old: dict[bytes, Chunk | None] = {}
        self.given: Given | None = None
        self.held = self.encoded = self.reused = self.received = 0

    def plain(self, data: bytes) -> np.ndarray:
        if not data:
            return np.zeros(0, np.int32)
        try:
            return np.frombuffer(self.core._core_bpe.encode_to_tiktoken_buffer(data.decode(), set()), np.uint32).astype(np.int32)
        except ValueError:  # the splitter's stack ends on runs of some 100,000 blanks; this one has none
            import regex

            return np.array([i for m in regex.finditer(PATTERN, data.decode()) for i in self.core._encode_single_piece(m[0])], np.int32)

    def made(self, data: bytes) -> Chunk | None:
        """The chunk, encoded here or given; None if it has too few borders."""
        places = borders(data)
        if places is None:
            return None
        first, second, last_but_one, last = places
        ids = self.given.ids(key_of(data)) if self.given else None
        if ids is not None and self.core.decode_bytes(ids.tolist()) == data[first:last]:
            self.received += 1
        else:
            self.encoded += 1
            ids = self.plain(data[first:last])
        ends = np.cumsum(self.sizes[ids])
        return Chunk(*places, ids, int(np.searchsorted(ends, second - first)) + 1, len(ids) - 1 - int(np.searchsorted(ends, last_but_one - first)))

    def chunk(self, data: bytes) -> Chunk | None:
        if data in self.young:
            self.reused += 1
            return self.young[data]
        if data in self.old:
            self.reused += 1
            entry = self.old[data]
        else:
            entry = self.made(data)
        if self.held + len(data) > CACHE_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[data] = entry
        self.held += len(data)
        return entry

    def document(self, data: bytes, cuts: list[int]) -> np.ndarray:
        out, pending, agreed = [], b"", np.zeros(0, np.int32)  # ``agreed``: what the encoding of ``pending`` must begin with
        for part in chunks_of(data, cuts):
            entry = self.chunk(part)
            if entry is None:
                pending = pending + part if len(pending) < LONGEST else self._long(pending, part)
                continue
            join = self.plain(bytes(pending) + part[: entry.second])
            if not (np.array_equal(join[: len(agreed)], agreed) and np.array_equal(join[len(join) - entry.n_first :], entry.ids[: entry.n_first])):
                return self.plain(data)
            inner = len(entry.ids) - entry.n_last
            out += [join, entry.ids[entry.n_first : inner]]
            pending, agreed = part[entry.last_but_one :], entry.ids[inner:]
        join = self.plain(bytes(pending))
        if not np.array_equal(join[: len(agreed)], agreed):
            return self.plain(data)
        out.append(join)
        return np.concatenate(out)

    @staticmethod
    def _long(pending, tail: bytes):
        """Long passages without a border grow in place."""
        pending = pending if isinstance(pending, bytearray) else bytearray(pending)
        pending += tail
        return pending


def chunks_of(data: bytes, cuts: list[int]) -> Iterator[bytes]:
    """The text between the cuts, in parts of at most LONGEST bytes that end at characters."""
    start = 0
    for end in (*cuts, len(data)):
        while start < end:
            stop = min(end, start + LONGEST)
            while stop < end and data[stop] & 0xC0 == 0x80:
                stop -= 1
            yield data[start:stop]
            start = stop


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def cut_slice(texts: pa.Array) -> Iterator[tuple[bytes, list[int]] | None]:
    """``(bytes, cuts)`` of each text of an Arrow string array, None for null and empty ones."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    body, starts = data.tobytes(), offsets - (offsets[0] if len(offsets) else 0)
    places = cut_places(data) if len(data) > WINDOW else np.zeros(0, np.int64)
    # The first WINDOW bytes of a document still see its predecessor: no cut there.
    low, high = np.searchsorted(places, starts[:-1] + WINDOW), np.searchsorted(places, starts[1:])
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(texts)):
        a, b = int(starts[i]), int(starts[i + 1])
        yield (body[a:b], (places[low[i] : high[i]] - a).tolist()) if valid[i] and b > a else None


def encode_slice(encoder: Encoder, texts: pa.Array) -> list[np.ndarray]:
    """Ids of each text."""
    return [np.zeros(0, np.int32) if x is None else encoder.document(*x) for x in cut_slice(texts)]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about SLICE_BYTES."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    borders_ = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else []
    return zip(borders_, borders_[1:])


def _texts(batches, column: int = 0) -> Iterator[pa.Array]:
    for b in batches:
        texts = b.column(column).cast(pa.large_binary())
        for i, j in _slices(texts):
            yield texts.slice(i, j - i)


class Given:
    """What a partition finds in its folder: hashes, and with them the ids of shared chunks."""

    def __init__(self, folder: str, partition: int):
        import pyarrow.parquet as pq

        fs, root = open_fs(f"{folder}/p={partition}")
        there = fs.get_file_info(root).is_file is False and fs.get_file_info(root).type.name == "Directory"
        self.table = pq.ParquetDataset(root, filesystem=fs, partitioning=None).read() if there else None
        self.at = {h: i for i, h in enumerate(self.table.column("h").to_pylist())} if there else {}
        self.codes = self.table.column("ids").combine_chunks() if there and "ids" in self.table.column_names else None

    def ids(self, key: int) -> np.ndarray | None:
        i = self.at.get(key)
        return None if i is None or self.codes is None else np.frombuffer(self.codes[i].as_buffer(), np.int32)


def chunk_keys(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """``p, h``: the different chunks of each partition, by hash."""

    def run(batches):
        keys: set[int] = set()  # 8 bytes for each KB of a partition's text
        for texts in _texts(batches):
            for x in cut_slice(texts):
                if x is not None:
                    keys.update(map(key_of, chunks_of(*x)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(keys), pa.int32()), pa.array(keys, pa.int64())], ["p", "h"])

    return documents.select(text_column).mapInArrow(run, "p int, h long")


def shared_chunks(documents: DataFrame, text_column: str, vocabulary, base: str) -> str:
    """Encode every chunk of several partitions once; gives the folder with what each partition gets."""
    keys = written(chunk_keys(documents, text_column), f"{base}/keys")
    shared = keys.groupBy("h").agg(F.min("p").alias("p"), F.count("*").alias("n")).where("n > 1").select("p", "h")
    shared.repartition("p").write.mode("overwrite").partitionBy("p").parquet(f"{base}/owned")

    def encode(batches):
        owned = Given(f"{base}/owned", TaskContext.get().partitionId()).at
        encoder = _encoder(vocabulary.value)
        encoder.given = None
        for texts in _texts(batches):
            out = []
            for x in cut_slice(texts):
                for part in chunks_of(*x) if x is not None and owned else ():
                    if owned.pop(h := key_of(part), None) is not None and (made := encoder.chunk(part)) is not None:
                        out.append((h, made.ids.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["h", "ids"])

    encoded = documents.select(text_column).mapInArrow(encode, "h long, ids binary")
    keys.join(encoded, "h").repartition("p").write.mode("overwrite").partitionBy("p").parquet(f"{base}/given")
    return f"{base}/given"


def token_ids(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_column, ids``: one row per document."""
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        words = spark.sparkContext.broadcast(f.read())  # the vocabulary file: its size is fixed
    folder = shared_chunks(documents, text_column, words, workspace(spark, "chunks"))

    def run(batches):
        encoder = _encoder(words.value)
        encoder.given = Given(folder, TaskContext.get().partitionId())
        for b in batches:
            key, texts = b.column(0), b.column(1).cast(pa.large_binary())
            for i, j in _slices(texts):
                ids = encode_slice(encoder, texts.slice(i, j - i))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([key.slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], [id_column, "ids"])

    kind = documents.select(id_column).schema[0].dataType.simpleString()
    return documents.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
