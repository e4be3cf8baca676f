"""Token ids in compressed binary files.

A shard holds documents of one range of ids, and ends when its frames reach a
size. Each document's id array (little-endian unsigned 32-bit) is a Zstandard
frame of its own, made with a dictionary that all shards share and that was
trained on serialized id arrays. A shard is

    magic, SHA-256 of the dictionary, frames one after another,
    index (doc_id, whether it is null, offset, size, number of ids),
    number of documents, magic

so one document is read by one seek. The dictionary lies beside the shards.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm.batches import held, map_batches
from tracewright.session import scratch_dir

MAGIC = b"TWIDS002"
INDEX = np.dtype([("doc_id", "<i8"), ("no_id", "<u1"), ("offset", "<u8"), ("size", "<u8"), ("n_ids", "<u8")])
_CHUNK = re.compile(r"[^ \t-\r]+")
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: Runs of Latin letters, and of what else isn't white space: a token never spans both, but for apostrophes.
_RUN = re.compile(rf"[{_LETTERS}]+|[^ \t-\r{_LETTERS}]+")
_NOT_PLAIN = re.compile(rf"[^\x00-\x1b\x20-\x26\x28-\x7f{_LETTERS}]")


class _Places(dict):
    """Gives every unit the next place when it is first asked for."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        place = self[unit] = len(self)
        self.new.append(unit)
        return place


class Encoder:
    """Ids of texts by the library; remembers up to ``remembered`` units of text.

    Holds for vocabularies that lower-case and drop white space: no token spans
    a unit's ends. Units are runs of letters and of other characters in texts
    of Latin letters without apostrophes or combining marks, and chunks between
    ASCII white space in other texts.
    """

    def __init__(self, tokenizer_json: bytes, remembered: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt the cores out
        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.remembered, self.known, self.table = remembered, _Places(), []
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, marks))) if marks else None

    def units(self, text: str) -> list[str] | None:
        """The text's units; None if special tokens are to be found in it."""
        if self.special is not None and self.special.search(text):
            return None
        if _NOT_PLAIN.search(text):
            return _CHUNK.findall(text)
        return _RUN.findall(text.lower())

    def ids(self, texts: list[str]) -> list[bytes]:
        lists = [self.units(t) for t in texts]
        places = [None if us is None else list(map(self.known.__getitem__, us)) for us in lists]
        new, first = self.known.new, len(self.table)
        self.table += [b""] * len(new)
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000], first + i)
        self.known.new, table = [], self.table
        if len(table) > self.remembered:
            # what was met first is met most often: the first half stays
            half = self.remembered // 2
            self.known, self.table = _Places({u: k for u, k in self.known.items() if k < half}), table[:half]
        return [self.plain(t) if at is None else b"".join(map(table.__getitem__, at)) for t, at in zip(texts, places, strict=True)]

    def learn(self, units: list[str], first: int) -> None:
        """Fill the table from ``first`` on. Runs of letters are one pre-token each and go to the library as one text; the rest one by one."""
        alone = [k for k, u in enumerate(units) if not (u.isalpha() and u.islower())]
        out = [""] * len(alone)
        for i, k in enumerate(alone):
            out[i], units[k] = units[k], "a"  # a run of letters in its place, whose ids are written over
        e = self.tokenizer.encode(" ".join(units), add_special_tokens=False)
        ends = np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(units) + 1))
        data, at = np.array(e.ids, dtype="<u4").tobytes(), (4 * ends).tolist()
        self.table[first : first + len(units)] = [data[a:b] for a, b in zip(at, at[1:])]
        for k, e in zip(alone, self.tokenizer.encode_batch_fast(out, add_special_tokens=False), strict=True):
            self.table[first + k] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def encoder(tokenizer_json: bytes) -> Encoder:
    return held(("encoder", hash(tokenizer_json)), lambda: Encoder(tokenizer_json))


def train_dictionary(samples: list[bytes], size: int = 65_536) -> zstandard.ZstdCompressionDict:
    """A dictionary of the samples; too few to train on: their ends as raw content."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or MAGIC, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Shard:
    """Reads a shard; ``document`` decompresses one alone."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a shard of token ids")
        if data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        (n,) = struct.unpack("<Q", data[-16:-8])
        self.data = data
        self.index = np.frombuffer(data, INDEX, n, len(data) - 16 - n * INDEX.itemsize)
        self.reader = zstandard.ZstdDecompressor(dict_data=load(dictionary))

    def document(self, k: int) -> bytes:
        row = self.index[k]
        frame = self.data[int(row["offset"]) : int(row["offset"]) + int(row["size"])]
        return self.reader.decompress(frame, max_output_size=int(row["n_ids"]) * 4)


def load(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(dictionary)


def put(path: str, parts: list[bytes]) -> None:
    """Write beside the place, then move: a task that is run again leaves no half file."""
    store, at = fs.FileSystem.from_uri(path)
    beside = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(beside) as out:
        for p in parts:
            out.write(p)
    store.move(beside, at)


class ShardWriter:
    """Writes frames as they come and keeps the index alone; the file gets its name when it is whole."""

    def __init__(self, path: str, dictionary: bytes):
        self.path, self.index, self.ids = path, [], 0
        self.store, self.at = fs.FileSystem.from_uri(path)
        self.out = self.store.open_output_stream(f"{self.at}.part")
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.end = 40

    def add(self, doc_id: int | None, frame: bytes, n_ids: int) -> None:
        self.out.write(frame)
        self.index.append((doc_id or 0, doc_id is None, self.end, len(frame), n_ids))
        self.end += len(frame)
        self.ids += n_ids

    def close(self) -> None:
        self.out.write(np.array(self.index, INDEX).tobytes() + struct.pack("<Q", len(self.index)) + MAGIC)
        self.out.close()
        self.store.move(f"{self.at}.part", self.at)


def get(path: str) -> bytes:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def as_uri(path: str) -> str:
    return path if re.match(r"\w+:/", path) else f"file://{path}"


def size_and_sample(rows: DataFrame, n: int, sample: int, longest: int) -> tuple[int, list[str]]:
    """Bytes of all ``n`` texts, and about ``sample`` whole texts of up to ``longest`` bytes, chosen by a hash, in one pass."""
    chosen = (F.pmod(F.xxhash64("doc_id", "salt"), F.lit(n)) < sample) & (F.octet_length("text") <= longest)
    return tuple(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.collect_list(F.when(chosen, F.col("text")))).first())


def write_token_files(
    docs: DataFrame, tokenizer_json: bytes, folder: str, end_id: int = 2, level: int = 3, sample: int = 1500, longest: int = 1 << 14, range_bytes: int = 512 << 20, shard_bytes: int = 32 << 20
) -> list[tuple[str, int, int]]:
    """Write the shards; return (path, documents, ids) of each, in the order of doc_id.

    Rows are dealt into ranges of doc_id and a hash of text, of about
    ``range_bytes`` of text or less, so a doc_id of very many rows (or null)
    is split too and no task depends on how rows are spread over sources. A
    shard ends at ``shard_bytes`` of frames; frames go to the file as they
    come. The dictionary is trained on about ``sample`` whole texts of up to
    ``longest`` bytes (long ones gain little by it); it affects sizes only. Null and empty texts are documents of the end id alone; rows without
    doc_id come first, then the smallest, also negative ones; repeated rows
    are kept, in the order of their texts' hashes.
    """
    spark, folder = docs.sparkSession, as_uri(folder)
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("salt", F.xxhash64("text"))
    n = rows.count()  # of Parquet from its footers
    if not n:
        return []
    total, texts = size_and_sample(rows, n, sample, longest)
    dictionary = train_dictionary([x for x in encoder(tokenizer_json).ids(texts) if x]).as_bytes()
    put(f"{folder}/dictionary.zstd", [dictionary])
    told, end = spark.sparkContext.broadcast((tokenizer_json, dictionary)), struct.pack("<I", end_id)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shared = told.value
        compressor = zstandard.ZstdCompressor(level=level, dict_data=load(shared), write_content_size=True)
        part, made, shard = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            shard.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([made], pa.int32()), "path": [shard.path], "n_docs": [len(shard.index)], "n_ids": [shard.ids]})

        for batch in batches:
            for i, own in zip(batch.column("doc_id").to_pylist(), encoder(words).ids(batch.column("text").to_pylist()), strict=True):
                shard = shard or ShardWriter(f"{folder}/part-{part:07d}-{made:05d}-{uuid.uuid4().hex[:8]}.ids", shared)
                shard.add(i, compressor.compress(own + end), len(own) // 4 + 1)
                if shard.end >= shard_bytes:
                    yield closed()
                    shard, made = None, made + 1
        if shard:
            yield closed()

    dealt = rows.repartitionByRange(parts, "doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "text")
    shards = dealt.mapInArrow(write, "part int, number int, path string, n_docs long, n_ids long").collect()  # a row for each shard
    return [(r.path, r.n_docs, r.n_ids) for r in sorted(shards, key=lambda r: (r.part, r.number))]


def read_token_files(spark, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """Per document, from the files: where its ids start among all, how many they are, and their CRC-32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    folder, base, listed = as_uri(folder), 0, []
    for path, _, n_ids in shards:
        listed.append((path, base))
        base += n_ids

    def read(batch: pa.RecordBatch) -> dict:
        dictionary = get(f"{folder}/dictionary.zstd")
        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
        for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            shard = Shard(get(path), dictionary)
            sizes = shard.index["n_ids"].astype(np.int64)
            out["doc_id"] += [None if none else i for i, none in zip(shard.index["doc_id"].tolist(), shard.index["no_id"].tolist(), strict=True)]
            out["start"] += (start + np.cumsum(sizes) - sizes).tolist()
            out["n_tokens"] += sizes.tolist()
            out["ids_crc32"] += [zlib.crc32(shard.document(k)) for k in range(len(sizes))]
        return out

    files = spark.createDataFrame(listed, "path string, base long").repartition(min(len(listed), 100_000))
    return map_batches(files, read, schema)


def token_files(docs: DataFrame, tokenizer_json: bytes, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files (by default into the shared scratch folder) and read them back."""
    folder = folder or f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, tokenizer_json, folder, end_id))
