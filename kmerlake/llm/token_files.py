"""Token ids as shard files of separately compressed documents.

A shard file is, in order:

    8 bytes   magic b"KLTOKEN1"
    u32 u32   width of an id in bytes (2 or 4), number of documents
    16 bytes  hash of the dictionary (blake2b, 16 bytes); zeros without one
    u64 each  offset index: where each document's frame begins, and where the last ends
    u32 each  number of ids of each document
    frames    one zstandard frame per document: its ids, little-endian, by the shared dictionary

All numbers are little-endian; offsets count from the file's start. One document is read
by its two offsets alone. The dictionary lies beside the shards as `dictionary-<hash>`.
It is trained on a bounded sample of serialized id arrays of short documents; without
enough of them there is none and frames are plain.

Documents lie in ascending doc_id order (null first; repeated ids by number of ids,
checksum and bytes) over the shards in ascending order. A task writes its shard under a name of its
own attempt; the table of shards, written once and read back, says which files count.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bpe, shared, spans

MAGIC = b"KLTOKEN1"
HEADER = struct.Struct("<8sII16s")
END_ID = 0
#: The dictionary is trained on at most so many documents of at most so many characters.
SAMPLE_DOCUMENTS = 2000
SAMPLE_CHARS = 4000
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 32 << 20
LEVEL = 3


def ids_of(batch_texts: pa.Array, path: str) -> Iterator[tuple[int, list[bytes]]]:
    """(start, ids) of runs of texts: ids of each text and the end id, as little-endian unsigned 32-bit bytes."""
    tool = bpe.encoder(path)
    end = np.array([END_ID], dtype="<u4").tobytes()
    for start, part in bpe.text_runs(batch_texts.to_pylist()):
        yield start, [x + end for x in tool.encode(part)]


def narrowed(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, path: str, width: int, documents: int = SAMPLE_DOCUMENTS) -> bytes:
    """A zstandard dictionary, or nothing if there is too little to learn from."""
    import zstandard

    short = docs.filter((F.length("text") <= SAMPLE_CHARS) & (F.length("text") > 0))
    n = short.count()
    if not n:
        return b""
    number = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def serialized(batches):
        for batch in batches:
            for start, ids in ids_of(batch.column(1), path):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), pa.array([narrowed(x, width) for x in ids], pa.binary())], names=["doc_id", "ids"])

    # twice as many on average; of these the least hashes are taken
    drawn = short.withColumn("draw", number).filter(F.col("draw") < min(1.0, 2 * documents / n)).orderBy("draw", "doc_id").limit(documents)
    rows = drawn.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(serialized, "doc_id long, ids binary").collect()
    sample = [bytes(x[1]) for x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    if len(sample) < 16 or sum(map(len, sample)) < 4 * 1024:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, sample)) // 8)
    try:
        return zstandard.train_dictionary(max(256, size), sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.blake2b(dictionary, digest_size=16).digest() if dictionary else bytes(16)


def pack_shard(frames: list[bytes], counts: list[int], width: int, dictionary: bytes) -> bytes:
    start = HEADER.size + 8 * (len(frames) + 1) + 4 * len(frames)
    at = start + np.concatenate([[0], np.cumsum([len(x) for x in frames])]).astype("<u8")
    head = HEADER.pack(MAGIC, width, len(frames), dictionary_hash(dictionary))
    return b"".join([head, at.astype("<u8").tobytes(), np.array(counts, dtype="<u4").tobytes(), *frames])


class ShardReader:
    """Documents of an open shard file (anything with read and seek), by their place."""

    def __init__(self, file, dictionary: bytes = b""):
        import zstandard

        self.file = file
        magic, self.width, self.size, key = HEADER.unpack(self._read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if key != dictionary_hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.offsets = np.frombuffer(self._read(HEADER.size, 8 * (self.size + 1)), dtype="<u8").tolist()
        self.counts = np.frombuffer(self._read(HEADER.size + 8 * (self.size + 1), 4 * self.size), dtype="<u4").tolist()
        shared_dictionary = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.tool = zstandard.ZstdDecompressor(dict_data=shared_dictionary)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def document(self, i: int) -> np.ndarray:
        raw = self.tool.decompress(self._read(self.offsets[i], self.offsets[i + 1] - self.offsets[i]), max_output_size=self.counts[i] * self.width)
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")


def width_for(path: str) -> int:
    """Bytes that hold every id of a tokenizer."""
    return 2 if bpe.encoder(path).largest < 1 << 16 else 4


def write_shards(docs: DataFrame, folder: str, path: str, width: int | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Writes the shards of docs (doc_id, text) into folder. width is what the tokenizer's ids need unless given.

    Returns the table (shard, file, doc_ids binary, counts binary, total long) of what
    counts, and the dictionary's file name ("" without one).
    """
    import zstandard

    spark = docs.sparkSession
    width = width or width_for(path)
    if width < width_for(path):
        raise ValueError(f"the tokenizer has ids that {width} bytes cannot hold")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, path, width)
    name = f"dictionary-{dictionary_hash(dictionary).hex()}" if dictionary else ""
    if dictionary:
        system, where = shared.file_system(f"{folder}/{name}")
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(where) as out:
            out.write(dictionary)
    sent = spark.sparkContext.broadcast(dictionary)

    def encode(batches):
        shared_dictionary = zstandard.ZstdCompressionDict(sent.value) if sent.value else None
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared_dictionary, write_checksum=False)
        for batch in batches:
            for start, ids in ids_of(batch.column(1), path):
                frames = [tool.compress(narrowed(x, width)) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "n", "frame"])

    encoded = shared.written(docs.mapInArrow(encode, "doc_id long, n long, frame binary"), f"{folder}/frames")
    size = encoded.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    shards = max(1, int(size // shard_bytes) + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // (1 << 20))))
    # what follows doc_id lets shards split the rows of one repeated id
    order = ["doc_id", "n", "sum"]
    ordered = encoded.withColumn("sum", F.crc32("frame")).repartitionByRange(shards, *order).sortWithinPartitions(*order, "frame").drop("sum")

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        ids, counts, frames = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            frames += batch.column(2).to_pylist()
        if not frames:
            return
        target = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        system, where = shared.file_system(target)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(where) as out:
            out.write(pack_shard(frames, counts, width, sent.value))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()),
                pa.array([target]),
                pa.array([np.array([0 if x is None else x for x in ids], dtype="<i8").tobytes()], pa.binary()),
                pa.array([np.array([x is None for x in ids]).tobytes()], pa.binary()),
                pa.array([sum(counts)], pa.int64()),
            ],
            names=["shard", "file", "doc_ids", "missing", "total"],
        )

    table = ordered.mapInArrow(write, "shard int, file string, doc_ids binary, missing binary, total long")
    table = shared.written(table, f"{folder}/shards")
    shared.remove(spark, f"{folder}/frames")
    return table, name


def read_shards(shards: DataFrame, folder: str, dictionary_name: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document in the files."""
    # shards are one row each; ranges of a thousand are summed first, so no task orders all of them
    span = F.floor(F.col("shard") / 1000).alias("span")
    wide = shards.groupBy(span).agg(F.sum("total").alias("in_span"))
    before = lambda what, over: F.coalesce(F.sum(what).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = wide.select("span", before("in_span", Window.orderBy("span")).alias("earlier"))
    within = before("total", Window.partitionBy(span).orderBy("shard"))
    placed = shards.select("shard", "file", "doc_ids", "missing", span, within.alias("begin")).join(wide, "span")

    def read(batches):
        dictionary = b""
        if dictionary_name:
            system, where = shared.file_system(f"{folder}/{dictionary_name}")
            with system.open_input_stream(where) as file:
                dictionary = file.read()
        for batch in batches:
            for begin, name, ids, missing in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                system, where = shared.file_system(name)
                with system.open_input_file(where) as file:
                    reader = ShardReader(file, dictionary)
                    ids = np.ma.array(np.frombuffer(ids, dtype="<i8"), mask=np.frombuffer(missing, dtype=bool)).tolist()
                    for low in range(0, reader.size, 2000):
                        part = range(low, min(low + 2000, reader.size))
                        found = [reader.document(i).tobytes() for i in part]
                        counts = [len(x) // 4 for x in found]
                        first = begin + np.concatenate([[0], np.cumsum(counts)[:-1]])
                        begin += sum(counts)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[low : low + len(found)], pa.int64()), pa.array(first.astype(np.int64)), pa.array(counts, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    rows = placed.select((F.col("earlier") + F.col("begin")).cast("long").alias("begin"), "file", "doc_ids", "missing").repartition(max(1, shards.count()), "file")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that were written."""
    folder = shared.new_folder(docs.sparkSession, "token-files")
    shards, name = write_shards(docs, folder, path)
    return read_shards(shards, folder, name).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
