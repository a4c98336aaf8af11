"""Token ids as length-delimited binary records.

A file holds records one after another, all numbers little-endian:

    length of the payload, 8 bytes | masked checksum of these 8 bytes, 4 bytes
    payload: document id, 8 bytes, bytes of a token id, 1 byte, with 128 added where the
             document has no id, then the token ids, 2 bytes each where the vocabulary has at
             most 65,536, else 4
    masked checksum of the payload, 4 bytes

The checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum over
bytes that hold checksums stays meaningful. Beside each file lies an index with one entry
for each record, 24 bytes: offset of the record, number of ids, document id (0 where there is none); a shuffled
reader seeks by it. Files are written under a name of their own attempt and become part of
the data only by their row in the manifest, so a task that is lost or run twice is harmless.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline.llm import chunks
from thermoline.llm import textkit as tk
from thermoline.llm.workspace import shared_folder, stored

MASK_DELTA = 0xA282EAD8
END_ID = 2
HEAD = 12
INDEX = np.dtype([("offset", "<i8"), ("n_tokens", "<i8"), ("doc_id", "<i8")])
MANIFEST = "part int, path string, n_records long, n_tokens long, n_bytes long"
ROWS_PER_FILE = 20_000
NO_ID = 0x80
#: Known chunks of an encoder, about 80 bytes each.
CHUNKS_KEPT = 1_500_000


def masked(raw: bytes | memoryview) -> int:
    crc = zlib.crc32(raw)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: np.dtype) -> bytes:
    payload = np.int64(doc_id or 0).tobytes() + bytes([width.itemsize | (NO_ID if doc_id is None else 0)]) + ids.astype(width).tobytes()
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(raw: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """Document id, token ids and the end of the record at `at`; a damaged one is an error."""
    head, size = raw[at : at + 8], int.from_bytes(raw[at : at + 8], "little")
    if masked(head) != int.from_bytes(raw[at + 8 : at + HEAD], "little"):
        raise ValueError(f"damaged length at {at}")
    payload = raw[at + HEAD : at + HEAD + size]
    end = at + HEAD + size + 4
    if len(payload) < size or masked(payload) != int.from_bytes(raw[end - 4 : end], "little"):
        raise ValueError(f"damaged payload at {at}")
    doc_id = None if payload[8] & NO_ID else int.from_bytes(payload[:8], "little", signed=True)
    return doc_id, np.frombuffer(payload[9:], f"<u{payload[8] & ~NO_ID}").astype("<u4"), end


class ChunkEncoder:
    """Encodes texts by a byte-level BPE file of the tokenizers library, each distinct chunk once.

    Ids of a chunk are looked up by its bytes; CHUNKS_KEPT chunks, and those of one slice
    more, stay known for later slices.
    """

    def __init__(self, path: str):
        self.pairs = chunks.BytePairs(path)
        self.width = np.dtype("<u2") if len(self.pairs.bytes_of) <= 1 << 16 else np.dtype("<u4")
        self.known, self.ids = chunks.Numbered(CHUNKS_KEPT), chunks.Lists()

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text."""
        docs = len(off) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(docs, np.int64)
        if self.known.full():
            self.known, self.ids = chunks.Numbered(CHUNKS_KEPT), chunks.Lists()
        cut = chunks.cuts(data)
        cut[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(cut)
        which, new = self.known.of(data, start, len(data))
        self.ids.add(*self.pairs.encode(new))
        doc = np.searchsorted(off, start, "right") - 1
        return self.ids.take(which), np.bincount(doc, self.ids.size[which], minlength=docs).astype(np.int64)


_encoders: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """One encoder a Python worker: what it knows serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts in ascending id order; returns the manifest, one row for each file.

    Rows are dealt by ranges of id, then hash of the text, then place in the input, so file k
    holds no larger ids than file k + 1, and rows of one id may fill many files; of one id
    they are in the order of the hashes. A null text is an empty one, and a null id comes first;
    an empty table gives an empty manifest; repeated rows are a record each; other columns don't
    matter. A text longer than a slice is encoded by itself. Each document ends with id 2.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.select(id_col).count() // ROWS_PER_FILE))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, out, index, at, tokens, name = None, None, [], 0, 0, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for some in tk.slices(batch, "text", 2 << 20):
                if out is None:
                    encoder = encoder_of(tokenizer_path)
                    fs, path = pafs.FileSystem.from_uri(name)
                    fs.create_dir(os.path.dirname(path), recursive=True)
                    out = fs.open_output_stream(f"{path}.rec")
                ids, sizes = encoder.encode(*tk.utf8(some.column("text")))
                ends, frames = np.cumsum(sizes), []
                for doc_id, end, size in zip(some.column("doc_id").to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
                    frames.append(frame(doc_id, np.append(ids[end - size : end], END_ID), encoder.width))
                    index.append((at, size + 1, doc_id or 0))
                    at += len(frames[-1])
                out.write(b"".join(frames))
                tokens += int(ends[-1]) + len(sizes)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{path}.idx") as beside:
                beside.write(np.array(index, INDEX).tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "n_records": [len(index)], "n_tokens": [tokens], "n_bytes": [at]})

    order = ("doc_id", "hash", "place")
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return stored(dealt.select("doc_id", "text").mapInArrow(written, MANIFEST), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Per record, read back and checked: id, place of its first id in the whole, number and checksum of its ids."""
    starts = manifest.selectExpr("path", "n_bytes", "sum(n_tokens) OVER (ORDER BY part) - n_tokens AS start")  # one row for each file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["path"])
                with fs.open_input_stream(f"{path}.idx") as beside:
                    index = np.frombuffer(beside.read(), INDEX)
                first = row["start"]
                with fs.open_input_file(f"{path}.rec") as file:
                    for k in range(0, len(index), 2000):
                        some = index[k : k + 2000]
                        at = int(some["offset"][0])
                        to = int(index["offset"][k + 2000]) if k + 2000 < len(index) else row["n_bytes"]
                        raw, got = memoryview(file.read_at(to - at, at)), []
                        for place in (some["offset"] - at).tolist():
                            doc_id, ids, _ = unframe(raw, place)
                            got.append((doc_id, first, len(ids), zlib.crc32(ids)))
                            first += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return starts.repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shuffled_ids(spark: SparkSession, manifest: DataFrame, seed: int) -> DataFrame:
    """Every record of the files in an order drawn by `seed`: the index says where each lies, so a record is one seek."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(f"{at}.idx") as beside:
                    index = np.frombuffer(beside.read(), INDEX)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(index), pa.string()), "at": index["offset"]})

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for row in batch.to_pylist():
                fs, at = pafs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(f"{at}.rec") as file:
                    size = int.from_bytes(file.read_at(8, row["at"]), "little")
                    doc_id, ids, _ = unframe(memoryview(file.read_at(HEAD + size + 4, row["at"])), 0)
                got.append({"doc_id": doc_id, "place": row["place"], "ids": ids.tolist()})
            yield pa.RecordBatch.from_pylist(got, pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    places = manifest.select("path").mapInArrow(entries, "path string, at long").withColumn("place", F.xxhash64(F.lit(seed), "path", "at"))
    return places.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(fetched, schema)


def records_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/records"


def total_tokens(manifest: DataFrame) -> int:
    return manifest.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
