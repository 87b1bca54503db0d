"""Token-ID output: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a run of zstandard frames in document order, then a skippable frame with the document
directory, then the seek table in the public zstd seekable layout (skippable frame 0x184D2A5E;
for each frame its compressed size, its size and the low 32 bits of the XXH64 of its content;
footer with the frame count, a descriptor and 0x8F92EAB1). A frame's content is the token ids of
whole documents as little-endian unsigned 32-bit integers, so one document costs one frame to read.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; rows that share
a doc_id are ordered by a hash of the text, then the text; the string of a special token in a text is
its id, as the library has it; a text larger than ``frame_tokens`` has a frame of its own; an empty
table makes no file and an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dapple.llm.bytebpe import encoder
from dapple.llm.common import batch_rows, fresh_path, table, text_of

#: Fixed values of the public zstd seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_TOKENS = 1 << 16

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_frames int, n_bytes long"
DOCS = "doc_id long, at long, n_tokens long, ids_crc32 long"


def open_fs(path: str):
    """A pyarrow file system and the path within it; plain paths are local ones."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = path[5:]
        path = "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FrameWriter:
    def __init__(self, out, frame_tokens: int):
        import xxhash
        import zstandard

        self.out, self.frame_tokens, self.hash = out, frame_tokens, xxhash.xxh64_intdigest
        self.zip = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = self.n_bytes = 0
        self.ids: list[int] = []
        self.none: list[int] = []
        self.sizes: list[int] = []
        self.at: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held_bytes + len(ids) > 4 * self.frame_tokens:
            self.flush()
        self.ids.append(doc_id or 0)
        self.none.append(doc_id is None)
        self.sizes.append(len(ids) // 4)
        self.at.append(len(self.frames))
        self.held.append(ids)
        self.held_bytes += len(ids)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.zip(raw)
            self.frames.append((len(packed), len(raw), self.hash(raw) & 0xFFFFFFFF))
            self.put(packed)
            self.held, self.held_bytes = [], 0

    def finish(self) -> None:
        self.flush()
        index = self.zip(
            struct.pack("<I", len(self.ids))
            + np.asarray(self.ids, "<i8").tobytes()
            + np.asarray(self.none, "u1").tobytes()
            + np.asarray(self.sizes, "<u4").tobytes()
            + np.asarray(self.at, "<u4").tobytes()
        )
        self.put(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 4) + index + struct.pack("<I", len(index)))
        body = b"".join(struct.pack("<III", *f) for f in self.frames)
        body += struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.put(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(body)) + body)


class FrameReader:
    """Random access to a file of ``FrameWriter``: only the frames asked for are read."""

    def __init__(self, path: str):
        import xxhash
        import zstandard

        self.hash, self.unzip = xxhash.xxh64_intdigest, zstandard.ZstdDecompressor().decompress
        fs, inner = open_fs(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        n, flag, magic = struct.unpack("<IBI", self.read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table with checksums at its end")
        self.table = np.frombuffer(self.read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.begins = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        tail = size - 9 - 12 * n - 8
        (packed,) = struct.unpack("<I", self.read(tail - 4, 4))
        index = self.unzip(self.read(tail - 4 - packed, packed))
        (m,) = struct.unpack("<I", index[:4])
        self.ids = np.frombuffer(index, "<i8", m, 4)
        self.none = np.frombuffer(index, "u1", m, 4 + 8 * m).astype(bool)
        self.sizes = np.frombuffer(index, "<u4", m, 4 + 9 * m).astype(np.int64)
        self.frame_of = np.frombuffer(index, "<u4", m, 4 + 13 * m)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        raw = self.unzip(self.read(int(self.begins[k]), int(self.table[k, 0])))
        if len(raw) != self.table[k, 1] or self.hash(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def tokens(self, row: int) -> np.ndarray:
        """The ids of the document in place ``row`` of the file."""
        k = self.frame_of[row]
        first = int(np.searchsorted(self.frame_of, k))
        begin = int(self.sizes[first:row].sum())
        return np.frombuffer(self.frame(int(k)), "<u4", int(self.sizes[row]), 4 * begin)

    def rows_of(self, doc_id: int) -> np.ndarray:
        return np.flatnonzero((self.ids == doc_id) & ~self.none)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame_tokens: int = FRAME_TOKENS
) -> DataFrame:
    """Encode ``docs`` into files under ``folder``, doc_id ascending through the files; their manifest.

    One range shuffle of the rows; a task then encodes and writes its own range, so ids are
    never shuffled. A task that is run again writes the same bytes under a name of its own first.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, n = TaskContext.get().partitionId(), None, 0
        fs = out = None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer, end_id).encode(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    fs, inner = open_fs(folder)
                    fs.create_dir(inner, recursive=True)
                    name, own = f"{inner}/part-{part:05d}.tok", f"{inner}/_{part:05d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(own)
                    writer = FrameWriter(out, frame_tokens)
                n += len(ids) // 4
                writer.add(doc_id, ids)
        if writer is not None:
            writer.finish()
            out.close()
            fs.move(own, name)
            row = {
                "part": [part], "path": [f"{folder}/part-{part:05d}.tok"], "n_docs": [len(writer.ids)],
                "n_tokens": [n], "n_frames": [len(writer.frames)], "n_bytes": [writer.n_bytes],
            }
            yield pa.RecordBatch.from_pydict(row, MANIFEST_SCHEMA)

    batch_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # equal or null ids, and equal rows, may still be dealt to several tasks
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    ordered = rows.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "text", "n")
    manifest = ordered.select("doc_id", "text").mapInArrow(encode, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


MANIFEST_SCHEMA = pa.schema(
    [("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_frames", pa.int32()), ("n_bytes", pa.int64())]
)
DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, each frame checked.

    ``start`` adds the tokens of all earlier files, a running sum over one row a file.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = FrameReader(path)
                starts = base + np.concatenate([[0], np.cumsum(r.sizes)[:-1]])
                edges = np.flatnonzero(np.diff(r.frame_of, prepend=-1))
                for k, (a, b) in enumerate(zip(edges, [*edges[1:], len(r.ids)], strict=True)):
                    raw, begin, crcs = memoryview(r.frame(k)), 0, []
                    for size in r.sizes[a:b].tolist():
                        crcs.append(zlib.crc32(raw[begin : begin + 4 * size]))
                        begin += 4 * size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.ids[a:b], pa.int64(), mask=r.none[a:b]), pa.array(starts[a:b]), pa.array(r.sizes[a:b]), pa.array(crcs, pa.int64())],
                        schema=DOC_SCHEMA,
                    )

    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(read, DOCS).withColumnRenamed("at", "start")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, folder, str(tokenizer or public_tokenizer())))


def op4_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and write all documents, then read every one back from the files."""
    return token_output(table(spark, sf_dir, "documents"))
