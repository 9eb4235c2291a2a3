"""Token ids as length-delimited binary records with a separate offset index.

A record is: payload length (8 bytes), its masked CRC-32C (4), the payload, the
payload's masked CRC-32C (4), all little-endian, as in TFRecord files. The payload is
doc_id (8 bytes), flags (1: the doc_id is null), bytes per id, 2 bytes of zero, number of
ids (4), then the ids.

Every task writes files of its own, named by its attempt, in the shared folder, and
returns an index row for each record; the index is a Parquet table beside the files.
As only an attempt that Spark commits gets its rows into the index, a lost or repeated task
leaves at most a file that nothing refers to, and such files are removed at the end.
With the index a reader can fetch records in any order (:func:`read`); it names files by whole
paths, and the records stay until someone deletes their folder.

Defined cases: a null text is an empty sequence; repeated rows give a record each;
doc_id is an integer or null; an empty table gives an empty index; extra columns don't
matter. Whole texts are encoded.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Encoder
from .common import pick, qualified, remove, shared_dir
from .crc32c import crc32c, masked

_HEAD = struct.Struct("<qBBHI")
HEAD_BYTES = _HEAD.size
INDEX = "doc_id long, file string, offset long, length long, n_tokens int"
BATCH_BYTES = 8 << 20


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The framed records in one string, and where each begins (one more at the end)."""
    size = np.array([len(p) for p in payloads], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    crc = masked(crc32c(np.frombuffer(b"".join(payloads), dtype=np.uint8), ends))
    lengths = np.frombuffer(size.astype("<u8").tobytes(), dtype=np.uint8)
    length_crc = masked(crc32c(lengths, np.arange(len(size) + 1) * 8))
    heads = np.rec.fromarrays([size.astype("<u8"), length_crc.astype("<u4")], dtype=[("n", "<u8"), ("c", "<u4")])
    raw, tails = heads.tobytes(), crc.astype("<u4").tobytes()
    parts = [x for i, p in enumerate(payloads) for x in (raw[12 * i : 12 * i + 12], p, tails[4 * i : 4 * i + 4])]
    return b"".join(parts), ends + 16 * np.arange(len(ends))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is None, width, 0, len(ids) // width) + ids


def unframe(raw: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one record; ValueError if a checksum doesn't fit."""
    n = int.from_bytes(raw[:8], "little")
    for at, size in ((0, 8), (12, n)):
        part = np.frombuffer(raw, dtype=np.uint8)[at : at + size]
        if len(part) < size or masked(crc32c(part, np.array([0, size])))[0] != int.from_bytes(raw[at + size : at + size + 4], "little"):
            raise ValueError("damaged record")
    doc_id, null, width, _, count = _HEAD.unpack_from(raw, 12)
    return None if null else doc_id, np.frombuffer(raw, dtype=f"<u{width}", count=count, offset=12 + _HEAD.size)


def _writer(folder: str, vocabulary: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder}/tokens-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.bin"
        encoder = None

        def flush(docs: list, payloads: list[bytes]) -> pa.RecordBatch:
            nonlocal at
            raw, begins = frame(payloads)
            out.write(raw)
            width = encoder.dtype.itemsize
            columns = [pa.array(docs, pa.int64()), pa.array([name] * len(docs)), pa.array(begins[:-1] + at), pa.array(np.diff(begins)), pa.array([(len(p) - HEAD_BYTES) // width for p in payloads], pa.int32())]
            at += len(raw)
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "offset", "length", "n_tokens"])

        for b in batches:
            docs, payloads, held = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None:
                    system, path = fs.FileSystem.from_uri(name)
                    out, encoder = system.open_output_stream(path), Encoder(vocabulary)
                docs.append(doc)
                payloads.append(payload(doc, encoder.encode(text.as_py() or ""), encoder.dtype.itemsize))
                held += len(payloads[-1])
                if held > BATCH_BYTES:
                    yield flush(docs, payloads)
                    docs, payloads, held = [], [], 0
            if docs:
                yield flush(docs, payloads)
        if out is not None:
            out.close()

    return write


def write(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes all records below ``folder`` (a new one of the shared folder by default) and returns the
    index: doc_id, file, offset, length, n_tokens."""
    spark = docs.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex[:12]}")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    d.mapInArrow(_writer(folder, vocabulary), INDEX).write.parquet(f"{folder}/index")
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    kept = {r[0] for r in index.select("file").distinct().toLocalIterator()}
    for status in system.listStatus(at):
        name = f"{folder}/{status.getPath().getName()}"
        if name.endswith(".bin") and name not in kept:
            remove(spark, name)
    return index


def read(index: DataFrame) -> DataFrame:
    """(doc_id, ids) of the records that ``index`` lists, in its order; checksums are verified."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            docs, ids = [], []
            for name, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if name not in opened:
                    system, path = fs.FileSystem.from_uri(name)
                    opened[name] = system.open_input_file(path)
                doc, found = unframe(opened[name].read_at(length, offset))
                docs.append(doc)
                ids.append(found.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return index.select("file", "offset", "length").mapInArrow(fetch, "doc_id long, ids array<int>")
