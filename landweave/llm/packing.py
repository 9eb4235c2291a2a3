"""Best-fit packing of token sequences into bins of a fixed number of tokens.

Bounded-space online best fit: a sequence goes into the open bin that it fills most.
Open bins are found by their free space in a bitset, so a search is one shift and
the lowest set bit. If none has room and ``open_bins`` are open, the fullest closes
and a new one opens.

A sequence is a text's ids of the byte-level vocabulary and an end mark, the first id that the
vocabulary leaves free. A longer one than a bin is cut into full bins and a rest; no token is
lost. Sequences are packed in STREAMS streams by a hash of doc_id and text, each in the
order of doc_id, one after another as they come from a sorted shuffle. What is open at the end
of the streams, at most STREAMS * ``open_bins`` bins, is packed once more in the same way,
bin by bin into bins, so that streams of few documents leave no gaps. Neither the
number of rows nor how they are partitioned decides anything.

The result has the pieces with their ids: those of a bin, by offset, are a packed record
(:func:`sequences`), those of a document, by piece, its sequence (:func:`unpacked`).

Defined cases: a null or empty text is its end mark alone; repeated rows are packed each; null
doc_ids come last in their stream; an empty table gives an empty result; extra columns
don't matter. Texts of any length are encoded and packed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Encoder
from .common import pick, stash

CAPACITY = 8192
OPEN_BINS = 64
STREAMS = 1024
ROWS_OUT = 1024


class Packer:
    """Packs lengths one after another; bins are numbered in the order of opening."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self._free = 0  # bit f: a bin with f tokens free is open
        self._by_free: dict[int, list[int]] = {}
        self._open = self.bins = 0

    def _take(self, free: int) -> int:
        held = self._by_free[free]
        number = held.pop()
        if not held:
            del self._by_free[free]
            self._free ^= 1 << free
        return number

    def put(self, length: int) -> tuple[int, int]:
        """The bin of a sequence of 1 to capacity tokens and its offset in it."""
        fits = self._free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self._open == self.open_bins:
                self._take((self._free & -self._free).bit_length() - 1)
                self._open -= 1
            number, free = self.bins, self.capacity
            self.bins += 1
            self._open += 1
        left = free - length
        if left:
            self._by_free.setdefault(left, []).append(number)
            self._free |= 1 << left
        else:
            self._open -= 1
        return number, self.capacity - free

    def unclosed(self) -> list[tuple[int, int]]:
        """Number and filled length of the bins that are open, by number."""
        return sorted((number, self.capacity - free) for free, held in self._by_free.items() for number in held)


def tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, body, ids): the sequence of each document, its ids little-endian; body is the text's hash."""
    d = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("body"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        end = np.array([encoder.end], dtype=encoder.dtype).tobytes()
        for b in batches:
            for i in range(0, b.num_rows, ROWS_OUT):
                some = b.slice(i, ROWS_OUT)
                ids = [encoder.encode(t.as_py() or "") + end for t in some.column("text")]
                yield pa.RecordBatch.from_arrays([*some.select(["doc_id", "body"]).columns, pa.array(ids, pa.binary())], names=["doc_id", "body", "ids"])

    return d.mapInArrow(encode, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, body long, ids binary")


def _pack_streams(capacity: int, open_bins: int, width: int):
    """Over rows sorted by stream: the pieces of every row; after each stream a row without doc_id, piece
    -1, for every bin that is open, with its filled length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream = Packer(capacity, open_bins), None
        for b in batches:
            if not b.num_rows:
                continue
            which = b.column("stream").to_numpy()
            cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(which)]):
                if which[i] != stream:
                    if stream is not None:
                        yield rest(at, stream, b)
                    at, stream = Packer(capacity, open_bins), int(which[i])
                yield pieces(b.slice(i, j - i), at, stream)
        if stream is not None:
            yield rest(at, stream, b)

    def pieces(b: pa.RecordBatch, at: Packer, stream: int) -> pa.RecordBatch:
        row, piece, size, bins, offset, ids = [], [], [], [], [], []
        for k, raw in enumerate(b.column("ids")):
            view = raw.as_buffer()
            for p, begin in enumerate(range(0, view.size, capacity * width)):
                part = view.slice(begin, min(capacity * width, view.size - begin))
                number, where = at.put(part.size // width)
                row.append(k)
                piece.append(p)
                size.append(part.size // width)
                bins.append((stream << 32) + number)
                offset.append(where)
                ids.append(part)
        piece = np.array(piece, dtype=np.int32)
        columns = [b.column("doc_id").take(pa.array(row, pa.int64())), b.column("body").take(pa.array(row, pa.int64())), piece, piece.astype(np.int64) * capacity, np.array(size, dtype=np.int32), np.array(bins, dtype=np.int64), np.array(offset, dtype=np.int32), pa.array([x.to_pybytes() for x in ids], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=NAMES)

    def rest(at: Packer, stream: int, like: pa.RecordBatch) -> pa.RecordBatch:
        held = at.unclosed()
        n = len(held)
        columns = [pa.nulls(n, like.column("doc_id").type), pa.nulls(n, pa.int64()), pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([x for _, x in held], pa.int32()), pa.array([(stream << 32) + k for k, _ in held], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)

    return pack


NAMES = ["doc_id", "body", "piece", "begin", "length", "bin_id", "offset", "ids"]


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, streams: int = STREAMS, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, begin and length in the document's tokens, bin_id,
    the offset in the bin and the piece's ids (binary, little-endian, 2 bytes each for vocabularies below 65,536)."""
    d = tokens(docs, vocabulary)
    width = Encoder(vocabulary).dtype.itemsize
    d = d.withColumn("stream", F.pmod(F.xxhash64("doc_id", "body"), F.lit(streams)).cast("int"))
    d = d.repartition("stream").sortWithinPartitions("stream", F.col("doc_id").isNull(), "doc_id", "body")
    kinds = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, body long, piece int, begin long, length int, bin_id long, offset int, ids binary"
    placed, _ = stash(d.mapInArrow(_pack_streams(capacity, open_bins, width), kinds), "packed")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Packer(capacity, open_bins)
        for b in batches:
            found = np.array([at.put(n) for n in b.column("length").to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("bin_id"), pa.array((streams << 32) + found[:, 0]), pa.array(found[:, 1].astype(np.int32))], names=["bin_id", "into", "shift"])

    unclosed = placed.filter("piece < 0").select("bin_id", "length").repartition(1).sortWithinPartitions("bin_id")
    # At most streams * open_bins rows of 20 bytes, whatever the input: 1.3 MB as set.
    into = F.broadcast(unclosed.mapInArrow(again, "bin_id long, into long, shift int"))
    out = placed.filter("piece >= 0").join(into, "bin_id", "left")
    where = F.coalesce("into", "bin_id").alias("bin_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    return out.select("doc_id", "piece", "begin", "length", *where, "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed records: of each bin its tokens' number, their ids (binary), and the doc_ids, pieces and
    offsets of what it holds, in order. Shuffles the ids once, by bin."""
    part = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("p")
    d = packed.groupBy("bin_id").agg(part)
    joined = F.aggregate(F.transform("p", lambda x: x["ids"]), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    tokens = F.aggregate(F.transform("p", lambda x: x["length"]), F.lit(0), lambda a, x: a + x)
    return d.select("bin_id", tokens.alias("n_tokens"), F.col("p.doc_id").alias("doc_ids"), F.col("p.piece").alias("pieces"), F.col("p.offset").alias("offsets"), joined.alias("ids"))


def unpacked(packed: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of every sequence, found by its end mark in the pieces of a doc_id. Sequences of a doc_id that
    repeats come back one after another if each is one piece; of longer ones the pieces can't be told apart.
    For checks: gathers a doc_id's pieces in one row."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for b in batches:
            docs, texts = [], []
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                ids = np.frombuffer(raw, dtype=encoder.dtype)
                ends = np.flatnonzero(ids == encoder.end)
                for begin, end in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist()):
                    docs.append(doc)
                    texts.append(encoder.decode(ids[begin:end].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.column("doc_id").type), pa.array(texts, pa.string())], names=["doc_id", "text"])

    part = F.sort_array(F.collect_list(F.struct("piece", "bin_id", "offset", "ids")))
    d = packed.groupBy("doc_id").agg(part.alias("p"))
    whole = F.aggregate(F.transform("p", lambda x: x["ids"]), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return d.select("doc_id", whole.alias("ids")).mapInArrow(decode, f"doc_id {packed.schema['doc_id'].dataType.simpleString()}, text string")
