"""Document fingerprints by winnowing.

Rolling hashes of all runs of K words; of every window of WINDOW consecutive hashes the
smallest is selected, of equal ones the rightmost. A selected hash is a fingerprint and
keeps its position (that of its first word). Two texts that share a passage of
WINDOW + K - 1 = 47 words or more share a fingerprint of it; no passage of fewer
than K = 16 words alone makes a match. Whole texts are fingerprinted where they are
read; nothing shuffles.

Words are what white space separates, without regard to case.

Defined cases: a text of fewer than K words is one run; one with fewer than WINDOW runs
is one window; a null, empty or blank text has empty lists; repeated rows are
fingerprinted each; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .wordhash import mix, words_of

K = 16
WINDOW = 32
_BASE = 0xD6E8FEB86659FD95


def rolling(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k words: differences of prefix sums of one polynomial."""
    n = len(words)
    power, inverse = np.full((2, n + 1), 1, dtype=np.uint64)
    power[1:], inverse[1:] = _BASE, pow(_BASE, -1, 1 << 64)
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1]) if n >= k else np.empty(0, dtype=np.uint64)


def window_minima(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The position of the rightmost smallest hash of the window that starts at each position."""
    low, at = hashes, np.arange(len(hashes))

    def joined(low: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[step:] <= low[:-step]
        return np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])

    size = 1
    while 2 * size <= window:
        low, at = joined(low, at, size)
        size *= 2
    return at if size == window else joined(low, at, window - size)[1]


def _select(words: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts: the number of fingerprints of each, their positions and values."""
    runs = rolling(words, k)
    minima = window_minima(runs, window) if len(runs) >= window else np.empty(0, dtype=np.int64)
    where, what, count = [], [], []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = end - begin - k + 1
        if n >= window:
            at = minima[begin : begin + n - window + 1]
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            value = runs[at]
        elif n >= 1:
            own = runs[begin : begin + n]
            at = np.array([begin + n - 1 - int(np.argmin(own[::-1]))])
            value = runs[at]
        elif end > begin:
            at, value = np.array([begin]), rolling(words[begin:end], end - begin)
        else:
            at, value = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        where.append(at - begin)
        what.append(value)
        count.append(len(at))
    return np.array(count), np.concatenate(where), np.concatenate(what)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, words, positions and fingerprints (lists of equal length)."""
    d = pick(docs, "doc_id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, words, bounds in words_of(b.column("text")):
                count, where, what = _select(words, bounds, k, window)
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (where.astype(np.int32), what.view(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array(np.diff(bounds).astype(np.int32)), *lists], names=["doc_id", "words", "positions", "fingerprints"])

    return d.mapInArrow(each, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, words int, positions array<int>, fingerprints array<long>")


def matches(prints: DataFrame) -> DataFrame:
    """(first_doc_id, doc_id, fingerprint): every document with each fingerprint that it shares, and the
    smallest doc_id that has it. A fingerprint of any number of documents is so many rows, never one list;
    null doc_ids are left out."""
    each = prints.select("doc_id", F.explode(F.array_distinct("fingerprints")).alias("fingerprint")).filter("doc_id is not null").distinct()
    shared = each.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return each.join(shared, "fingerprint").filter("doc_id <> first_doc_id").select("first_doc_id", "doc_id", "fingerprint")
