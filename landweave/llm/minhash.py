"""Near-duplicate groups by min-max hashing.

A document is the set of its word trigrams. Under each of 80 permutations both the
smallest and the largest value are kept, which gives 160 values of a signature for
80 evaluations; the share of equal values is an unbiased estimate of the Jaccard
similarity, of lower variance than 160 minima as minimum and maximum of a
permutation vary against each other. 40 bands of 4 values propose candidates.

1. Documents with one signature become one node.
2. Within a bucket (equal band) every node is compared with the bucket's smallest.
3. The components so found are joined with the buckets again: only a bucket that
   still holds two or more components needs all its pairs between components
   compared, by pairs of blocks of BLOCK nodes, each pair a group of its own. So every pair of
   every bucket is either compared or already together, at no more than a star's cost
   where a bucket is one group of copies.
4. Connected components of all pairs found similar (alternating large and small
   stars, each round written to the shared folder) are the groups.

Nodes are named by the 64-bit hash of their signature. Only keys, signatures and bands
shuffle, never texts; what a group or a bucket is summed up by are combining aggregates, so
that no group, however large, is one task's.

Defined cases: texts without a word (null, empty, blank) are in no group; texts of one
or two words count as one shingle; repeated rows are copies of one another; the
first of a group is the one with the smallest doc_id, null last, then by the hash of its
text, then by its place in the table; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .beside import facts, located, told
from .common import place, remove, stash
from .wordhash import mix, words_of

SHINGLE = 3
PERMUTATIONS = 80
BAND = 4
THRESHOLD = 0.5
#: Candidates count as similar from THRESHOLD - MARGIN of equal values on; the standard error at 0.5 is 0.04.
MARGIN = 0.05
#: Nodes of a bucket that are compared with one another in one task.
BLOCK = 1000
ROW = ["_key", "_at"]

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_ORDER = _rng.integers(1 << 62, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of many texts, and where those of each text begin."""
    n, ends = len(words), bounds[1:]
    total = np.zeros(n, dtype=np.uint64)
    for j, a in enumerate(_ORDER):
        total[: max(0, n - j)] += words[j:] * a
    size = np.diff(bounds)
    valid = np.ones(n, dtype=bool)
    for j in range(1, SHINGLE):  # a text's last positions have no full shingle
        at = ends[size >= j] - j
        valid[at] = False
    for short in range(1, SHINGLE):  # a short text is one shingle
        at = bounds[:-1][size == short]
        total[at] = sum(words[at + j] * _ORDER[j] for j in range(short))
        valid[at] = True
    count = np.where(size >= SHINGLE, size - SHINGLE + 1, (size > 0).astype(np.int64))
    return (mix(total[valid]) >> np.uint64(32)).astype(np.uint32), np.concatenate([[0], np.cumsum(count)])


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The low 16 bits of the minima, then of the maxima, a row for each text that has shingles."""
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(at), 2 * PERMUTATIONS), dtype="<u2")
    if not len(at):
        return out
    x, y = np.empty_like(values), np.empty_like(values)
    for p in range(PERMUTATIONS):
        np.multiply(values, _A[p], out=x)
        np.add(x, _B[p], out=x)
        np.right_shift(x, 15, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x846CA68B), out=x)
        np.right_shift(x, 16, out=y)
        np.bitwise_xor(x, y, out=x)
        out[:, p] = np.minimum.reduceat(x, at)
        out[:, PERMUTATIONS + p] = np.maximum.reduceat(x, at)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, words, bounds in words_of(b.column("text")):
            sig = signatures(*shingles(words, bounds))
            has = np.flatnonzero(np.diff(bounds) > 0) + i
            part = b.select(["doc_id", "body", *ROW]).take(pa.array(has))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * PERMUTATIONS), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))])
            yield pa.RecordBatch.from_arrays([*part.columns, raw.cast(pa.binary())], names=["doc_id", "body", *ROW, "sig"])


def signed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, body, _key, _at, sig, sid): body is the hash of the text, sid that of the signature."""
    d = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("body"), *ROW, F.col(text).alias("text"))
    return d.mapInArrow(_sign, d.select("doc_id", "body", *ROW, F.lit(b"").alias("sig")).schema).withColumn("sid", F.xxhash64("sig"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(len(column), -1)


def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of equal values of two signatures."""
    return pd.Series((_matrix(a) == _matrix(b)).mean(axis=1)) if len(a) else pd.Series([], dtype=float)


def _across(least: float):
    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        """The similar pairs between two blocks of a bucket (or within one) that are of different components."""
        sig, sid, label, block = _matrix(pair["sig"]), pair["sid"].to_numpy(), pair["label"].to_numpy(), pair["block"].to_numpy()
        one = pair["i"].iloc[0] == pair["j"].iloc[0]
        left, right = (np.arange(len(sid)),) * 2 if one else (np.flatnonzero(block == pair["i"]), np.flatnonzero(block == pair["j"]))
        a, b = [], []
        for k, i in enumerate(left.tolist()):
            other = right[k + 1 :] if one else right
            other = other[label[other] != label[i]]
            if len(other):
                near = other[(sig[other] == sig[i]).mean(axis=1) >= least]
                a.extend([sid[i]] * len(near))
                b.extend(sid[near])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return compare


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the smallest node."""
    spark = edges.sparkSession
    now, path = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Combining aggregates and joins: a node of any number of neighbours isn't one task's.
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = large.filter("a <> b").distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        then, new = stash(small.filter("a <> b").distinct(), "edges")
        said = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = then, new
        if said == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
        before = said


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            # Four values of 16 bits are one of 64; the band's number goes in by addition.
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u8").reshape(b.num_rows, -1)
            keyed = mix(sig + np.arange(1, sig.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sid = np.repeat(b.column("sid").to_numpy(), sig.shape[1])
            for i in range(0, len(sid), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keyed.reshape(-1)[i : i + 100_000].view(np.int64)), pa.array(sid[i : i + 100_000])], names=["bucket", "sid"])


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, sid, label, n) of the buckets that hold n nodes of two components or more; of those that
    bands proposed with the same nodes, one."""
    labelled = buckets.join(labels, buckets["sid"] == labels["node"], "left").select("bucket", "sid", F.coalesce("label", "sid").alias("label"))
    labelled, _ = stash(labelled, "labelled")
    of = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    sets = of.filter("low <> high").groupBy("s", "n").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return labelled.join(sets, "bucket")


def _pairs_of_blocks(mixed: DataFrame, block: int) -> DataFrame:
    """Every row once for each block of its bucket, so that each pair of blocks is a group (bucket, i, j)."""
    blocks = F.ceil(F.col("n") / block)
    d = mixed.withColumn("block", F.pmod(F.xxhash64("sid"), blocks)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return d.select("bucket", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "sid", "label")


def groups(docs: DataFrame, doc: str, text: str, threshold: float = THRESHOLD, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """(doc_id, _key, _at, group_id, keep) of every one of the located ``docs`` that has a near copy; group_id is
    the doc_id of the group's first document, the only one with keep."""
    least = threshold - margin
    all_docs, _ = stash(signed(docs, doc, text), "signatures")
    nodes, _ = stash(all_docs.groupBy("sid").agg(F.first("sig").alias("sig")), "nodes")
    rows = nodes.select("sid", "sig").mapInArrow(_bands, "bucket long, sid long")
    shared = rows.groupBy("bucket").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low <> high").drop("high")
    buckets, _ = stash(rows.join(shared, "bucket"), "buckets")
    like = F.pandas_udf(similarity, "double").asNondeterministic()
    stars = buckets.filter("sid <> low").select(F.col("low").alias("a"), F.col("sid").alias("b")).distinct()
    sig = lambda n: nodes.select(F.col("sid").alias(n), F.col("sig").alias(f"sig_{n}"))
    near = stars.join(sig("a"), "a").join(sig("b"), "b").withColumn("like", like("sig_a", "sig_b")).filter(F.col("like") >= least).select("a", "b")
    labels, _ = stash(components(near), "labels")
    pairs = _pairs_of_blocks(_mixed(buckets.select("bucket", "sid"), labels), block).join(nodes, "sid")
    more = pairs.groupBy("bucket", "i", "j").applyInPandas(_across(least), "a long, b long").distinct()
    final, _ = stash(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)), "components")
    d = all_docs.drop("sig").join(final, all_docs["sid"] == final["node"], "left").select("doc_id", "body", *ROW, F.coalesce("label", "sid").alias("grp"))
    # Each group's first and size by a combining aggregate: a group of any size isn't one task's.
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("body"), *ROW))
    of = d.groupBy("grp").agg(first.alias("f"), F.count("*").alias("n")).filter("n > 1").select("grp", "f")
    return d.join(of, "grp").select("doc_id", *ROW, F.col("f.doc_id").alias("group_id"), ((F.col("_key") == F.col("f._key")) & (F.col("_at") == F.col("f._at"))).alias("keep"))


def _stays(has: np.ndarray, table: pa.Table | None, n: int) -> pd.Series:
    out = np.ones(n, dtype=bool)
    out[has] = False
    return pd.Series(out)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """``docs`` with all columns, of each group only its first document. What goes is told to the rows
    where they are read; texts don't shuffle."""
    d = located(docs)
    gone = facts(groups(d, place(docs, "doc_id"), place(docs, "text"), threshold, margin).filter("not keep").select(*ROW), "copies")
    out = d.filter(told(gone, "boolean", _stays))
    return out.select(*[f"_in{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """Every document that has a near copy: doc_id, group_id, keep."""
    return groups(located(docs), place(docs, "doc_id"), place(docs, "text")).drop(*ROW)
