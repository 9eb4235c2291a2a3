"""Line dedup with two Bloom filters.

Of each distinct non-blank line only the first occurrence in the corpus stays: the
one with the smallest (doc_id, text's hash, line number, place in the table); null doc_ids come
after all others.

1. The 64-bit hashes of the lines and where they stand shuffle, without text, to shards by
   hash, each a file. A task streams its shard through two Bloom filters, sized by the
   number of its rows: a hash that the *once* filter already holds goes into the *twice*
   filter. Then it streams the shard again; what the *twice* filter holds is a suspect.
   No filter leaves its task and no hash is kept, so this is the one way at every size.
2. Where suspects stand is brought to the documents (:mod:`.beside`); only suspected repeats
   shuffle with their text. Grouped by the exact text they give the first occurrences;
   suspects that aren't among these are dropped, so a false positive of the filters loses
   nothing.
3. What each document loses is brought to it where it is read: texts don't shuffle.

Defined cases: a null or empty text has no lines and its document stays as it is;
blank lines (white space only) always stay, except in a document that lost all its
other lines; such a document is removed by :func:`dedup_lines`. Rows with equal doc_id
and text are one document: the first of them in the table stays. An empty table gives an
empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .beside import facts, located, part_files, told
from .bloom import Bloom
from .common import place, scratch, stash

ROW = ["_key", "_at"]
#: A shard holds about the lines of so much stored text.
SHARD_BYTES = 1 << 30
ROWS_AT_ONCE = 1 << 16


def _shards(docs: DataFrame) -> int:
    """As many as the session's shuffles have partitions; more where the table is larger than these can hold."""
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored // SHARD_BYTES))


def _suspects_of(names: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each shard whose hash occurs twice or more in it, and few others."""
    for b in names:
        for name in b.column("file").to_pylist():
            system, path = fs.FileSystem.from_uri(name)
            with pq.ParquetFile(path, filesystem=system) as shard:
                once, twice = (Bloom.sized(shard.metadata.num_rows) for _ in range(2))
                for rows in shard.iter_batches(ROWS_AT_ONCE, columns=["h"]):
                    new, counts = np.unique(rows.column("h").to_numpy().view(np.uint64), return_counts=True)
                    seen = once.might_hold(new)
                    twice.add(new[seen | (counts > 1)])
                    once.add(new[~seen])
                for rows in shard.iter_batches(ROWS_AT_ONCE):
                    hit = twice.might_hold(rows.column("h").to_numpy().view(np.uint64))
                    yield rows.select([*ROW, "pos"]).filter(pa.array(hit))


def suspects(docs: DataFrame, text: str) -> DataFrame:
    """(_key, _at, pos) of the lines of located ``docs`` whose hash the corpus holds twice or more, and few others."""
    spark = docs.sparkSession
    each = docs.select(*ROW, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))
    each = each.filter(F.col("line").rlike("\\S")).select(F.xxhash64("line").alias("h"), *ROW, "pos")
    path = scratch(spark, "line-hashes")
    each.repartition(_shards(docs), "h").write.option("maxRecordsPerFile", 0).parquet(path)
    shards = sorted(part_files(spark, path).values())
    listed = spark.createDataFrame(list(enumerate(shards)), "i int, file string").repartitionById(max(1, len(shards)), F.col("i"))
    return stash(listed.select("file").mapInArrow(_suspects_of, "_key long, _at long, pos int"), "suspects")[0]


def _line_texts(batches: Iterator[pa.RecordBatch], reader) -> Iterator[pa.RecordBatch]:
    """Each suspected line with its text and where it stands."""
    for b in batches:
        for has, table in reader.find(*(b.column(c).to_numpy() for c in ("_key", "_bucket", "_at"))):
            texts, row, pos, line = b.column("text").take(pa.array(has)).to_pylist(), [], [], []
            for i, text, at in zip(has.tolist(), texts, table["pos"].to_pylist()):
                parts = text.split("\n")
                row += [i] * len(at)
                pos += at
                line += [parts[k] for k in at]
            held = b.select(["doc_id", "body", *ROW]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(pos, pa.int32()), pa.array(line, pa.string())], names=["doc_id", "body", *ROW, "pos", "line"])


def dropped_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(_key, _at, drop): the line numbers that each of the located ``docs`` loses, if any."""
    seen = suspects(docs, text)
    held = facts(seen.groupBy(*ROW).agg(F.collect_list("pos").alias("pos")), "suspect-lines")
    d = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("body"), *ROW, held.bucket().alias("_bucket"), F.col(text).alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, body long, _key long, _at long, pos int, line string"
    lines = d.mapInArrow(lambda batches: _line_texts(batches, held.reader()), schema)
    at = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("body"), F.col("pos"), *ROW)
    first = lines.groupBy("line").agg(F.min(at).alias("f")).select("f._key", "f._at", "f.pos", F.lit(True).alias("first"))
    both = seen.select(*ROW, "pos", F.lit(False).alias("first")).unionByName(first)
    each = both.groupBy(*ROW).agg(F.collect_set(F.when(~F.col("first"), F.col("pos"))).alias("all"), F.collect_set(F.when(F.col("first"), F.col("pos"))).alias("kept"))
    return each.select(*ROW, F.array_except("all", "kept").alias("drop")).filter(F.size("drop") > 0)


def repeated_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(_key, _at) of the located rows that have doc_id and text of an earlier one; only keys shuffle."""
    keys = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("body"), F.col(text).isNull().alias("none"), F.struct(*ROW).alias("row"))
    again = keys.groupBy("doc_id", "body", "none").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same = keys["body"].eqNullSafe(again["body"]) & (keys["none"] == again["none"]) & keys["doc_id"].eqNullSafe(again["doc_id"])
    return keys.join(again, same).filter("row > first").select("row.*")


def _without(has: np.ndarray, table: pa.Table | None, n: int, texts: pd.Series) -> pd.DataFrame:
    out, left, dropped = texts.to_numpy(dtype=object, copy=True), np.ones(n, dtype=bool), np.zeros(n, dtype=np.int32)
    for i, drop, gone in zip(has.tolist(), table["drop"].to_pylist(), table["gone"].to_pylist()) if table is not None else ():
        if gone:
            left[i] = False
        else:
            away = set(drop)
            kept = [x for k, x in enumerate(out[i].split("\n")) if k not in away]
            out[i], left[i], dropped[i] = "\n".join(kept), any(x.strip(" \t\n\r\f\v") for x in kept), len(away)
    return pd.DataFrame({"text": pd.Series(out, dtype=object), "left": left, "dropped": dropped})


def _applied(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """Located ``docs`` with ``_new`` (text, left, dropped)."""
    doc, text = place(docs, "doc_id"), place(docs, "text")
    d = located(docs)
    gone = repeated_rows(d, doc, text).withColumn("gone", F.lit(True))
    lost = dropped_lines(d, doc, text).unionByName(gone, allowMissingColumns=True).groupBy(*ROW).agg(F.first("drop", True).alias("drop"), F.coalesce(F.bool_or("gone"), F.lit(False)).alias("gone"))
    return d.withColumn("_new", told(facts(lost, "lost-lines"), "text string, left boolean, dropped int", _without, text)), doc, text


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, text without its repeated lines (n_chars, if there,
    follows), without the documents of which nothing is left."""
    d, doc, text = _applied(docs)
    out = d.filter("_new.left")
    cols = []
    for i, name in enumerate(docs.columns):
        c = F.col("_new.text") if f"_in{i}" == text else F.col(f"_in{i}")
        if name == "n_chars":
            c = F.length("_new.text").cast(docs.schema[i].dataType)
        cols.append(c.alias(f"_out{i}"))
    return out.select(*cols).toDF(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """Each document that keeps something: doc_id, lines_dropped and its text."""
    d, doc, _ = _applied(docs)
    return d.filter("_new.left").select(F.col(doc).alias("doc_id"), F.col("_new.dropped").alias("lines_dropped"), F.col("_new.text").alias("text"))


ORACLE = """with d as (select distinct doc_id, text from documents),
l as (select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) pos from d),
k as (select *, regexp_matches(line, '[^ \\t\\n\\r\\f\\v]') solid,
 row_number() over (partition by line order by doc_id nulls last, pos) rn from l)
select doc_id, cast(sum(case when solid and rn > 1 then 1 else 0 end) as integer) lines_dropped,
 case when k.text is not null then string_agg(line, chr(10) order by pos) filter (where not solid or rn = 1) end "text"
from k group by doc_id, text
having bool_or(solid and rn = 1) or not bool_or(solid)"""
