"""The pipeline as a whole against a plain Python version of its stages."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pandas as pd

import corpus_pipeline
from landweave.llm import common, packing, quality, registry, secrets
from landweave.llm.common import table
from tests.llm.test_operators import ODD, edited, jaccard, junk


def brute(rows, docs):
    """Quality, lines, near copies (to any earlier document) and secrets, row by row."""
    masks = quality.vote_masks(pd.Series([t for _, t in rows]))
    kinds, counts = np.unique(masks, return_counts=True)
    right = quality.expectation_maximisation(kinds, counts).right
    kept = []
    for (i, t), m in zip(rows, masks):
        odds = sum(s * math.log(a / (1 - a)) for j, (a, s) in enumerate(zip(right, quality.SIGNS)) if m >> j & 1)
        if odds >= -1e-9:
            kept.append((i, t))
    seen, out = set(), []
    for i, t in sorted(kept):
        left = []
        for x in t.split("\n"):
            if x.strip() and x in seen:
                continue
            seen.add(x)
            left.append(x)
        if any(x.strip() for x in left) or not t.strip():
            out.append((i, "\n".join(left)))
    alone = []
    group = {}
    for k, (i, t) in enumerate(out):
        group[i] = next((group[j] for j, u in out[:k] if t.strip() and u.strip() and jaccard(t, u) >= 0.5), i)
        if group[i] == i:
            alone.append((i, t))
    scanner, clean = secrets.Scanner(secrets.dictionary(docs(alone))), []
    for i, t in alone:
        for a, b, *_ in reversed(scanner.find(t)):
            t = t[:a] + secrets.MASK + t[b:]
        clean.append((i, t))
    return clean


def test_stages_against_brute_force(spark, docs, prose, tmp_path):
    rng = random.Random(3)
    boiler = "all rights reserved by the owner of this page"
    rows = [(i, f"{boiler}\n{prose(90, i)}") for i in range(25)]
    rows += [(100 + i, junk(k, prose, i)) for i, k in enumerate(("caps", "symbols", "table", "repeat"))]
    rows += [(200 + i, edited(prose(90, i).replace("\n", " "), 0.03, i)) for i in range(5)] + [(210 + i, edited(prose(90, i).replace("\n", " "), 0.04, 50 + i)) for i in range(5)]
    rows += [(300 + i, prose(90, i)) for i in range(4)]  # exact copies lose all lines
    rows += [(400 + i, prose(60, 400 + i) + '\ntoken = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"') for i in range(3)]
    d = docs(rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    wanted = brute(rows, docs)
    at = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == d.columns, name
    assert sorted((r["doc_id"], r["text"]) for r in at.collect()) == sorted(wanted)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in packing.unpacked(packed).collect()) == sorted(wanted)


def test_odd_inputs_through_all_stages(spark, docs, prose, tmp_path):
    """Nulls, empty and very long texts, ties and repeated rows, an empty table, clashing columns."""
    long = "\n".join(prose(300, 1000 + i) for i in range(400))
    rows = [*ODD, (20, long), (21, prose(90, 1)), (21, prose(90, 1)), (None, prose(90, 2)), (23, prose(90, 3))]
    d = docs(rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    back = {(r["doc_id"], r["text"]) for r in packing.unpacked(corpus_pipeline.run(spark, str(tmp_path))).collect()}
    # Texts without a word are kept, null as empty; of the repeated rows one is; nothing else goes.
    assert back == {(i, t or "") for i, t in rows}
    at = docs(rows, extra=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns, name
        at = common.stash(common.anonymous(out), "odd")[0].toDF(*out.columns)
    assert at.count() == len(back)
    (tmp_path / "none").mkdir()
    docs([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_registry():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.QUERIES}) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5 and os.path.exists(corpus_pipeline.__file__)
