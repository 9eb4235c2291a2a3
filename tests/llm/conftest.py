from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["keep", "body", "h", "line", "pos", "sid", "bucket", "label", "_mask", "_in0", "_body", "shard", "Text", "DOC_ID", "tokens", "_new", "ids"]


@pytest.fixture
def docs(spark):
    """A frame of documents out of (doc_id, text) pairs."""

    def of(pairs, extra=False):
        rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:  # names that clash with those of results and of temporary columns, also in case
            df = df.select("*", *[F.lit("x") for _ in CLASHING]).toDF(*df.columns, *CLASHING)
        return df

    return of


@pytest.fixture(scope="session")
def prose():
    """n words of invented prose, the same for the same seed."""
    import numpy as np

    parts = ["an", "er", "th", "on", "ing", "ed", "st", "re", "in", "ti", "ou", "ha"]

    def of(n, seed):
        rng = np.random.default_rng(seed)
        words = ["".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(n)]
        out = []
        for i in range(0, n, 12):
            out.append(" ".join(words[i : i + 12]).capitalize() + ".")
        return "\n".join(" ".join(out[i : i + 3]) for i in range(0, len(out), 3))

    return of
