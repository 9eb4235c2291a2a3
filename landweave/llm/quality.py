"""Quality rules by weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the table of
vote patterns (at most 2 ** number of rules rows, however large the corpus)
estimates how often each rule's vote is right; a document stays if its posterior
probability of being good reaches ``threshold``, so one accusation can be
outweighed and no rule must be passed. A document on which all rules abstain has
the prior, 0.5, and stays.

The text is read twice, once for the counts of patterns and once for the decision,
and is never shuffled. Features come from an Arrow-batched function over byte
strings: the same features as built-in regular expressions took ten times the CPU.

Words are what white space (ASCII) separates, lines what line feeds do; letters are upper and lower case
in any script, full stops those of STOPS. Rules on the length of words abstain where few letters
have case, as such scripts may have no spaces; the one on full stops where lines are short, as in lists,
tables and verse.

Defined cases: a null text counts as empty; on an empty text every rule abstains
and it stays; repeated rows and null ``doc_id`` are judged row by row; an empty
table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anonymous, pick, place

THRESHOLD = 0.5
ROUNDS = 25
#: Prior probability of a good document. It stays as given: with rules that only accuse, a free
#: prior can explain every accusation away.
PRIOR = 0.5
#: A rule's accuracy before any evidence, and the number of votes which that belief weighs.
ACCURACY, STRENGTH = 0.9, 10.0

_PLAIN = "symbols < 0.1 * w and pipes < 0.05 * w and upper < 0.35 * (upper + lower)"

#: (rule, what it votes where it doesn't abstain, where it votes). The conditions are read both as
#: SQL and, over numpy columns, as Python.
RULES = [
    ("symbols", -1, "w > 0 and symbols > 0.5 * w and symbols > 0.08 * chars"),
    ("capitals", -1, "upper + lower > 0 and upper > 0.6 * (upper + lower)"),
    ("table_cells", -1, "w > 0 and pipes > 0.2 * w"),
    ("repetition", -1, "w >= 12 and distinct_words < 2.2 * sqrt(w)"),
    ("repeated_lines", -1, "lines >= 4 and distinct_lines < 0.4 * lines"),
    ("long_words", -1, "w >= 5 and chars > 14.0 * w and 5 * (upper + lower) > chars"),
    ("short_words", -1, "w >= 20 and chars < 2.5 * w and 5 * (upper + lower) > chars"),
    ("digits", -1, "w >= 5 and digits > 0.5 * chars"),
    ("no_sentences", -1, "w >= 40 and stops < 0.005 * w and w >= 12 * lines"),
    ("prose", 1, f"w >= 20 and {_PLAIN} and stops > 0.02 * w and stops < 0.3 * w and chars > 4.0 * w and chars < 9.0 * w and distinct_words > 2.5 * sqrt(w)"),
    ("varied", 1, f"w >= 20 and {_PLAIN} and digits < 0.15 * chars and distinct_words > 3.5 * sqrt(w) and distinct_lines > 0.8 * lines"),
]
SIGNS = np.array([sign for _, sign, _ in RULES])
FEATURES = ["chars", "w", "upper", "lower", "symbols", "pipes", "digits", "stops", "distinct_words", "lines", "distinct_lines"]

UPPER, LOWER = "\\p{Lu}+", "\\p{Ll}+"
SYMBOL, WORD = "[#$%&*!|<>{}@~^=_]+", "[^ \\t\\n\\r\\f\\v]+"
#: Full stops and question marks; of Latin, CJK, Arabic, Devanagari, Armenian, Ethiopic, Khmer and Burmese writing.
STOPS = ".?。．｡！？؟۔।॥։።។။"

_UPPER, _LOWER, _DIGIT, _SYMBOL = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"#$%&*!|<>{}@~^=_"


@functools.cache
def _cases() -> np.ndarray:
    """Per code point: 1 for capital letters, 2 for small ones."""
    kinds = {"Lu": 1, "Ll": 2}
    return np.array([kinds.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)], dtype=np.uint8)


def features_of(text: str) -> tuple[int, ...]:
    """The :data:`FEATURES` of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    n, lines, words = len(raw), text.split("\n"), raw.split()
    if text.isascii():
        upper, lower, stops = n - len(raw.translate(None, _UPPER)), n - len(raw.translate(None, _LOWER)), raw.count(b".") + raw.count(b"?")
    else:
        count = np.bincount(_cases()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")], minlength=3)
        upper, lower, stops = int(count[1]), int(count[2]), sum(map(text.count, STOPS))
    return (
        len(text),
        len(words),
        upper,
        lower,
        n - len(raw.translate(None, _SYMBOL)),
        raw.count(b"|"),
        n - len(raw.translate(None, _DIGIT)),
        stops,
        len(set(words)),
        len(lines),
        len(set(lines)),
    )


_CODE = [compile("(" + cond.replace(" and ", ") & (") + ")", name, "eval") for name, _, cond in RULES]


def vote_masks(texts: pd.Series) -> pd.Series:
    """Per text an integer whose bit j says that rule j votes."""
    found = np.array([features_of(t or "") for t in texts], dtype=np.int64).reshape(-1, len(FEATURES)).T
    at = dict(zip(FEATURES, found)) | {"sqrt": np.sqrt}
    mask = np.zeros(len(texts), dtype=np.int32)
    for j, code in enumerate(_CODE):
        mask |= np.asarray(eval(code, {}, at), dtype=np.int32) << j  # noqa: S307 - the conditions above
    return pd.Series(mask)


def _masks(text: Column) -> Column:
    return F.pandas_udf(vote_masks, "int").asNondeterministic()(text)  # so that no filter evaluates it a second time


@dataclass(frozen=True)
class Accuracies:
    """Per rule the estimated probability that its vote, if it casts one, is right."""

    right: tuple[float, ...]

    def posterior(self, mask: Column) -> Column:
        odds = F.lit(math.log(PRIOR / (1 - PRIOR)))
        for j, (a, sign) in enumerate(zip(self.right, SIGNS)):
            odds = odds + F.when(mask.bitwiseAND(1 << j) != 0, float(sign) * math.log(a / (1 - a))).otherwise(0.0)
        return F.round(1 / (1 + F.exp(-odds)), 6)


def expectation_maximisation(masks: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Accuracies:
    """Two classes, rules independent given the class; abstaining says nothing of the class."""
    right, counts = np.full(len(RULES), ACCURACY), counts.astype(float)
    cast = (masks[:, None] >> np.arange(len(RULES)) & 1).astype(float)
    for _ in range(rounds if len(counts) else 0):
        odds = math.log(PRIOR / (1 - PRIOR)) + (cast * SIGNS) @ np.log(right / (1 - right))
        good = counts / (1 + np.exp(-odds))
        agree = np.where(SIGNS > 0, good[:, None], (counts - good)[:, None])
        right = ((cast * agree).sum(0) + ACCURACY * STRENGTH) / (cast.T @ counts + STRENGTH)
    return Accuracies(tuple(map(float, right)))


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Accuracies:
    """Estimates over all of ``docs``; only the counts of vote patterns reach the driver."""
    found = sorted(pick(docs, "text").select(_masks(F.col("text")).alias("m")).groupBy("m").count().collect())
    return expectation_maximisation(np.array([r[0] for r in found], dtype=int), np.array([r[1] for r in found], dtype=int), rounds)


def score(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document: doc_id, quality_prob, good_votes, bad_votes, keep."""
    model = fit(docs)
    m = F.col("_mask")
    votes = lambda sign: F.bit_count(m.bitwiseAND(sum(1 << j for j, s in enumerate(SIGNS) if s == sign)))
    voted = pick(docs, "doc_id", "text").select("doc_id", _masks(F.col("text")).alias("_mask"))
    return voted.select("doc_id", model.posterior(m).alias("quality_prob"), votes(1).alias("good_votes"), votes(-1).alias("bad_votes")).withColumn("keep", F.col("quality_prob") >= threshold)


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose posterior reaches ``threshold``, with all their columns."""
    model = fit(docs)
    voted = anonymous(docs).withColumn("_mask", _masks(F.col(place(docs, "text"))))
    return voted.filter(model.posterior(F.col("_mask")) >= threshold).drop("_mask").toDF(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their posterior and the votes behind it."""
    return score(docs).filter("keep")


def oracle(rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL; the rounds of the estimation are unrolled."""
    runs = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    cond = lambda c: c.replace("upper", '"upper"').replace("lower", '"lower"')
    names = [r[0] for r in RULES]
    ctes = [
        "d as (select doc_id, coalesce(text, '') t from documents)",
        f"""f as materialized (select doc_id, length(t) chars, len(regexp_extract_all(t, '{WORD}')) w, {runs(UPPER)} "upper", {runs(LOWER)} "lower",
 {runs(SYMBOL)} symbols, length(t) - length(replace(t, '|', '')) pipes, {runs("[0-9]+")} digits, {runs(f"[{STOPS}]+")} stops,
 len(list_distinct(regexp_extract_all(t, '{WORD}'))) distinct_words, len(string_split(t, chr(10))) lines, len(list_distinct(string_split(t, chr(10)))) distinct_lines from d)""",
        "v as materialized (select doc_id, " + ", ".join(f"case when {cond(c)} then {s} else 0 end v_{n}" for n, s, c in RULES) + " from f)",
        f"pat as materialized (select {', '.join(f'v_{n}' for n in names)}, cast(count(*) as double) n from v group by all)",
        "m0 as (select " + ", ".join(f"cast({ACCURACY} as double) a_{n}" for n in names) + ")",
    ]
    odds = f"ln(cast({PRIOR} as double) / {1 - PRIOR}) + " + " + ".join(f"v_{n} * ln(a_{n} / (1 - a_{n}))" for n in names)
    for k in range(1, rounds + 1):
        ctes.append(f"p{k} as materialized (select pat.*, n / (1 + exp(-({odds}))) p from pat, m{k - 1})")
        of = lambda n: f"(sum(case v_{n} when 1 then p when -1 then n - p else 0 end) + {ACCURACY * STRENGTH}) / (sum(case when v_{n} <> 0 then n else 0 end) + {STRENGTH}) a_{n}"
        ctes.append(f"m{k} as materialized (select {', '.join(map(of, names))} from p{k})")
    votes = lambda x: " + ".join(f"case when v_{n} = {x} then 1 else 0 end" for n in names)
    ctes.append(f"r as (select doc_id, round(1 / (1 + exp(-({odds}))), 6) quality_prob, cast({votes(1)} as integer) good_votes, cast({votes(-1)} as integer) bad_votes from v, m{rounds})")
    return "with " + ",\n".join(ctes) + f"\nselect *, true as keep from r where quality_prob >= {THRESHOLD}"
