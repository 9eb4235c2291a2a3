"""Language-model scores of a log-bilinear neural model.

The model predicts a word from the CONTEXT words before it: the context vector is the
sum of their vectors, each scaled element by element by the weights of its position, and
a word's score is its product with that plus a bias. The vocabulary follows the corpus, by
counts over all documents: every word that occurs :func:`least_count` times has vectors of
its own (at least the VOCABULARY most frequent words have). The others share BUCKETS classes
by hash and get log P(word | class) from the counts of all of them, by a join; so the
probabilities of all words, seen or unseen, sum to one.

The HEAD most frequent words and the classes are predicted at once; words after them in
groups of like frequency, about as many groups as a group has words: first the group and then
the word in it, both from the context, so that a word costs the root of the vocabulary. The model
is trained in numpy with noise-contrastive estimation (noise drawn from the corpus' word
frequencies, within a group evenly; shared by a batch), so that no normaliser is needed.

Training takes ROUNDS rounds, each over its share of all texts, by the texts' hashes. In a
round :func:`shards` models, a number that follows the corpus, start from the average of the
round before; each learns the texts that a hash sends to it, in the order of their hashes. Thus the
result depends on the texts alone, not on how the table is cut. The averaging (with the
step sizes') streams over a shuffle of blocks of the parameters; the driver receives one model.

Scoring is normalised: the logarithm of the sum over all classes is computed for each distinct
context by batched matrix products and kept for the task, that of a group for each word in it.

Defined cases: a null, empty or blank text has 0 words, total_log_prob 0 and no log_prob; texts of
any length are scored whole; equally frequent words enter the vocabulary by hash; the
words that the corpus doesn't have count together as one word of one occurrence a class;
repeated rows are scored (and counted) each; an empty table gives an empty result; extra
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stash
from .wordhash import mix, words_of

VOCABULARY = 2000
BUCKETS = 48
HEAD = 128
LEAST_GROUP = 64
CONTEXT = 2
DIMENSIONS = 16
NOISE = 32
GROUP_NOISE = 8
ROUNDS = 2
KEPT = 1 << 20
ROWS = 256
BATCH = 32768
RATE = 0.05
BLOCK = 8192


def least_count(total: int) -> int:
    """How often a word occurs that gets its own vectors, in a corpus of so many words.

    With the root of the corpus, so that the vocabulary grows with it, but slower than it
    (each worker holds the model): 50 of 4 million words, 250 of 100 million.
    """
    return max(5, round(total**0.5 / 40))


def shards(total: int) -> int:
    """How many models learn at a time from a corpus of so many words: 10 of 100 million, 5,000 of 25 trillion."""
    return max(1, round(total**0.5 / 1000))


@dataclass
class Words:
    """The vocabulary. Ids: the BUCKETS classes of other words, then words by frequency, then the start of a text.

    ``hashes`` of the words are sorted, ``ranks`` are the places of these by frequency;
    ``log_freq`` has the log frequencies by id. ``rest`` has the occurrences of the other words by class,
    one more for words unseen; ``rare`` their counts (word, n); ``total`` is the number of words of the corpus.
    """

    hashes: np.ndarray
    ranks: np.ndarray
    log_freq: np.ndarray
    rest: np.ndarray
    total: int = 0
    rare: DataFrame | None = None

    def local(self) -> Words:
        """What the tasks need."""
        return Words(self.hashes, self.ranks, self.log_freq, self.rest, self.total)

    @property
    def size(self) -> int:
        """The number of ids that can be predicted, and the id of a text's start."""
        return len(self.log_freq)

    @property
    def group(self) -> int:
        """The words of a group: a power of two near the root of their number."""
        return max(LEAST_GROUP, 1 << round(np.log2(max(1, self.size - BUCKETS - HEAD)) / 2))

    @property
    def direct(self) -> int:
        """The first id that is predicted by way of its group."""
        return min(self.size, BUCKETS + HEAD)

    @property
    def groups(self) -> int:
        return -(-(self.size - self.direct) // self.group)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.int64)
        if not len(self.hashes):
            return np.mod(h, BUCKETS)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ranks[at] + BUCKETS, np.mod(h, BUCKETS))

    def sizes(self) -> np.ndarray:
        """The number of words of each group."""
        return np.minimum(self.group, self.size - self.direct - self.group * np.arange(self.groups))

    def row_freq(self) -> np.ndarray:
        """Log frequencies of ids that are predicted at once, of words within their group, and of groups."""
        tail = self.log_freq[self.direct :].astype(float)
        if not len(tail):
            return self.log_freq
        total = np.log(np.add.reduceat(np.exp(tail), np.arange(0, len(tail), self.group)))
        return np.concatenate([self.log_freq[: self.direct], tail - np.repeat(total, self.sizes()), total]).astype(np.float32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and counts of a partition; they leave when they are many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

    def out(words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], names=["word", "n"])

    for b in batches:
        for _, _, words, _ in words_of(b.column(0)):
            held.append(np.unique(words, return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield from out(*held[0])
                    held, size = [], 0
    if held:
        yield from out(*merged())


def vocabulary(docs: DataFrame, size: int | None = None) -> Words:
    """From the counts of all words of all documents; the ``size`` most frequent, if given."""
    each = pick(docs, "text").mapInArrow(_count, "word long, n long")
    counts, _ = stash(each.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if size is None:
        top = counts.filter(F.col("n") >= least_count(total)).toArrow()
    if size is not None or len(top) < VOCABULARY:
        top = counts.orderBy(F.col("n").desc(), "word").limit(VOCABULARY if size is None else size).toArrow()
    word, n = (top.column(c).to_numpy() for c in ("word", "n"))
    rare = counts
    if len(word):
        last = int(n.min())
        rare = counts.filter((F.col("n") < last) | (F.col("n") == last) & (F.col("word") > int(word[n == last].max())))
    rest = np.ones(BUCKETS)
    for b, k in rare.groupBy(F.pmod("word", F.lit(BUCKETS)).alias("b")).agg(F.sum("n")).collect():
        rest[b] += k
    by_count = np.lexsort((word, -n))
    word, n = word[by_count], n[by_count]
    order = np.argsort(word)
    freq = np.concatenate([rest, n + 1.0])
    return Words(word[order].astype(np.int64), order, np.log(freq / freq.sum()).astype(np.float32), rest, total, rare)


class Model:
    """Vectors of words as context (one more for the start of a text) and as target, position weights,
    biases. Targets and biases are those of all ids and then those of the groups."""

    def __init__(self, flat: np.ndarray, words: Words):
        d, at, out = DIMENSIONS, 0, words.size + words.groups
        self.flat = flat
        for name, shape in {"context": (words.size + 1, d), "target": (out, d), "weights": (CONTEXT, d), "bias": (out,)}.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def length(words: Words) -> int:
        out = words.size + words.groups
        return (words.size + 1 + out + CONTEXT) * DIMENSIONS + out

    @classmethod
    def start(cls, words: Words, seed: int = 11) -> Model:
        m = cls(np.random.default_rng(seed).normal(0, 0.1, cls.length(words)).astype(np.float32), words)
        m.weights[:] = 1
        m.bias[:] = words.row_freq()
        return m

    def vectors(self, x: np.ndarray) -> np.ndarray:
        """The context vector of each word of ``x`` but the first CONTEXT."""
        held, n = self.context[x], len(x) - CONTEXT
        return sum(held[CONTEXT - 1 - j : CONTEXT - 1 - j + n] * self.weights[j] for j in range(CONTEXT))


def padded(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The texts one after another, each after CONTEXT times ``start``."""
    begin = np.repeat(np.arange(1, len(bounds)) * CONTEXT, np.diff(bounds))
    out = np.full(len(ids) + CONTEXT * (len(bounds) - 1), start, dtype=np.int64)
    out[np.arange(len(ids)) + begin] = ids
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, dtype=np.int64)


def _paces(words: Words) -> dict[str, slice]:
    """Where the squares of each kind of parameters lie: one for each vector, by its mean, and one for each bias."""
    out, at, found = words.size + words.groups, 0, {}
    for name, n in (("context", words.size + 1), ("target", out), ("weights", CONTEXT), ("bias", out)):
        found[name] = slice(at, at + n)
        at += n
    return found


class Trainer:
    """AdaGrad, with a pace for each vector, on the noise-contrastive objective, batch by batch.

    Within a batch all is done in the order of word ids, so that the sums of gradients are over runs
    and the words of a group are a slice."""

    def __init__(self, words: Words, seed: list[int], flat: np.ndarray | None = None, squares: np.ndarray | None = None):
        self.words, self.seen = words, 0
        self.model = Model.start(words) if flat is None else Model(flat.copy(), words)
        paces = _paces(words)
        self.squares = np.full(paces["bias"].stop, 1e-10, dtype=np.float32) if squares is None else squares.copy()
        self._squares = {name: self.squares[at] for name, at in paces.items()}
        self._rng = np.random.default_rng(seed)
        self._freq, self._sizes = words.row_freq(), words.sizes()
        self._rows = np.r_[: words.direct, words.size : words.size + words.groups]
        self._cumulative = np.cumsum(np.exp(self._freq[self._rows].astype(float)))

    def _step(self, name: str, rows: np.ndarray | slice, gradient: np.ndarray) -> None:
        squares, wide = self._squares[name], gradient.ndim > 1
        now = squares[rows] + (np.einsum("ij,ij->i", gradient, gradient) / DIMENSIONS if wide else gradient * gradient)
        squares[rows] = now
        pace = np.float32(RATE) / np.sqrt(now)
        getattr(self.model, name)[rows] += gradient * (pace[:, None] if wide else pace)

    def _towards(self, rows: np.ndarray, counts: np.ndarray, q: np.ndarray, log_noise: np.ndarray, dq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of targets and biases of the true ``rows``, each of a run of ``counts`` words; adds to ``dq``."""
        m = self.model
        target = np.repeat(m.target[rows], counts, axis=0)
        up = _sigmoid(np.repeat(log_noise - m.bias[rows], counts) - np.einsum("ij,ij->i", q, target))
        target *= up[:, None]
        dq += target
        begin = np.cumsum(counts) - counts
        return np.add.reduceat(np.multiply(q, up[:, None], out=target), begin, axis=0), np.add.reduceat(up, begin)

    def _in_groups(self, ids: np.ndarray, begin: np.ndarray, counts: np.ndarray, q: np.ndarray, dq: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows and gradients for words, in the order of ids, within their groups; adds to ``dq``."""
        m, words = self.model, self.words
        g = (ids[begin] - words.direct) // words.group
        first = _starts(g)
        g, bounds = g[first], [*begin[first].tolist(), len(ids)]
        log_noise = np.log(GROUP_NOISE / self._sizes[g]).astype(np.float32)
        own = self._towards(ids[begin], counts, q, np.repeat(log_noise, np.diff([*first, len(begin)])), dq)
        others = words.direct + g[:, None] * words.group + (self._rng.random((len(g), GROUP_NOISE)) * self._sizes[g][:, None]).astype(np.int64)
        other, bias = m.target[others], m.bias[others] - log_noise[:, None]
        pulled, pushed = np.empty_like(other), np.empty_like(bias)
        for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
            down = q[i:j] @ other[k].T
            down += bias[k]
            down = _sigmoid(down)
            dq[i:j] -= down @ other[k]
            pulled[k], pushed[k] = -(down.T @ q[i:j]), -down.sum(0)
        return [(ids[begin], *own), (others.ravel(), pulled.reshape(-1, DIMENSIONS), pushed.ravel())]

    def learn(self, x: np.ndarray) -> None:
        """One batch: the words of ``x`` after the first CONTEXT, which are context only, as are texts' starts."""
        m, words = self.model, self.words
        before, here = m.vectors(x), x[CONTEXT:]
        order = np.argsort(here)
        order = order[: np.count_nonzero(here < words.size)]  # starts come last
        if not len(order):
            return
        ids, q = here[order], before[order]
        begin = _starts(ids)
        counts = np.diff([*begin, len(ids)])
        cut = int(np.searchsorted(ids, words.direct))  # from here on words of groups
        k = int(np.searchsorted(begin, cut))
        noise = self._rows[np.minimum(np.searchsorted(self._cumulative, self._rng.random(NOISE) * self._cumulative[-1]), len(self._rows) - 1)]
        others = m.target[noise]
        down = q @ others.T
        down += m.bias[noise] - self._freq[noise] - np.float32(np.log(NOISE))
        down = _sigmoid(down)
        dq = -(down @ others)
        parts = [(noise, -(down.T @ q), -down.sum(0))]
        group = words.size + (ids[begin[k:]] - words.direct) // words.group
        run = _starts(group)
        rows = np.concatenate([ids[begin[:k]], group[run]])
        sums = np.concatenate([counts[:k], np.add.reduceat(counts[k:], run) if len(run) else counts[:0]])
        parts.append((rows, *self._towards(rows, sums, q, self._freq[rows] + np.float32(np.log(NOISE)), dq)))
        if cut < len(ids):
            parts += self._in_groups(ids[cut:], begin[k:] - cut, counts[k:], q[cut:], dq[cut:])
        n = np.float32(len(ids))
        rows = np.concatenate([p[0] for p in parts])
        by = np.argsort(rows, kind="stable")
        at = _starts(rows[by])
        for name, j in (("target", 1), ("bias", 2)):
            self._step(name, rows[by][at], np.add.reduceat(np.concatenate([p[j] for p in parts])[by], at, axis=0) / n)
        # What a word gets as context is from the words after it.
        back = np.zeros((len(x), DIMENSIONS), dtype=np.float32)
        ahead = np.zeros_like(before)
        ahead[order] = dq
        held, size = m.context[x], len(here)
        turned = []
        for j in range(CONTEXT):
            at = slice(CONTEXT - 1 - j, CONTEXT - 1 - j + size)
            back[at] += ahead * m.weights[j]
            turned.append(np.einsum("ij,ij->j", ahead, held[at]))
        by = np.argsort(x)
        at = _starts(x[by])
        self._step("context", x[by][at], np.add.reduceat(back[by], at, axis=0) / n)
        self._step("weights", slice(None), np.stack(turned) / n)
        self.seen += len(ids)


def _pieces(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Padded texts as batches, each with the CONTEXT words before it."""
    held = np.empty(0, dtype=np.int64)
    for x in parts:
        held = np.concatenate([held, x])
        while len(held) >= BATCH + CONTEXT:
            yield held[: BATCH + CONTEXT]
            held = held[BATCH:]
    if len(held) > CONTEXT:
        yield held


def _round(docs: DataFrame, words: Words, r: int, rounds: int, before: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The averaged parameters and squares after one round; None if it has no words."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((words.local(), before))
    length = Model.length(words)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = held.value
        shard = TaskContext.get().partitionId()
        trainer = None
        texts = (padded(known.ids(h), bounds, known.size) for b in batches for _, _, h, bounds in words_of(b.column(0)) if len(h))
        for x in _pieces(texts):
            trainer = trainer or Trainer(known, [r, shard], *(start or ()))
            trainer.learn(x)
        if trainer is not None and trainer.seen:
            both = np.concatenate([trainer.model.flat, trainer.squares])
            values = [both[i : i + BLOCK].tobytes() for i in range(0, len(both), BLOCK)]
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([trainer.seen] * n, pa.int64()), pa.array(values, pa.binary())], names=["block", "shard", "words", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for b in batches:
            for block, _, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, dtype=np.float32) * float(n)
                seen[block] = seen.get(block, 0) + n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(s / seen[b]).astype(np.float32).tobytes() for b, s in sums.items()], pa.binary())], names=["block", "sums"])

    key = F.xxhash64("text")
    texts = pick(docs, "text").filter("text is not null").withColumn("k", key).filter(F.pmod("k", F.lit(rounds)) == r)
    texts = texts.repartition(shards(words.total), "k").sortWithinPartitions("k", "text").select("text")
    models = texts.mapInArrow(local, "block int, shard int, words long, sums binary")
    n = min(-(-length // BLOCK), 48)
    found = models.repartition(n, "block").sortWithinPartitions("block", "shard").mapInArrow(total, "block int, sums binary").collect()
    if not found:
        return None
    both = np.concatenate([np.frombuffer(x["sums"], dtype=np.float32) for x in sorted(found)])
    return both[:length], both[length:]


def train(docs: DataFrame, words: Words, rounds: int = ROUNDS) -> Model:
    """One pass over all texts in ``rounds`` rounds of averaging."""
    now = None
    for r in range(rounds):
        now = _round(docs, words, r, rounds, now) or now
    return Model.start(words) if now is None else Model(now[0], words)


class Scorer:
    """Normalised log probabilities of classes; the normalisers of KEPT contexts are kept."""

    def __init__(self, words: Words, model: Model):
        self.words, self.model = words, model
        rows = np.r_[: words.direct, words.size : words.size + words.groups]
        self._top = self._with_bias(rows)
        self._keys, self._normalisers = np.full(KEPT, -1), np.empty(KEPT, dtype=np.float32)

    def _with_bias(self, rows: np.ndarray | slice) -> np.ndarray:
        """A column for each row: its vector, and its bias, which meets the 1 at the end of a context's vector."""
        return np.vstack([self.model.target[rows].T, self.model.bias[rows]])

    def _normalise(self, code: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The logarithm of the sum over all classes and groups, for distinct contexts and their vectors."""
        slot = (mix(code.view(np.uint64)) % np.uint64(KEPT)).astype(np.int64)
        out = self._normalisers[slot]
        new = np.flatnonzero(self._keys[slot] != code)
        for i in range(0, len(new), ROWS):
            some = new[i : i + ROWS]
            out[some] = _log_sums(q[some], self._top)
        self._keys[slot[new]], self._normalisers[slot[new]] = code[new], out[new]
        return out

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Of the words of ``x`` after the first CONTEXT (0 of texts' starts)."""
        m, words = self.model, self.words
        out = np.zeros(max(0, len(x) - CONTEXT))
        here = x[CONTEXT:]
        at = np.argsort(here)
        at = at[: np.count_nonzero(here < words.size)]
        if not len(at):
            return out
        ids, q = here[at], np.ones((len(at), DIMENSIONS + 1), dtype=np.float32)
        q[:, :-1] = m.vectors(x)[at]
        code = x[CONTEXT - 1 : -1]
        for j in range(1, CONTEXT):
            code = code * (words.size + 1) + x[CONTEXT - 1 - j : -1 - j]
        code, one, which = np.unique(code[at], return_index=True, return_inverse=True)
        cut = int(np.searchsorted(ids, words.direct))
        g = (ids[cut:] - words.direct) // words.group
        top = np.concatenate([ids[:cut], words.size + g])
        score = np.einsum("ij,ij->i", q[:, :-1], m.target[top]) + m.bias[top] - self._normalise(code, q[one])[which]
        first = _starts(g)
        for i, j in zip((cut + first).tolist(), [*(cut + first[1:]).tolist(), len(ids)]):
            begin = words.direct + int(g[i - cut]) * words.group
            vectors = self._with_bias(slice(begin, min(begin + words.group, words.size)))
            for k in range(i, j, ROWS):
                some, own = slice(k, min(j, k + ROWS)), ids[k : min(j, k + ROWS)]
                score[some] += np.einsum("ij,ij->i", q[some, :-1], m.target[own]) + m.bias[own] - _log_sums(q[some], vectors)
        out[at] = score
        return out


def _log_sums(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of exponentials of each row's products."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        scores = q @ vectors
        out = np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], dtype=np.float32))
    far = np.flatnonzero(~np.isfinite(out))
    if len(far):  # beyond what 32 bits hold
        scores = q[far] @ vectors
        high = scores.max(axis=1)
        out[far] = np.log(np.exp(scores - high[:, None]).sum(axis=1)) + high
    return out


def score(docs: DataFrame, words: Words, model: Model) -> DataFrame:
    """A row for each document: doc_id, n_words, log_prob (natural, the mean of its words) and total_log_prob."""
    held = docs.sparkSession.sparkContext.broadcast((words.local(), model.flat))
    d = pick(docs, "doc_id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = held.value
        scorer = Scorer(known, Model(flat, known))
        log_rest, row = np.log(known.rest), TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j, found, bounds in words_of(b.column("text")):
                ids = known.ids(found)
                x = padded(ids, bounds, known.size)
                each_word = scorer.log_probs(x)[x[CONTEXT:] < known.size]
                shared = np.flatnonzero(ids < BUCKETS)
                each_word[shared] -= log_rest[ids[shared]]
                total = np.diff(np.concatenate([[0], np.cumsum(each_word)])[bounds])
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(shared, bounds), pa.int32()), pa.array(found[shared].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + j - i)), b.column("doc_id")[i:j], pa.array(np.diff(bounds).astype(np.int32)), pa.array(total), rest], names=["row", "doc_id", "n_words", "total", "rest"])
                row += j - i

    scored, _ = stash(d.mapInArrow(each, f"row long, doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words int, total double, rest array<long>"), "scored")
    # log P(word | class) is log n less the class's log total, which is in total already.
    shared = scored.select("row", F.explode("rest").alias("word")).join(words.rare, "word", "left")
    more = shared.groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(1)).cast("double"))).alias("more"))
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, total / F.col("n_words"))
    return scored.drop("rest").join(more, "row", "left").select("doc_id", "n_words", mean.alias("log_prob"), total.alias("total_log_prob"))


def query(docs: DataFrame) -> DataFrame:
    """Every document's score under the model of the corpus."""
    words = vocabulary(docs)
    return score(docs, words, train(docs, words))
