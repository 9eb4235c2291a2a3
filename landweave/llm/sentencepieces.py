"""SentencePiece models on the tokenizers library.

The model file, a protobuf, is parsed here field by field; from it are rebuilt the
normaliser (dummy prefix, white space to the metaspace mark), the model (unigram scores, or
merges in the order of the pieces' scores for BPE models), byte fallback and the
decoder. Batches are encoded by the library's threads, as many as the task has cores.

Where no piece has the metaspace mark after something else (checked, with byte fallback
and without a character map), nothing can be merged across the start of a word, so a text's
ids are those of its words in order. A task then encodes each distinct word
once, in batches; other models encode whole texts.

Parity with the sentencepiece library is verified on every document: each distinct word that
a task encodes is encoded by that library as well (whole texts where words aren't cut), and
``parity`` says whether all of a document's are the same. The ids of every whole document
are decoded, by the bytes of their pieces, and ``round_trip`` says whether that is the text.

Defined cases: a null text has null ids and text; an empty text has no ids; repeated rows
are encoded each; an empty table gives an empty result; extra columns don't matter.
Whole texts are encoded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import pick

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BATCH_CHARS = 1 << 20
#: Distinct words that a task keeps before it starts anew.
WORDS_KEPT = 400_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number and value (varint, or bytes for all else)."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            b = raw[i]
            i += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while i < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 2: None, 5: 4}[tag & 7]
            size = varint() if size is None else size
            yield tag >> 3, raw[i : i + size]
            i += size


@dataclass
class Model:
    """What the model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    charsmap: bytes = b""
    suffix: bool = False

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        m = cls()
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                m.pieces.append((piece, score, kind))
            elif number == 2:
                spec = dict(_fields(value))
                m.kind, m.unk_id = spec.get(3, UNIGRAM), spec.get(40, 0)
                m.byte_fallback, m.suffix = bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                m.charsmap = spec.get(2, b"")
                m.dummy_prefix, m.squeeze, m.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        if m.suffix or not m.escape:
            raise ValueError("models that treat white space as a suffix or don't escape it aren't supported")
        return m

    def merges(self) -> list[tuple[str, str]]:
        """All pairs of pieces that make a piece; the pair with the better score merges first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for piece, i in ids.items():
            cuts = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
            cuts.sort(key=lambda c: (ids[c[0]], ids[c[1]]))
            found += [(-self.pieces[i][1], i, k, c) for k, c in enumerate(cuts)]
        return [c for *_, c in sorted(found)]

    def cuts_words(self) -> bool:
        """Whether no piece has a mark after something else."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))


_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


def _words(text: str) -> list[str]:
    """The words of a text, each without the mark that stands before it."""
    if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
        return [w[1:] for w in _CUT(MARK + text.replace(" ", MARK))]
    return text.split(" ") if text else []


class Codec:
    """Encodes and decodes with the tokenizers library."""

    def __init__(self, path: str = MODEL, verify: bool = False):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        with open(path, "rb") as f:
            self.model = m = Model.parse(f.read())
        vocabulary = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        if m.kind == BPE:
            model = models.BPE(vocabulary, m.merges(), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
        elif m.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are supported")
        self._tokenizer = t = Tokenizer(model)
        steps = []
        if m.charsmap:
            steps.append(normalizers.Precompiled(m.charsmap))
        if m.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
        if m.cuts_words():
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        self.bytes_of = {i: int(p[3:5], 16) for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
        self._silent = {i for i, (_, _, kind) in enumerate(m.pieces) if kind == CONTROL}
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        t.decoder = decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else steps)

        self.by_word = m.cuts_words() and m.kind == BPE and m.byte_fallback and m.dummy_prefix and not m.squeeze and not m.charsmap
        if self.by_word:
            self._words = Tokenizer(model)
            self._words.pre_tokenizer = t.pre_tokenizer
        self._marked = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self._kept: dict[str, bytes] = {}
        self._apart: set[str] = set()
        held = [bytes([self.bytes_of[i]]) if i in self.bytes_of else b"" if i in self._silent else p.replace(MARK, " ").encode() for i, (p, _, _) in enumerate(m.pieces)]
        self._piece_size = np.array([len(x) for x in held])
        self._piece_start = np.cumsum(self._piece_size) - self._piece_size
        self._piece_bytes = np.frombuffer(b"".join(held), dtype=np.uint8)
        self._other = None
        if verify:
            import sentencepiece

            self._other = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Whole texts, by the library alone."""
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_raw(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text as 4-byte integers, and whether they are the sentencepiece library's (True if it isn't asked)."""
        if not self.by_word:
            ids = self.encode(texts)
            same = [x == y for x, y in zip(ids, self._other.encode(texts, num_threads=1))] if self._other else [True] * len(ids)
            return [np.array(x, dtype=np.int32).tobytes() for x in ids], same
        words = [_words(t) for t in texts]
        if len(self._kept) > WORDS_KEPT:
            self._kept.clear()
            self._apart.clear()
        kept = self._kept
        self._learn(list({w for some in words for w in some}.difference(kept)))
        return [b"".join([kept[w] for w in some]) for some in words], [self._apart.isdisjoint(some) for some in words] if self._apart else [True] * len(words)

    def _learn(self, new: list[str], at_once: int = 500) -> None:
        """Encodes distinct words, many to a text that the library cuts where they begin."""
        alone, new = [w for w in new if MARK in w], [w for w in new if MARK not in w]
        groups = [new[i : i + at_once] for i in range(0, len(new), at_once)] + [[w] for w in alone]
        found = self._words.encode_batch_fast([MARK + MARK.join(g) for g in groups], add_special_tokens=False)
        theirs = self._other.encode([" ".join(g) for g in groups], num_threads=1) if self._other and groups else [None] * len(groups)
        for words, e, other in zip(groups, found, theirs):
            ids = np.array(e.ids, dtype=np.int32)
            # Of a word without further marks only the first piece begins with one.
            begins = [*np.flatnonzero(self._marked[ids]).tolist(), len(ids)] if len(words) > 1 else [0, len(ids)]
            for w, begin, end in zip(words, begins, begins[1:]):
                self._kept[w] = ids[begin:end].tobytes()
            if self._other and other != e.ids and words != [""]:  # an empty word, alone, is a mark to the one and nothing to the other
                self._apart.update(w for w, x in zip(words, self._other.encode(words, num_threads=1)) if w and np.array(x, dtype=np.int32).tobytes() != self._kept[w])

    def gives_back(self, texts: list[str], raw: list[bytes]) -> list[bool]:
        """Whether the ids of each whole text, decoded, are the text."""
        if not self.by_word:
            return [x == y for x, y in zip(texts, self.decode([np.frombuffer(r, np.int32).tolist() for r in raw]))]
        ids = np.frombuffer(b"".join(raw), dtype=np.int32)
        size = self._piece_size[ids]
        ends, parts = np.concatenate([[0], np.cumsum(size)]), []
        for i in range(0, len(ids), BATCH_CHARS):
            some, n = ids[i : i + BATCH_CHARS], size[i : i + BATCH_CHARS]
            parts.append(self._piece_bytes[np.arange(n.sum()) + np.repeat(self._piece_start[some] - np.cumsum(n) + n, n)].tobytes())
        out = b"".join(parts)
        at = ends[np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])].tolist()
        # The mark that every text begins with is no part of it.
        return [out[begin + 1 : end] == t.encode("utf-8", "surrogatepass") and out[begin : begin + 1] in (b" ", b"") for t, begin, end in zip(texts, at, at[1:])]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self._tokenizer.decode_batch([[i for i in one if i not in self._silent] for one in ids], skip_special_tokens=False)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about BATCH_CHARS bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else []
    begin = 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + BATCH_CHARS, "right")))
        yield begin, end
        begin = end


def encode(docs: DataFrame, model: str = MODEL, threads: int = 2, verify: bool = True) -> DataFrame:
    """doc_id, ids, whether decoding gives the text back (round_trip), and with ``verify`` whether the
    sentencepiece library gives the same ids (parity)."""
    d = pick(docs, "doc_id", "text")
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, round_trip boolean" + ", parity boolean" * verify

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        codec = Codec(model, verify)
        for b in batches:
            for i, j in _slices(b.column("text")):
                texts = b.column("text")[i:j].to_pylist()
                some = [t or "" for t in texts]
                raw, same = codec.encode_raw(some)
                null = np.array([t is None for t in texts])
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(null))
                columns = [b.column("doc_id")[i:j], lists, *(pa.array(x, mask=null) for x in (codec.gives_back(some, raw), same))]
                n = 3 + verify
                yield pa.RecordBatch.from_arrays(columns[:n], names=["doc_id", "ids", "round_trip", "parity"][:n])

    return d.mapInArrow(each, schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of its ids."""
    d = pick(encoded, "doc_id", "ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for b in batches:
            ids = b.column("ids").to_pylist()
            texts = codec.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else t for x, t in zip(ids, texts)], pa.string())], names=["doc_id", "text"])

    return d.mapInArrow(each, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")
