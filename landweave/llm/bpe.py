"""Byte-level BPE from a file of ranks."""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterable

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary cuts text before merging (that of the public GPT-2 encoder).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Texts to little-endian ids of 2 bytes (4 for vocabularies of over 65,536 entries).

    Keeping the ids of repeated words was measured and was no faster: a tenth of the
    words are new, and single words cost three times their share of a text.
    """

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: The first id that the vocabulary leaves free.
        self.end = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self._kind = "H" if self.dtype.itemsize == 2 else "I"

    def encode(self, text: str) -> bytes:
        ids = array(self._kind, self._bpe.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        return self._bpe.decode(list(ids))
