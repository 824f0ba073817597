"""Byte-level BPE ids, as the tokenizers library gives them, at the speed of its rank table.

Ids come from ``tokenizers``. Where a text holds no added token and only Latin
letters and common punctuation, the same vocabulary's ranks give the same ids
about four times as fast; other texts go to the library itself.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quire.llm.wordhash import texts_of


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _ranks(path: str):
    """The rank table beside the vocabulary file, or None."""
    beside = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(beside):
        return None
    import public_tokenizers
    import tiktoken

    with open(beside, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def uncommon(column: pa.Array, lead: int = 0xCC) -> np.ndarray:
    """Per text: whether it has characters other than those below a lead byte (0xCC: U+0300) and U+2000 to U+20BF."""
    data, offsets = texts_of(column)
    odd = data >= lead
    if odd.any():
        at = np.flatnonzero(odd)
        following = data[np.minimum(at + 1, len(data) - 1)]
        at = at[~((data[at] == 0xE2) & (following >= 0x80) & (following <= 0x82))]
    else:
        at = np.empty(0, np.int64)
    counts = np.searchsorted(at, offsets)
    return counts[1:] > counts[:-1]


def added_tokens(path: str) -> list[str]:
    return [t.content for t in library(path).get_added_tokens_decoder().values()]


class Encoder:
    """ids(texts): a list of ids for each text, no special tokens added.

    ``added`` are the vocabulary's added tokens. With them given, a task loads
    the library only when it meets a text that needs it.
    """

    def __init__(self, path: str, added: list[str] | None = None):
        self.path = path
        self.added = added_tokens(path) if added is None else added

    def ids(self, column: pa.Array):
        slow, ranks = uncommon(column), _ranks(self.path)
        for text, odd in zip(column.to_pylist(), slow, strict=True):
            text = text or ""
            if ranks is None or odd or any(a in text for a in self.added):
                yield library(self.path).encode(text, add_special_tokens=False).ids
            else:
                yield ranks.encode_ordinary(text)
