"""Subword ids of whole texts."""

from __future__ import annotations

import base64
import re
from functools import cached_property
from collections.abc import Iterable

import numpy as np

VOCABULARY = "byte_bpe_50k"
END_ID = 0
SPECIAL = "<|endoftext|>"
#: The fast encoder goes down a level for each blank of a run, and does not come back from runs
#: of half a million. Runs from this length on take the slower way.
LONG_RUN = 1 << 14
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


class Encoder:
    """Encodes texts to the ids that ``tokenizers`` gives with the JSON file of the vocabulary.

    The same vocabulary as ranks is several times faster and gives the same ids, but for the
    special token, which is ordinary text to it; texts that hold it, or a very long run of white
    space, take the slower way."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    @cached_property
    def exact(self):
        """Read only where a text needs it."""
        import public_tokenizers
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(f"{self.vocabulary}.json"))

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text, without any end; none for a null."""
        if not text:
            return []
        if SPECIAL in text or (len(text) >= LONG_RUN and _LONG_RUN.search(text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def encode_all(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        found = [np.array(self.encode(text), dtype=np.uint16) for text in texts]
        flat = np.concatenate(found) if found else np.zeros(0, dtype=np.uint16)
        return flat, np.array([len(ids) for ids in found], dtype=np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder for each Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]
