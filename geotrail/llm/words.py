"""Words of Arrow text columns as 64-bit hashes, many texts at a time, in numpy.

A word is hashed as a polynomial over random values of its bytes, modulo 2**64: the sum over its
bytes of ``VALUES[byte] * BASE**position``. Running sums over a whole block of texts give every
word, and every prefix of a word, by a subtraction and a multiplication. A final mixing step
spreads the bits. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
BASE = 0x9E6C63D0876A46AD
_INVERSE = pow(BASE, -1, 1 << 64)
_BLANKS = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint8)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply, shift and xor)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x632BE59BD9B4E019 * (2 * seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _byte_values() -> np.ndarray:
    values = mixed(np.arange(256, dtype=np.uint64), seed=7) | np.uint64(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


VALUES = _byte_values()


def blanks_only() -> np.ndarray:
    """Which bytes separate words: blank and tab to carriage return."""
    table = np.zeros(256, dtype=bool)
    table[_BLANKS] = True
    return table


def non_letters() -> np.ndarray:
    """Separators that leave runs of letters: all ASCII but A-Z and a-z."""
    table = np.zeros(256, dtype=bool)
    table[:128] = True
    for first, last in ((ord("A"), ord("Z")), (ord("a"), ord("z"))):
        table[first : last + 1] = False
    return table


class Powers:
    """Powers of the base and of its inverse, as many as the largest block so far needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def cover(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", _INVERSE)):
                    steps = np.full(n, base, dtype=np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_POWERS = Powers()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row and where each text starts and ends; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``block_bytes`` of text; a longer text is a block of its own."""
    sizes = np.diff(text_bytes(texts)[1])
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > block_bytes:
            yield start, row
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def word_hashes(
    texts: pa.Array, separators: np.ndarray | None = None, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of all words in order, the number of words of each text, and for each length in
    ``prefixes`` the hashes of the words cut to so many bytes."""
    data, offsets = text_bytes(texts)
    separators = blanks_only() if separators is None else separators
    _POWERS.cover(len(data) + 1)
    inside = ~separators[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[first] = inside[first]
    starts = np.flatnonzero(opens)
    # A word ends before the next separator or before the next text.
    shut = np.ones(len(data) + 1, dtype=bool)
    shut[:-1] = ~inside
    shut[first] = True
    stops = np.flatnonzero(shut)
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    counts = np.diff(np.searchsorted(starts, offsets))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(VALUES[data] * _POWERS.up[: len(data)], out=sums[1:])
        below, scale = sums[starts], _POWERS.down[starts]
        words = mixed((sums[ends] - below) * scale)
        cut = [
            mixed((sums[np.minimum(starts + n, ends)] - below) * scale, seed=n) for n in prefixes
        ]
    return words, counts, cut


def shingle_hashes(
    words: np.ndarray, counts: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text and how many each has; a text with
    fewer words has one, of all its words, and a text without words has none."""
    ends = np.cumsum(counts)
    starts = ends - counts
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    total = int(runs.sum())
    text = np.repeat(np.arange(len(counts)), runs)
    first = np.arange(total) - np.repeat(np.cumsum(runs) - runs, runs) + starts[text]
    length = np.minimum(counts, size)[text]
    with np.errstate(over="ignore"):
        out = mixed(length.astype(np.uint64), seed=3)
        for k in range(size):
            has = k < length
            at = np.minimum(first + k, max(len(words) - 1, 0))
            step = mixed(out * np.uint64(BASE) + words[at]) if total else out
            out = np.where(has, step, out)
    return out, runs
