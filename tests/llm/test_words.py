"""Vectorised word hashes against plain splitting."""

import random
import re

import pyarrow as pa
import pytest

from geotrail.llm import words as W


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("seed", range(5))
def test_hashes_stand_for_words_prefixes_and_shingles(seed):
    r = random.Random(seed)
    for _ in range(60):
        texts = [
            r.choice([None, "", "  ", "".join(r.choice("aAbB \t\n\x0bé\x00") for _ in range(30))])
            for _ in range(r.randint(1, 6))
        ]
        column = pa.array(["before", *texts], pa.string()).slice(1)
        hashes, counts, (cut,) = W.word_hashes(column, prefixes=(2,))
        words = [re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) for t in texts]
        assert counts.tolist() == [len(w) for w in words]
        flat = [w for of_text in words for w in of_text]
        assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
        starts = [w.encode()[:2] for w in flat]
        assert len(set(zip(starts, cut.tolist()))) == len(set(starts)) == len(set(cut.tolist()))
        found, runs = W.shingle_hashes(hashes, counts, 3)
        shingles = [
            [tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else [] for w in words
        ]
        assert runs.tolist() == [len(s) for s in shingles]
        flat = [s for of_text in shingles for s in of_text]
        assert len(set(zip(flat, found.tolist()))) == len(set(flat)) == len(set(found.tolist()))


def test_blocks_cover_all_rows():
    column = pa.array(["a" * 10, None, "b" * 50, "", "c"])
    spans = list(W.blocks(column, 20))
    assert spans == [(0, 2), (2, 3), (3, 5)]
    assert list(W.blocks(pa.array([], pa.string()))) == []
