"""The fast encoder gives the ids of the JSON file."""

import random

import pytest

from geotrail.llm.subwords import Encoder

PARTS = ["a", "B", "é", " ", "  ", "\n", " \n", "\t", "1", "'s", "'", ".", "ll", "\xa0", "　"]
PARTS += ["<|endoftext|>", "日本", "🙂", "\x85", "\r\n", "the", "​"]


def test_ids_are_those_of_the_tokenizer():
    encoder, r = Encoder(), random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    flat, counts = encoder.encode_all([*texts, None])
    want = [encoder.exact.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
    assert counts.tolist() == [len(ids) for ids in want]
    assert flat.tolist() == [i for ids in want for i in ids]


@pytest.mark.parametrize("run", [" ", "\n", "\t", ".", "7", "x", "\xa0", "ab "])
def test_very_long_runs(run):
    encoder = Encoder()
    text = "start" + run * 1_000_000 + "end"
    assert encoder.encode(text) == encoder.exact.encode(text, add_special_tokens=False).ids
