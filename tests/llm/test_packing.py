import collections
import random
import struct
import zlib

import pytest
from samples import ODD, empty, odd
from tokenizers import Tokenizer

import public_tokenizers
from geotrail.llm import packing


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_the_histogram(seed):
    r = random.Random(seed)
    counts = collections.Counter(min(64, int(r.expovariate(1 / 20)) + 1) for _ in range(3000))
    found = packing.patterns(dict(counts), 64)
    held, filled, room = collections.Counter(), 0, 0
    for kind in found:
        assert kind.packs > 0 and sum(kind.lengths) <= 64
        for size in kind.lengths:
            held[size] += kind.packs
        filled += sum(kind.lengths) * kind.packs
        room += (sum(kind.lengths) + packing.padding(sum(kind.lengths), 64)) * kind.packs
    assert held == counts and filled / room > 0.9
    # The work follows the lengths, not the pieces.
    assert len(found) < 4 * 64


def test_ranges_number_every_rank_once():
    found = packing.ranges(packing.patterns({5: 7, 3: 20, 1: 4}, 8))
    for size, n in ((5, 7), (3, 20), (1, 4)):
        spans = sorted((a, b) for length, a, b, _, _ in found if length == size)
        assert [k for a, b in spans for k in range(a, b + 1)] == list(range(n))


@pytest.mark.parametrize("slices", [1, 7])
def test_every_id_is_packed_once(spark, slices):
    got = packing.packed(packing.pieces(odd(spark)), slices=slices).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, _ in ODD:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [0]
        for a in range(0, len(ids), 1024):
            some = ids[a : a + 1024]
            want[i, a, struct.pack(f"<{len(some)}I", *some), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in got) == want
    by_sequence = collections.defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_sequence) == set(range(len(by_sequence)))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_checksum(spark):
    ids = struct.pack("<3I", 5, 70000, 0)
    row = spark.createDataFrame([(bytearray(ids),)], "ids binary")
    assert row.select(packing.checksum(row.ids)).first()[0] == zlib.crc32(ids)


def test_empty_table(spark):
    assert packing.packed(packing.pieces(empty(spark))).count() == 0
