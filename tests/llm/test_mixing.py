import collections
import re

import numpy as np
import pytest
from samples import ODD, empty, odd, sentence

from geotrail.llm import mixing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights, share, most):
    """The excess above a source's limit is shared again until there is none."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, full = [0.0] * len(sizes), set()
    while True:
        left = share * sum(sizes) - sum(most * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        for i in free:
            out[i] = left * weight[i] / sum(weight[j] for j in free)
        above = [i for i in free if out[i] > most * sizes[i]]
        if not above:
            return out
        for i in above:
            out[i] = most * sizes[i]
            full.add(i)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 5, 0, 70], [3], [5, 5000, 5]])
def test_targets(sizes):
    got = mixing.targets(sizes, mixing.Mix())
    assert got == pytest.approx(plain_targets(sizes, (5, 2, 1), 1.5, 2.0))


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_the_tree_splits_the_quotas_exactly(shards):
    quotas = np.array([50, 0, 3, 400])
    parts = [mixing.shard_quotas(quotas, shards, s, 1) for s in range(shards)]
    assert (parts[0][0] == 0).all() and (parts[-1][1] == quotas).all()
    for (_, end), (begin, _) in zip(parts, parts[1:]):
        assert (end == begin).all()
    totals = [int((end - begin).sum()) for begin, end in parts]
    assert max(totals) - min(totals) <= int(np.ceil(np.log2(shards))) + 1


def check(spark, rows, mix):
    mixture = mixing.Mixture(odd(spark, rows), mix)
    sizes = mixture.sizes().collect()
    taken = mixture.taken().collect()
    assert sorted(r["size"] for r in sizes) == sorted(n_words(t) for _, t, _ in rows)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    of_source = [sum(n_words(t) for _, t, s in rows if s == name) for name in names]
    want = plain_targets(of_source, (5, 2, 1), 1.5, 2.0)
    got = collections.Counter()
    for r in taken:
        got[r["source"]] += r["words"]
        assert 0 < r["words"] <= r["size"]
    assert [got[i] for i in range(len(names))] == pytest.approx(want, abs=0.51)
    docs = mixture.documents()
    assert docs.columns[2:] == odd(spark).columns
    words = collections.Counter()
    for r in docs.collect():
        words[r.source] += n_words(r.text)
    assert [words[name] for name in names] == pytest.approx(want, abs=0.51)
    again = mixing.Mixture(odd(spark, rows), mix).documents()
    assert sorted(map(repr, again.collect())) == sorted(map(repr, docs.collect()))
    return mixture, taken, docs


def test_odd_rows(spark):
    mixture, taken, _ = check(spark, ODD, mixing.Mix(blocks=8, shard_words=5000))
    per_document = collections.Counter()
    for r in taken:
        per_document[r["doc_id"], r["size"]] += r["words"]
    rows = collections.Counter((i, n_words(t)) for i, t, _ in ODD)
    for key, words in per_document.items():
        assert words <= 2 * key[1] * rows[key]


def test_shards_get_disjoint_blocks_of_all_sources(spark):
    rows = [(i, sentence(i, 10 + i % 30), "hot" if i % 3 else f"s{i % 4}") for i in range(400)]
    _, taken, docs = check(spark, rows, mixing.Mix(blocks=64, shard_words=1000))
    places = [(r["source"], r["block"], r["copy"]) for r in taken]
    shards = collections.defaultdict(set)
    for place, r in zip(places, taken):
        shards[place].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
    found = docs.collect()
    assert len({r["_shard"] for r in found}) > 5
    assert len({(r["_shard"], r["_position"]) for r in found}) == len(found)


def test_empty_table(spark):
    mixture = mixing.Mixture(empty(spark))
    assert mixture.sizes().count() == mixture.taken().count() == mixture.documents().count() == 0
