import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from samples import ODD, empty, odd, sentence

from geotrail.llm import partenum


def sets_of(rows, size):
    out = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        runs = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
        out.append((i, runs))
    return out


def brute(rows, size, percent):
    """Number of shingles and component of each row, all pairs compared."""
    sets = sets_of(rows, size)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return collections.Counter((i, len(s), least.get(root(k))) for k, (i, s) in enumerate(sets))


def joined(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def test_odd_rows(spark):
    want = brute([(i, t) for i, t, _ in ODD], 3, 90)
    assert joined(partenum.jaccard_components(odd(spark))) == want


def edited(words, changes, r):
    words = list(words)
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_families_of_near_copies(spark, size, percent):
    """Copies at all distances around the threshold, chains, sizes at the edges of bands."""
    r = random.Random(size)
    texts = [sentence(s, n) for s, n in enumerate([4, 9, 11, 12, 13, 21, 22, 60, 200])]
    for base in list(texts):
        words = base.split()
        texts += [edited(words, k, r) for k in (0, 1, 1, 2, 3) for _ in range(2)]
        texts += [" ".join(words[k:]) for k in (1, 2)]
    chain = sentence(99, 150).split()
    for _ in range(8):
        chain = edited(chain, 2, r).split()
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    docs = odd(spark, [(i, t, "s") for i, t in rows])
    got = joined(partenum.jaccard_components(docs, shingle=size, percent=percent))
    assert got == brute(rows, size, percent)


def test_two_large_families_under_common_signatures(spark):
    """Members of a family are linked, the two families are not, and single ones are between."""
    r = random.Random(5)
    base = sentence(1, 120).split()
    other = edited(base, 8, r).split()
    texts = [edited(base, 1, r) for _ in range(40)] + [edited(other, 1, r) for _ in range(40)]
    texts += [edited(base, 5, r) for _ in range(30)]
    rows = list(enumerate(texts))
    got = joined(partenum.jaccard_components(odd(spark, [(i, t, "s") for i, t in rows])))
    assert got == brute(rows, 3, 90)


SCHEMES = [
    (90, partenum.Scheme()),
    (90, partenum.Scheme(ways=3, reach=2, excess=0.5)),
    (80, partenum.LOOSE),
    (80, partenum.Scheme(ways=2, reach=1, excess=1.0)),
]


@pytest.mark.parametrize("percent,scheme", SCHEMES)
def test_linked_sets_share_a_signature_in_more_parts_than_there_are_to_spare(percent, scheme):
    """The guarantee itself, for sizes in one band and in neighbouring ones."""
    random_ = np.random.default_rng(1)
    low = (1 << partenum.PART_BITS + 1) - 1
    for size in (10, 11, 19, 20, 40, 95, 300):
        for _ in range(20):
            a = np.unique(random_.integers(0, 2**63, size).astype(np.uint64))
            drop = int(random_.integers(0, size * (100 - percent) // 100 + 1))
            add = random_.integers(0, 2**63, int(random_.integers(0, 3))).astype(np.uint64)
            b = np.unique(np.concatenate([a[drop:], add]))
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            sizes = np.array([len(a), len(b)])
            found, owner = partenum.signatures(np.concatenate([a, b]), sizes, percent, scheme)
            common = np.intersect1d(found[owner == 0], found[owner == 1])
            parts = collections.Counter(part >> partenum.PART_BITS for part in set(common & low))
            spare = partenum.spare_parts(sizes, percent, scheme)
            assert max(parts.values()) > max(spare)


def test_sets_of_more_parts_than_signatures_can_name_keep_them_all():
    sizes = np.array([0, 1, 300, 10**7])
    spare = partenum.spare_parts(sizes, 80, partenum.LOOSE)
    assert spare[3] == -1 and (spare[:3] >= 0).all()


@pytest.mark.parametrize("scheme", [s for p, s in SCHEMES if p == 80])
@pytest.mark.parametrize("heavy", [1, 3])
def test_heavy_signatures_lose_no_link(spark, monkeypatch, scheme, heavy):
    """Near copies that share a passage with all others, with almost every signature heavy."""
    monkeypatch.setattr(partenum, "HEAVY", heavy)
    r = random.Random(heavy)
    passage = sentence(500, 60)
    texts = []
    for n in range(12):
        base = f"{sentence(n, 30 + 25 * n)} {passage}".split()
        texts += [edited(base, k, r) for k in (0, 1, 1, 2, 3, 5)]
        texts.append(" ".join(base[n:]))
    rows = list(enumerate(texts))
    docs = odd(spark, [(i, t, "s") for i, t in rows])
    got = joined(partenum.jaccard_components(docs, shingle=5, percent=80, scheme=scheme))
    assert got == brute(rows, 5, 80)


def crowded_block(members, sizes):
    """A block of near copies of sets of these sizes, each a component and a stray by itself."""
    random_ = np.random.default_rng(7)
    sets = []
    for size in sizes:
        base = random_.integers(0, 2**63, size).astype(np.uint64)
        for k in range(members):
            new = random_.integers(0, 2**63, k % max(2, size // 12)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[len(new) :], new])))
    counts = np.array([len(s) for s in sets])
    sketch = partenum._sketches(np.concatenate(sets), counts, 90)
    n = len(sets)
    columns = {
        "class": pa.array(range(n), pa.int64()),
        "component": pa.array(range(n), pa.int64()),
        "n": pa.array(counts, pa.int64()),
        "sketch": pa.array(sketch, pa.binary()),
    }
    both = [pa.table({**columns, "stray": pa.array([stray] * n)}) for stray in (False, True)]
    return pa.concat_tables(both), counts, sketch


def near_pairs(counts, sketch, percent=90):
    """The pairs of a block that whole sketches cannot rule out."""
    out = set()
    for b in range(len(counts)):
        for a in range(b):
            parts, size = min(len(sketch[a]), len(sketch[b])), int(counts[a] + counts[b])
            left, right = (partenum._folded(sketch[x], parts) for x in (a, b))
            far = int((left != right).sum())
            fit = min(counts[a], counts[b]) * 100 >= max(counts[a], counts[b]) * percent
            if fit and far * (100 + percent) <= (100 - percent) * size:
                out.add((a, b))
    return out


def reach(pairs, n):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_a_crowded_block_gives_no_more_rows_than_members(spark):
    """Near copies that are all apart: the first pairs are as few as join what all of them join,
    and later ones are those alone that whole sketches leave."""
    table, counts, sketch = crowded_block(60, (40, 320, 333))
    want = near_pairs(counts, sketch)
    found = [partenum._cross(90, every)(table).to_pydict() for every in (False, True)]
    first, all_of_them = (list(zip(t["a"], t["b"])) for t in found)
    assert len(want) > 10 * len(counts) > 10 * len(first)
    assert set(first) <= want and set(all_of_them) == want
    assert reach(first, len(counts)) == reach(want, len(counts))


def test_rows_that_stay(spark):
    kept = partenum.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    # Ids 4 and 5 are one text in lower case and blanks, 7 and 8 are near 6.
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == [0, 1, 2, 3, 4, 6, 9, 11, 12]


def test_empty_table(spark):
    assert partenum.jaccard_components(empty(spark)).count() == 0
    assert partenum.one_of_each(empty(spark)).count() == 0
