import math
import random

import numpy as np
import pytest

from geotrail.llm import ball_kmeans
from geotrail.llm.ball_kmeans import Compression, Settings


def table(spark, rows):
    # Columns named as the operator's own.
    return spark.createDataFrame(
        [(*r, 1, "c", [2]) for r in rows],
        "vec_id long, embedding array<double>, label int, id int, codes string, errors array<int>",
    )


def plain(rows, settings):
    """Every part compared with every entry, in Python's whole numbers."""
    kept = [
        (i, [math.floor(x * settings.scale) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = max(-(-longest // settings.parts), 1)
    kept = [(i, v + [0] * (width * settings.parts - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cut = [[v[p * width : (p + 1) * width] for p in range(settings.parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[: settings.entries]] for p in range(settings.parts)]

    def found(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, e)), n) for n, e in enumerate(book))

    for _ in range(settings.rounds):
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for c in cut:
                own[found(c[p], book)[1]].append(c[p])
            for n, parts in enumerate(own):
                if parts:
                    book[n] = [sum(x) // len(parts) for x in zip(*parts)]
    out = []
    for (i, _, label), c in zip(kept, cut):
        best = [found(c[p], books[p]) for p in range(settings.parts)]
        out.append((i, label, [b[1] for b in best], [b[0] for b in best]))
    return out, books


def check(spark, rows, settings):
    want, books = plain(rows, settings)
    made = Compression(table(spark, rows), settings=settings)
    got = [(r._row.vec_id, r._row.label, r.codes, r.errors) for r in made.codes().collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert made.books.centres.tolist() == books
    return made


def clustered(n, seed, length=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, length))
    rows = centres[r.integers(0, 12, n)] + 0.05 * r.normal(size=(n, length))
    return [(i, row.tolist(), i % 3) for i, row in enumerate(rows)]


@pytest.mark.parametrize("entries", [1, 5, 40])
def test_against_a_full_search(spark, entries):
    check(spark, clustered(400, 1), Settings(entries=entries))


def test_ties_and_unused_entries(spark):
    r = random.Random(2)
    # Few values, so that many distances are equal and equal entries stay unused.
    rows = [(i, [r.choice([0, 1, 2]) / 4 for _ in range(8)], None) for i in range(300)]
    check(spark, rows, Settings(entries=24, scale=4))


def test_odd_rows(spark):
    rows = [
        (1, None, 1),
        (2, [], 1),
        (3, [1.0, None], 1),
        (4, [float("nan")], 1),
        (5, [float("inf")], None),
        (6, [-float("inf"), 1.0], None),
        (7, [0.5], None),
        (8, [-0.0004, 0.25, 3.0], None),
        (8, [0.1, 0.2, 0.3, 0.4, 0.5], 2),
        (8, [0.1, 0.2, 0.3, 0.4, 0.5], 2),
        (None, [0.0] * 7, 3),
    ]
    made = check(spark, rows, Settings(entries=4))
    assert made.length == 8


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 2.0**14 * (i % 17), 3.0 * i, 1e5, -1.0], i) for i in range(60)]
    check(spark, rows, Settings(entries=7))
    huge = [(i, [(-1) ** i * 10.0 ** (i % 30)] * 4, 0) for i in range(60)]
    got = Compression(table(spark, huge), settings=Settings(entries=7)).codes().collect()
    assert len(got) == 60 and all(e >= 0 for r in got for e in r.errors)


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)]):
        made = Compression(table(spark, rows))
        assert made.codes().count() == 0 and made.books.centres.shape[1] == 0


def test_balls_skip_and_prune_without_a_change():
    r = np.random.default_rng(5)
    points = r.integers(-50, 50, size=(3000, 4))
    centres = points[:64].copy()
    codes, errors = ball_kmeans.nearest(points, centres)
    moved = centres + r.integers(-3, 4, size=centres.shape)
    far = np.zeros(64, dtype=np.int64)
    apart = ((points - moved[codes]) ** 2).sum(1)
    np.maximum.at(far, codes, apart)
    balls = ball_kmeans.Balls(moved, far)
    assert (balls.neighbours < 63).any()
    got, best = balls.assign(points, codes)
    want, least = ball_kmeans.nearest(points, moved)
    assert (got == want).all() and (best == least).all()
    assert (4 * apart < balls.way[codes, 0]).any()


def test_decoded_vectors_are_the_entries(spark):
    made = Compression(table(spark, clustered(200, 4)), settings=Settings(entries=200))
    coded = {r._row.vec_id: r for r in made.codes().collect()}
    for row in made.decoded().collect():
        codes = coded[row._row.vec_id].codes
        assert row.decoded == [x for p, c in enumerate(codes) for x in made.books.centres[p][c]]


@pytest.mark.parametrize("few", [0, 100])
def test_sums_of_groups(spark, few):
    rows = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (None, 1), (2, 0)], "label int, error long")
    got = ball_kmeans.with_group_sums(rows, "label", "error", "total", broadcast_groups=few).collect()
    assert sorted((r.label or 0, r.error, r.total) for r in got) == [
        (0, 1, 8), (0, 7, 8), (1, 5, 11), (1, 6, 11), (2, 0, 0),
    ]
