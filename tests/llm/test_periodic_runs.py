import random
import re

import numpy as np
import pytest
from samples import LONG, empty, odd

from geotrail.llm import periodic_runs
from geotrail.llm.periodic_runs import Rule
from geotrail.llm.recompression import Grammar


def plain(words, rule):
    """For each period the stretches whose words that far apart are the same, one after another."""
    found = {}
    for p in range(1, len(words) // rule.repeats + 1):
        same = [words[i] == words[i + p] for i in range(len(words) - p)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            if not s and start is not None:
                length = i - start + p
                if length >= max(rule.least_words, rule.repeats * p):
                    found.setdefault((start, length), p)
                start = None
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequences():
    r = random.Random(11)
    for n in range(120):
        kind = n % 6
        if kind == 0:
            yield [r.choice("ab") for _ in range(r.randint(0, 120))]
        elif kind == 1:
            yield [r.choice("abcdefgh") for _ in range(r.randint(1, 9))] * r.randint(1, 40)
        elif kind == 2:
            yield ["a"] * r.randint(0, 90)
        elif kind == 3:
            unit = ["x", "y"] * r.randint(1, 6) + ["z"]
            yield [str(i) for i in range(r.randint(0, 9))] + unit * r.randint(2, 9) + unit[:3]
        elif kind == 4:
            a, b = ["a"], ["a", "b"]
            for _ in range(r.randint(1, 8)):
                a, b = b, b + a
            yield b * r.randint(1, 4)
        else:
            yield [str(i * r.randint(0, 1)) for i in range(r.randint(0, 100))]


@pytest.mark.parametrize("rule", [Rule(), Rule(least_words=2, repeats=2), Rule(least_words=7, repeats=3)])
def test_all_runs_against_every_period(rule):
    texts = list(sequences())
    found = periodic_runs.find_runs([[w.encode() for w in t] for t in texts], rule)
    got = {}
    for t, *run in zip(*(x.tolist() for x in (found.text, found.start, found.length, found.period))):
        got.setdefault(t, []).append(tuple(run))
    assert sum(map(len, got.values())) > 50
    for n, words in enumerate(texts):
        own = sorted(got.get(n, []))
        assert own == plain(words, rule), (n, words)


def test_pairs_are_taken_in_bounded_numbers(monkeypatch):
    texts = [[w.encode() for w in t] for t in sequences()]
    want = periodic_runs.find_runs(texts)
    monkeypatch.setattr(periodic_runs, "PAIRS_AT_ONCE", 50)
    got = periodic_runs.find_runs(texts)
    assert all((a == b).all() for a, b in zip(vars(want).values(), vars(got).values()))


@pytest.mark.parametrize("letters,n", [(2, 400), (50, 400), (1, 400)])
def test_extensions_against_comparing_one_by_one(letters, n):
    r = np.random.default_rng(letters)
    inner = r.integers(0, letters, n)
    inner[100:250] = inner[40]
    inner[260:380] = np.tile(inner[260:266], 20)
    s = np.concatenate([[letters], inner, [letters + 1]])
    grammar = Grammar(s)
    i, j = (x.ravel() for x in np.triu_indices(len(s), k=1))
    pick = r.permutation(len(i))[:20_000]
    i, j = i[pick], j[pick]
    for step in (1, -1):
        got = grammar.extend(i, j, step)
        for a, b, n_same in zip(i.tolist(), j.tolist(), got.tolist()):
            k = 0
            while 0 <= a + step * k and b + step * k < len(s) and 0 <= b + step * k and s[a + step * k] == s[b + step * k]:
                k += 1
            assert k == n_same, (a, b, step)


def test_the_grammar_gives_the_sequence_back():
    s = np.concatenate([[99], np.tile([1, 2, 3, 1, 1, 1], 30), [98]])
    grammar = Grammar(s)
    sizes = np.ones(len(s), dtype=int)
    for level in grammar.levels:
        assert len(sizes) == len(level.symbols)
        sizes = np.add.reduceat(sizes, level.first[:-1])
    assert sizes.tolist() == [len(s)] and len(grammar.levels) < 40


def test_odd_texts(spark):
    lines = "the same line again and again\n" * 50
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "a\x0bb  c d e", "a"),
        (5, lines, "a"), (5, lines, "a"), (None, lines, "a"), (6, LONG, "a"),
        (7, "x " * 200_000, "a"), (8, "x" * 1_000_000, "a"), (9, "\n" * 1_000_000, "a"),
        (10, "é 漢字 🙂 " * 20 + "<|endoftext|>", None),
    ]
    got = periodic_runs.periodic_runs(odd(spark, rows), ("doc_id", "score")).collect()
    want = []
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [(0, 200_000, 1)] if i == 7 else [] if i == 6 else plain(words, Rule())
        want.append((i, "x", runs, plain_collapsed(words, runs)))
    got = [(r._row.doc_id, r._row.score, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_the_strongest_run_and_the_lines(spark):
    run = "array<struct<start:bigint,length:bigint,period:bigint>>"
    rows = [(1, [(0, 30, 10), (40, 60, 20), (50, 31, 10)]), (2, []), (3, [(5, 24, 2), (9, 36, 3)])]
    df = spark.createDataFrame(rows, f"id int, runs {run}")
    got = df.select("id", periodic_runs.strongest(df.runs).alias("b"), periodic_runs.as_text(df.runs).alias("t"))
    assert sorted((r.id, tuple(r.b or ()), r.t) for r in got.collect()) == [
        (1, (50, 31, 10), "0,30,10\n40,60,20\n50,31,10\n"), (2, (), ""), (3, (5, 24, 2), "5,24,2\n9,36,3\n"),
    ]


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(empty(spark), ("doc_id",)).count() == 0
