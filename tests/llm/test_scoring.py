import collections
import math
import re
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from samples import ODD, empty, odd, sentence

from geotrail.llm import attention, scoring
from geotrail.llm.labelled import Fold

FOLD = Fold(7, 2)
SMALL = attention.Shape(steps=20, windows=16)


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["<end> of text"]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("frequent", [0, 5, 1 << 19])
def test_word_frequencies(spark, frequent):
    rows = ODD + [(i, sentence(i, 30), "s") for i in range(20, 60)]
    settings = scoring.Settings(frequent=frequent, shape=SMALL)
    got = scoring.scored(odd(spark, rows), FOLD, settings).collect()
    count = collections.Counter()
    for i, t, _ in rows:
        if not held_out(i):
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t, _ in rows:
        words = tokens(t)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        known = sum(count[w] > 0 for w in words)
        want[i, held_out(i), len(words), known, n, round(base, 4)] += 1
    found = collections.Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
        for r in got
    )
    assert found == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_table(spark):
    got = scoring.scored(empty(spark), FOLD, scoring.Settings(shape=SMALL))
    assert got.count() == 0


def _model(steps=60):
    random = np.random.default_rng(0)
    # Every second id says what comes next.
    pairs = random.integers(100, 140, (300, 20))
    ids = np.stack([pairs, pairs + 1000], axis=2).reshape(300, 40).astype(np.uint16)
    counts = np.full(300, 40)
    shape = attention.Shape(steps=steps, windows=64)
    return attention.fit(ids.reshape(-1), counts, shape), ids, counts


def test_the_model_learns_what_follows():
    model, ids, counts = _model()
    seen = attention.log_probabilities(model, ids.reshape(-1), counts).sum()
    shuffled = np.random.default_rng(1).permuted(ids, axis=1).reshape(-1)
    assert seen > attention.log_probabilities(model, shuffled, counts).sum() + 1000
    # Better than knowing the frequencies of the 80 ids alone.
    assert seen / ids.size > -math.log(80)


def test_probabilities_add_up_to_one():
    """Over all ids that may come first, and the end."""
    model, *_ = _model(5)
    p = np.exp(attention.log_probabilities(model, np.zeros(0, np.uint16), np.zeros(1, np.int64)))
    every = np.arange(attention.IDS).astype(np.uint16)
    first = attention.log_probabilities(model, every, np.ones(attention.IDS, np.int64))
    # What an id leaves for the end after it is taken off again.
    slots = model.slot_of[every]
    pairs = {}
    for slot in np.unique(slots):
        probe = np.flatnonzero(slots == slot)
        pairs[slot] = probe
    total = 0.0
    shape, q = model.shape, model.p
    end, block = model.end, shape.block
    both = np.full((1, 2 * block), end, dtype=np.intp)
    h = attention._attend(
        q, shape, both, np.array([True]), attention._reach(q, block).astype(np.float32)
    )[-1][:1]
    high = attention._softmax(h @ q["cluster"] + q["direct_cluster"][[end]])[0]
    for c in range(attention.CLUSTERS):
        low = attention._softmax(h @ q["member"][c] + q["direct_member"][c][[end]])[0]
        for m in range(attention.CLUSTERS):
            slot = c * attention.CLUSTERS + m
            inside = 1.0
            if slot == model.other:
                inside = np.exp(model.within[pairs[slot]]).sum()
            elif slot != end and slot not in pairs:
                inside = 0.0
            total += high[c] * low[m] * inside
    assert total == pytest.approx(1.0, abs=1e-3)
    assert 0 < p[0] < 1 and (first < 0).all()


def test_each_text_is_scored_alone():
    model, ids, counts = _model(5)
    together = attention.log_probabilities(model, ids.reshape(-1), counts, chunk=3)
    for k in (0, 7, 299):
        alone = attention.log_probabilities(model, ids[k], counts[:1])
        assert alone[0] == pytest.approx(together[k], abs=1e-3)


def test_a_later_id_does_not_change_an_earlier_probability():
    model, ids, _ = _model(5)
    text = ids[0]
    a = attention.log_probabilities(model, np.append(text, [105]), np.array([41]))
    b = attention.log_probabilities(model, np.append(text, [105, 1105]), np.array([42]))
    c = attention.log_probabilities(model, np.append(text, [105, 1106]), np.array([42]))
    # The two texts share all but their last id and the end after it.
    assert b[0] != c[0] and abs(b[0] - c[0]) < 50 and a[0] > b[0] - 50


def test_gradients():
    random = np.random.default_rng(0)
    shape = attention.Shape(block=4, dim=4, seed=1)
    p = attention._initial(shape, random.integers(0, 9, (attention.SLOTS, attention.SLOTS)))
    p = {name: v.astype(np.float64) for name, v in p.items()}
    both = random.integers(0, attention.SLOTS, (6, 8))
    targets = random.integers(0, attention.SLOTS, (6, 4))
    there, first = random.random((6, 4)) > 0.2, np.array([1, 0, 0, 1, 0, 0], bool)
    _, g = attention.gradients(p, shape, both, targets, there, first)

    def loss():
        return attention.gradients(p, shape, both, targets, there, first)[0]

    for name, gradient in g.items():
        where = np.argwhere(np.abs(gradient) > 1e-6)
        for at in map(tuple, where[random.integers(0, len(where), 4)]):
            held = p[name][at]
            p[name][at] = held + 1e-4
            up = loss()
            p[name][at] = held - 1e-4
            slope = (up - loss()) / 2e-4
            p[name][at] = held
            assert slope == pytest.approx(gradient[at], rel=1e-2, abs=1e-5)


def test_all_training_rows_count(spark):
    """A model that starts on one short text knows what all the others hold."""
    rows = [(i, sentence(i, 40 + 400 * (i % 50 == 0)), "s") for i in range(200)]
    docs = odd(spark, rows)
    settings = scoring.Settings(sample=1, sample_chars=300, shape=SMALL)
    model = scoring.trained_model(scoring.encoded(docs, FOLD), settings)
    learnt = [t for i, t, _ in rows if not held_out(i)]
    ids, counts = scoring.encoder().encode_all(learnt)
    often = np.bincount(ids, minlength=attention.IDS)
    pairs = attention.counted_pairs(attention.slots_of(often), ids, counts)
    want = attention.counted(often, pairs, SMALL)
    assert np.array_equal(model.slot_of, want.slot_of)
    assert np.array_equal(model.p["direct_member"], want.p["direct_member"])
    # Rounds over all rows make it better than the one text alone does.
    alone = scoring.Settings(sample=1, sample_chars=300, shape=replace(SMALL, rounds=0))
    start = scoring.trained_model(scoring.encoded(docs, FOLD), alone)
    seen = attention.log_probabilities(model, ids, counts).sum()
    assert seen > attention.log_probabilities(start, ids, counts).sum()
    got = scoring.scored(docs, FOLD, settings).agg({"score": "sum"}).first()[0]
    most = scoring.scored(docs, FOLD, scoring.Settings(shape=SMALL)).agg({"score": "sum"}).first()[0]
    assert got == pytest.approx(most, rel=0.05)


def test_scoring_holds_a_bounded_number_of_ids(monkeypatch):
    """A block of long texts goes through the model a few texts at a time; scores stay."""
    texts = pa.array([sentence(n, 3000) for n in range(60)])
    rows = pa.record_batch([pa.array(range(60)), texts], names=["doc_id", "text"])
    batch = next(scoring._encode(scoring.VOCABULARY)(iter([rows])))
    ids, counts = scoring._ids(batch.column("ids"))
    often = np.bincount(ids, minlength=attention.IDS)
    pairs = attention.counted_pairs(attention.slots_of(often), ids, counts)
    model, seen = attention.counted(often, pairs), []
    score = attention.log_probabilities
    whole = score(model, ids, counts)

    def noted(model, ids, counts):
        seen.append(len(ids))
        return score(model, ids, counts)

    monkeypatch.setattr(attention, "log_probabilities", noted)
    none = scoring.Frequent(np.zeros(0, np.int64), np.zeros(0, np.int64))
    (found,) = scoring._score(none, model)(iter([batch]))
    assert sum(seen) == len(ids) > scoring.IDS_AT_ONCE >= max(seen)
    assert found.column("ids").to_numpy().tolist() == (counts + 1).tolist()
    np.testing.assert_allclose(found.column("score").to_numpy(), whole / np.log(10), rtol=1e-5)


def test_softmax_of_any_size():
    """The quick way and the one for values that have no exponent give the same shares."""
    x = np.random.default_rng(0).normal(size=(50, 32)).astype(np.float32)
    for shift in (0, 300, -300):
        found = attention._softmax(x + np.float32(shift))
        want = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
        np.testing.assert_allclose(found, want, rtol=1e-3)
    assert attention._softmax(x[:0]).shape == (0, 32)


def test_gradients_are_those_of_one_window_after_the_other():
    """Places are taken in order of their targets' clusters; their sums are the same."""
    random = np.random.default_rng(1)
    shape = attention.Shape(block=4, dim=4, seed=1)
    p = attention._initial(shape, random.integers(0, 9, (attention.SLOTS, attention.SLOTS)))
    p = {name: v.astype(np.float64) for name, v in p.items()}
    both = random.integers(0, attention.SLOTS, (5, 8))
    targets = random.integers(0, attention.SLOTS, (5, 4))
    there, first = random.random((5, 4)) > 0.3, np.array([1, 0, 0, 1, 0], bool)
    loss, g = attention.gradients(p, shape, both, targets, there, first)
    total, sums = 0.0, {name: 0.0 for name in g}
    for i in range(5):
        one = slice(i, i + 1)
        some, part = attention.gradients(p, shape, *(x[one] for x in (both, targets, there, first)))
        share = there[i].sum() / there.sum()
        total += share * some
        sums = {name: sums[name] + share * part[name] for name in g}
    assert loss == pytest.approx(total)
    for name in g:
        np.testing.assert_allclose(g[name], sums[name], atol=1e-12)


@pytest.mark.parametrize("sizes", [[1], [3000], [1] * 50, range(1, 60), [700, 1, 9, 8, 600, 2, 40]])
def test_rows_of_a_slot_are_added_up_as_numpy_does(sizes):
    """Short ranges side by side, long ones a few at a time: the same sums to the last bit."""
    random = np.random.default_rng(2)
    ordered = np.repeat(np.arange(len(sizes)), sizes)
    rows = random.normal(size=(len(ordered), 6)).astype(np.float32)
    order, begin = random.permutation(len(ordered)), np.flatnonzero(np.diff(ordered, prepend=-1))
    want = np.add.reduceat(rows[order], begin, axis=0)
    assert np.array_equal(attention._totals(rows, order, begin), want)


def test_steps_of_training():
    """A step is Adam's, written out; it leaves what is counted and the gradients as they are."""
    random = np.random.default_rng(3)
    names = {"query": (5, 4), "near": (2, 3), "direct_cluster": (5, 2)}
    p = {name: random.normal(size=size).astype(np.float32) for name, size in names.items()}
    want, adam = {name: v.copy() for name, v in p.items()}, attention._Adam(p)
    m, s = ({name: np.float32(0) for name in names} for _ in range(2))
    for step in range(1, 6):
        g = {n: random.normal(size=names[n]).astype(np.float32) for n in ("query", "near")}
        held = {name: v.copy() for name, v in g.items()}
        adam.step(g, 0.01)
        for name in g:
            assert np.array_equal(g[name], held[name])
            m[name] = 0.9 * m[name] + 0.1 * g[name]
            s[name] = 0.99 * s[name] + 0.01 * g[name] ** 2
            mean, square = m[name] / (1 - 0.9**step), s[name] / (1 - 0.99**step)
            want[name] = want[name] - 0.01 * mean / (np.sqrt(square) + 1e-6)
    for name in names:
        np.testing.assert_allclose(p[name], want[name], rtol=1e-4, atol=1e-6)
