import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from samples import empty, odd, sentence

from geotrail.llm import quality, toxicity
from geotrail.llm.labelled import Fold, best_cut, fit_logistic, training_texts

STEMS = ["grumbo", "vlatch", "skreet"]


def labelled(n, seed=0):
    """Texts, one in four with words of certain stems, one in four with noise."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = sentence(seed * 10_000 + i, 80).split()
        toxic, good = int(i % 4 == 0), int(i % 4 != 1)
        if toxic:
            words[r.randrange(80)] = r.choice(STEMS) + r.choice(["s", "ing", "est", "!"])
        if not good:
            words = [w.upper() + "&&&" for w in words]
        out.append((i, " ".join(words), toxic, good))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled(600)
    docs = odd(spark, [(i, t, "s") for i, t, _, _ in rows])
    labels = [(i, g, x) for i, _, x, g in rows] + [(9999, 1, 1), (None, 0, 1), (3, None, None)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def accuracy(frame, want, fold, at):
    held = {
        r["_row"].doc_id: r.score >= at
        for r in frame.collect()
        if zlib.crc32(str(r["_row"].doc_id).encode()) % fold.divisor == fold.held_out
    }
    return np.mean([held[i] == bool(want[i]) for i in held])


def test_toxicity_on_held_out_rows(tables):
    docs, labels, rows = tables
    fold = Fold(5, 0)
    net = toxicity.learnt(docs, labels, fold)
    scored = toxicity.scored(docs, net)
    assert accuracy(scored, {i: x for i, _, x, _ in rows}, fold, 0.5) > 0.95
    assert scored.first()["_row"].asDict().keys() == set(docs.columns)


def test_quality_on_held_out_rows(tables):
    docs, labels, rows = tables
    fold = Fold(3, 1)
    found = quality.learnt(docs, labels, fold)
    scored = quality.scored(docs, found)
    assert accuracy(scored, {i: g for i, _, _, g in rows}, fold, 0.5) > 0.97


def test_the_sample_is_bounded_and_held_out_rows_are_not_in_it(tables):
    docs, labels, rows = tables
    fold = Fold(5, 0)
    texts, known = training_texts(docs, labels, "toxic", fold, 20, 10_000)
    # A label whose document is not there takes a place, too.
    assert 19 <= (known == 1).sum() <= 20 == (known == 0).sum()
    held = {t for i, t, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not held & set(texts)
    again, _ = training_texts(docs.repartition(7), labels, "toxic", fold, 20, 10_000)
    assert again == texts


def test_scores_of_odd_rows(spark, tables):
    docs, labels, _ = tables
    net = toxicity.learnt(docs, labels, Fold(5, 0))
    found = quality.learnt(docs, labels, Fold(3, 1))
    for frame in (toxicity.scored(odd(spark), net), quality.scored(odd(spark), found)):
        scores = [r.score for r in frame.collect()]
        assert len(scores) == 13 and all(0 <= s <= 1 for s in scores)
    assert toxicity.scored(empty(spark), net).count() == 0
    assert quality.scored(empty(spark), found).count() == 0


def test_whole_texts_are_read(tables):
    docs, labels, _ = tables
    net = toxicity.learnt(docs, labels, Fold(5, 0))
    clean = sentence(77, 40_000)
    scores = toxicity.score_texts(net, pa.array([clean, clean + " vlatching"]), toxicity.Settings())
    assert scores[0] < 0.5 <= scores[1]


def test_without_labels(spark, tables):
    docs, labels, _ = tables
    none = labels.where("doc_id < 0")
    assert toxicity.learnt(docs, none, Fold(5, 0)) is None
    assert {r.score for r in toxicity.scored(docs, None).collect()} == {0.0}
    assert quality.learnt(docs, none, Fold(3, 1)) is None
    assert {r.score for r in quality.scored(docs, None).collect()} == {0.5}
    assert quality.fit(["a"], np.array([1])) is None


def test_few_labels_still_fit():
    texts = [t for _, t, _, _ in labelled(12)]
    y = np.array([g for *_, g in labelled(12)])
    assert quality.fit(texts, y) is not None
    assert toxicity.fit(texts, np.array([x for _, _, x, _ in labelled(12)])) is not None


def test_gradients_of_the_network_are_those_of_its_loss():
    """One step of training lowers the loss of its own batch."""
    settings = toxicity.Settings(epochs=1)
    rows = labelled(40)
    data = toxicity.encoded(pa.array([t for _, t, _, _ in rows]), settings.bits)
    y = np.array([x for _, _, x, _ in rows])
    net = toxicity._initial(data, y, settings)
    loss = lambda: -np.mean(
        np.log(np.where(y == 1, p := toxicity.logistic(net.logits(data)), 1 - p) + 1e-9)
    )
    before, ada = loss(), toxicity._Adagrad(0.02)
    for _ in range(5):
        toxicity._train_step(net, data, y, np.ones(len(y)), ada)
    assert loss() < before


def test_calibration_helpers():
    x = np.array([0.0, 1.0, 2.0, 3.0])
    assert best_cut(x, np.array([0, 0, 1, 1])) == 1.5
    slope, intercept = fit_logistic(x, np.array([0, 0, 1, 1]))
    assert slope > 0 and -intercept / slope == pytest.approx(1.5, abs=0.1)


def test_a_text_travels_once_to_the_network(spark, tables):
    docs, labels, _ = tables
    net = toxicity.learnt(docs, labels, Fold(5, 0))
    frame = toxicity.scored(docs, net)
    sent = frame._jdf.queryExecution().analyzed().children().head()
    assert list(sent.schema().fieldNames()) == ["_row"]
    # A column that is no string goes beside its row, and scores as before.
    other = docs.withColumn("text", docs.text.cast("binary"))
    plain = {r["_row"].doc_id: r.score for r in frame.collect()}
    assert {r["_row"].doc_id: r.score for r in toxicity.scored(other, net).collect()} == plain
