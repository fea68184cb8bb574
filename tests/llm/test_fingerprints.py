import re

import pytest
from pyspark.sql import functions as F
from samples import ODD, empty, odd, sentence

from geotrail.llm import fingerprints as fp


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sketched(spark, rows, k=fp.K):
    return fp.with_sketch(odd(spark, rows), "text", "sketch", k)


def test_sketches_of_odd_texts(spark):
    got = sketched(spark, ODD).select("doc_id", "text", "sketch").collect()
    by_text = {}
    for r in got:
        assert len(r.sketch) == min(fp.K, len(shingles(r.text)))
        assert list(r.sketch) == sorted(set(r.sketch))
        assert by_text.setdefault(r.text, r.sketch) == r.sketch


def test_estimates(spark):
    a, b = sentence(1, 900), sentence(1, 600) + " " + sentence(2, 300)
    rows = sketched(spark, [(1, a, "s"), (2, b, "s")]).select("doc_id", "sketch")
    pair = rows.where("doc_id = 1").select(F.col("sketch").alias("a")).crossJoin(
        rows.where("doc_id = 2").select(F.col("sketch").alias("b"))
    )
    a_, b_ = F.col("a"), F.col("b")
    got = pair.select(
        fp.resemblance(a_, b_).alias("j"),
        fp.distinct_shingles(a_).alias("n"),
        fp.containment(a_, b_).alias("c"),
    ).first()
    s, t = shingles(a), shingles(b)
    assert got.j == pytest.approx(jaccard(s, t), abs=0.15)
    assert got.n == pytest.approx(len(s), rel=0.3)
    assert got.c == pytest.approx(len(s & t) / len(s), abs=0.3)


def test_parts_merge_to_the_whole(spark):
    rows = [(i, sentence(i, 30), "hot" if i % 3 else "cold") for i in range(60)]
    rows.append((99, None, "none"))
    merged = {r.source: r.sketch for r in fp.merged(sketched(spark, rows), ["source"]).collect()}
    parts = sketched(spark, rows).select("source", "sketch").collect()
    for source in ("hot", "cold"):
        every = {h for r in parts if r.source == source for h in r.sketch}
        assert merged[source] == sorted(every)[: fp.K]
    assert merged["none"] == []


@pytest.mark.parametrize("section_rows", [2, 2000])
def test_the_next_document(spark, monkeypatch, section_rows):
    monkeypatch.setattr(fp, "SECTION_ROWS", section_rows)
    ids = [3, 10, 11, 12, 500, 501, 10**9, 10**9 + 1, -5]
    rows = [(i, sentence(abs(i) % 97, n + 3), "s") for n, i in enumerate(ids)]
    rows += [(77, None, "s"), (78, "", "s"), (79, "é" * 9, "s")]
    got = {r.doc_id: r for r in fp.edited(odd(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, text, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.text, r.edited_text) == (len(text), text, edited)
        assert len(r.next_sketch) == min(fp.K, len(shingles(after)))


def test_repeated_and_null_ids(spark):
    got = fp.edited(odd(spark)).collect()
    assert len(got) == len(ODD)


def test_small_tables(spark):
    assert fp.edited(empty(spark)).count() == 0
    (one,) = fp.edited(odd(spark, [(4, "abcdef", "s")])).collect()
    assert one.edited_text == "abcabc"
