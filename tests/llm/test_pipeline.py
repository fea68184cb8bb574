import collections
import re
import zlib

import numpy as np
import pytest
from samples import odd
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
import public_tokenizers


def test_stages_on_the_sample(spark, folder):
    """Each stage against plain Python over its own input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        kept[name] = (docs.collect(), rows)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    labels = {
        r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()
    }
    before, after = kept["toxicity"]
    stays = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert sum(i in stays for i in clean) >= 0.95 * len(clean)
    before, after = kept["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    before, after = kept["ngram_jaccard_join"]
    assert sorted(r.doc_id for r in after) == near_representatives(before)
    before, after = kept["source_mixing"]
    words = lambda rows: collections.Counter(
        {s: sum(len((r.text or "").split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    )
    assert abs(sum(words(after).values()) - 1.5 * sum(words(before).values())) <= 20
    assert all(words(after)[s] <= 2 * n for s, n in words(before).items())
    before, after = kept["packing"]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter(
        (r.doc_id, *exact.encode(r.text or "", add_special_tokens=False).ids, 0) for r in before
    )
    copies, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in after:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.length
        copies[r.doc_id, r.copy].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, ids))
    got = collections.Counter(
        (i, *(x for _, ids in sorted(pieces) for x in ids)) for (i, _), pieces in copies.items()
    )
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, ids in sorted(pieces):
            assert offset == at
            at += len(ids)
        assert at <= 1024


def near_representatives(rows):
    sets = {}
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [i for i in ids if parent[i] == i]


def test_queries_are_registered():
    names = contract.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op3_warc_derivatives", "op5_exact_dedup"])
def test_queries_with_sql(spark, folder, name):
    from compare import compare, connect

    query, sql = contract.queries()[name], contract.oracle_sql()[name]
    _, extra, missing = compare(spark, connect(folder), query, sql, folder)
    assert (extra, missing) == (0, 0)


@pytest.mark.parametrize("name", ["op7_quality_classifier", "op10_toxicity"])
def test_classifier_queries(spark, folder, name):
    rows = contract.queries()[name](spark, folder).collect()
    divisor, out = (3, 1) if name.startswith("op7") else (5, 0)
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == out)
        assert r.predicted == int(r.score >= 0.5)


def test_a_stage_handles_odd_rows(spark, folder):
    schema = spark.read.parquet(f"{folder}/documents.parquet").columns
    docs = odd(spark).select(*schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0
