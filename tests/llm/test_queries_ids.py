"""Rows with null and repeated ids in the registered queries."""

from samples import sentence

from geotrail.llm import partenum, queries
from geotrail.llm.tables import documents

NEAR = sentence(3, 400)
ROWS = [
    (None, "a b c d", "s"),
    (None, "a  b c d", "s"),
    (1, "e f g", "s"),
    (1, "h i", "s"),
    (1, "e f g", "s"),
    (2, "one more", "t"),
]


def folder(spark, path, rows=ROWS):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_exact_dedup(spark, tmp_path):
    got = queries.op5_exact_dedup(spark, folder(spark, tmp_path)).collect()
    assert len(got) == len(ROWS) and sum(r.doc_id is None for r in got) == 2
    assert sorted(r.group_size for r in got) == [1, 1, 2, 2, 2, 2]
    assert len({r.text_sha256 for r in got}) == 4 == sum(r.kept for r in got)


def test_source_mixing(spark, tmp_path):
    got = queries.op6_source_mixing(spark, folder(spark, tmp_path)).collect()
    assert len(got) == len(ROWS)
    # A share of one and a half is wanted, each text twice at most.
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == sum(
        dict((r.source_size, round(r.target)) for r in got).values()
    )
    assert sum(r.taken for r in got if r.doc_id is None) > 0


def test_near_copies_of_a_null_id(spark, tmp_path):
    rows = [(None, NEAR, "s"), (1, NEAR + " changed", "s"), (2, sentence(9, 90), "s")]
    docs = documents(spark, folder(spark, tmp_path, rows))
    assert partenum.one_of_each(docs, shingle=3, percent=90).count() == 2
