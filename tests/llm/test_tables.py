import pyarrow as pa
import pytest

from geotrail.llm import tables


@pytest.mark.parametrize("before", [None, "64m", "1gb"])
def test_batches_for_workers_are_bounded_by_bytes(spark, tmp_path, before):
    spark.conf.unset(tables.BATCHES) if before is None else spark.conf.set(tables.BATCHES, before)
    try:
        rows = spark.range(0, 6000, 1, 1).selectExpr("id doc_id", "repeat(sha2(string(id), 256), 80) text")
        rows.write.parquet(f"{tmp_path}/documents.parquet")
        docs = tables.documents(spark, str(tmp_path))

        def sizes(batches):
            for batch in batches:
                yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "b"])

        found = docs.coalesce(1).mapInArrow(sizes, "n long, b long").collect()
        assert sum(r.n for r in found) == 6000
        assert len(found) > 2 and max(r.b for r in found) <= 1.1 * tables.BATCH_BYTES
    finally:
        spark.conf.unset(tables.BATCHES)


def test_a_smaller_bound_stays(spark):
    spark.conf.set(tables.BATCHES, "64k")
    try:
        tables.bound_batches(spark)
        assert spark.conf.get(tables.BATCHES) == "64k"
    finally:
        spark.conf.unset(tables.BATCHES)


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    given = []
    monkeypatch.setattr(tables, "give_back_memory", lambda: given.append(1))
    run = tables.giving_back(lambda batches: (b for b in batches))
    found = run(iter([1, 2]))
    assert next(found) == 1 and not given
    assert list(found) == [2] and given == [1]
