import collections
import re

from samples import ODD, empty, odd

from geotrail.llm import exact_dedup


def test_against_plain_grouping(spark):
    got = exact_dedup.duplicates(odd(spark), prefix_chars=3).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = collections.Counter()
    for ids in groups.values():
        keep = min(ids, key=lambda i: (i is None, i))
        want.update((i, keep, len(ids)) for i in ids)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_rows_that_stay(spark):
    docs = odd(spark)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 8, 9, 11, 12]


def test_empty_table(spark):
    assert exact_dedup.duplicates(empty(spark)).count() == 0
    assert exact_dedup.deduplicated(empty(spark)).count() == 0


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "copy of this" if i % 3 == 0 else f"text {i}", "s") for i in range(300)]
    got = exact_dedup.duplicates(odd(spark, rows)).where("group_size > 1").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 100)}
    assert [r.doc_id for r in got if r.kept] == [0]
