import random

import pytest
from pyspark.sql import functions as F

from geotrail.llm import url_filters
from geotrail.llm.queries import URL_RULES

ODD = [
    (1, None),
    (2, ""),
    (3, "no scheme/en/"),
    (4, "http://"),
    (5, "HTTP://WWW.Example.COM/en/x?y#z"),
    (6, "https://example.com"),
    (7, "https://example.com/EN/"),
    (8, "https://a.b.example.com/en/"),
    (9, "https://notexample.com/en/"),
    (10, "x://y.net/es/?a://b"),
    (11, "x://y.net?/es/"),
    (12, "x://.com/"),
    (13, "x://com/#"),
    (14, "x://com"),
    (15, "http://user@www.example.com:80/en/"),
    (15, "http://user@www.example.com:80/en/"),
    (None, "http://é.NET/fr/漢"),
    (17, "http://" + "a." * 20_000 + "com/en/"),
    (18, "http://example.com/en/" + "/" * 1_000_000),
    (19, "http://" + "." * 100_000 + "net/es/"),
]


def plain(url, rules, default="allow"):
    """Every rule tried on the URL."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    rule, verdict = max(fits)[2:] if fits else (None, default)
    return host, path, rule, verdict


def pages(spark, rows):
    # Columns named as the operator's own.
    return spark.createDataFrame(
        [(*r, 0, 1, "k") for r in rows], "page_id long, url string, number int, block int, key string"
    )


def listed(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def check(spark, rows, rules, **settings):
    got = url_filters.judged(pages(spark, rows), listed(spark, rules), ("page_id",), **settings)
    got = got.select("_row.page_id", "host", "path", "rule", "verdict").collect()
    want = [(i, *plain(u, rules)) for i, u in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("broadcast", [0, 1 << 16])
def test_odd_urls(spark, broadcast):
    check(spark, ODD, URL_RULES, broadcast_rules=broadcast)


@pytest.mark.parametrize("broadcast", [0, 1 << 16])
def test_many_rules_against_all_tried(spark, broadcast):
    r = random.Random(3)
    hosts = [".".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 3))) for _ in range(20)]
    rules = {(r.choice(hosts), r.choice(["", *paths])): r.choice(["allow", "block"]) for _ in range(120)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    rows = [(i, f"x://{r.choice('abc')}.{r.choice(hosts)}{r.choice(paths)}z") for i in range(500)]
    # A third of all rows on one host.
    rows += [(1000 + i, f"x://{rules[0][0]}{rules[0][1] or '/'}") for i in range(250)]
    check(spark, rows, rules, broadcast_rules=broadcast)


def test_false_positives_of_a_full_filter_are_dropped(spark):
    rules = [(f"h{i}.com", "/", "block") for i in range(2000)]
    rows = [(i, f"x://h{i}.com/") for i in range(0, 4000, 7)]
    check(spark, rows, rules, most_blocks=1)


def test_the_filter_holds_back_most_keys(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    inside, blocks = keys.limit(1000), url_filters.block_count(1000)
    passed = url_filters.possible(keys, inside, blocks)
    assert passed.join(inside, "key").count() == 1000
    assert passed.count() < 1000 + 0.03 * 3000


def test_rules_that_are_no_urls(spark):
    rules = [(None, "/", "block"), ("com", None, "block"), ("co", "m/", "block")]
    rules += [("com", "/", "block"), ("com", "/", "allow")]
    got = url_filters.judged(pages(spark, [(1, "x://a.com/"), (2, "x://b.net/")]), listed(spark, rules), ("page_id",))
    assert sorted((r._row.page_id, r.rule, r.verdict) for r in got.collect()) == [
        (1, "com/", "block"),
        (2, None, "allow"),
    ]


def test_empty_tables(spark):
    assert url_filters.judged(pages(spark, []), listed(spark, URL_RULES), ("page_id",)).count() == 0
    check(spark, ODD, [])


def test_no_python_in_the_plan(spark):
    found = url_filters.judged(pages(spark, ODD), listed(spark, URL_RULES), ("page_id",))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
