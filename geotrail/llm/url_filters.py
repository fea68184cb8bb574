"""URL filters: a blocked Bloom filter before an exact hash join, in built-in functions only.

A rule is a host, a path prefix and a verdict. Its canonical URL is the host in lower case (A-Z)
and the path as it is. It fits the URLs of that host and of all its subdomains whose path starts
with the rule's. A URL can only be hit by few strings: the last labels of its host, as many as
some rule has, with the first characters of its path, as many as some rule has. Each of them is
looked up in a Bloom filter of the listed URLs, whose bits for one key lie in one block of 256,
and only possible hits go on to the exact join. The longest rule that fits decides; of two as
long the one with the longer host, of the same URL listed twice the larger verdict. A URL that no
rule fits gets the default.

The filter has at most ``most_blocks`` blocks, whatever the length of the list: beyond, more false
positives reach the exact join, which drops them. A list up to ``broadcast_rules`` rows, which is
counted, is sent to every task; a longer one is joined by an exchange of the possible hits, with
strings that very many URLs share joined apart.

Null URLs and those without ``://`` have an empty host and an empty path. Empty tables of pages or
rules, repeated rows and null or repeated ids are as any others: one row comes out for each row.
Rules without host or path (null) fit nothing. Columns of the pages are kept apart from the
operator's own, so names cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.tables import saved

BLOCK_WORDS = 4
KEY_BITS = 6
LIST_BITS = 12  # of the filter, for each listed URL
MOST_BLOCKS = 1 << 16
BROADCAST_RULES = 1 << 16
HOT_PARTS = 1024

_AUTHORITY = "^[^/?#]*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://``: the host up to ``/``, ``?`` or ``#`` with A-Z in lower
    case, and the path up to ``?`` or ``#``. Both are empty for a null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, _AUTHORITY, 0)
    path = F.regexp_extract(rest, f"{_AUTHORITY}([^?#]*)", 1)
    return lowered(host), path


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def canonical(rules: DataFrame) -> DataFrame:
    """``key, host_length, labels, path_length, verdict``: one row for each listed URL."""
    host = lowered(F.col("host"))
    return (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(
            F.concat(host, "path").alias("key"),
            F.length(host).alias("host_length"),
            (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1).alias("labels"),
            F.length("path").alias("path_length"),
            "verdict",
        )
        # A path that does not start with a slash is no URL's, but could look like a host's end.
        .where("path_length = 0 or substring(key, host_length + 1, 1) = '/'")
        .groupBy("key", "host_length", "labels", "path_length")
        .agg(F.max("verdict").alias("verdict"))
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The positions of a key's bits within its block, from a second hash."""
    own = F.xxhash64(key, F.lit(1))
    width = BLOCK_WORDS * 64
    return [F.shiftright(own, 8 * n).bitwiseAND(F.lit(width - 1)) for n in range(KEY_BITS)]


def _mask(bits: list[Column], word: int) -> Column:
    """The bits that fall into one word of the block."""
    one, mask = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    for bit in bits:
        own = F.call_function("shiftleft", one, F.pmod(bit, F.lit(64)).cast("int"))
        here = F.floor(bit / 64) == word
        mask = mask.bitwiseOR(F.when(here, own).otherwise(F.lit(0).cast("bigint")))
    return mask


def block_count(keys: int, most: int = MOST_BLOCKS) -> int:
    """Blocks for so many listed URLs: a power of two, at most ``most``."""
    wanted = max(1, keys * LIST_BITS // (BLOCK_WORDS * 64))
    return min(1 << (wanted - 1).bit_length(), most)


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 ... w3`` of the blocks that hold a key of ``listed``."""
    bits = _bits(F.col("key"))
    words = [_mask(bits, n).alias(f"w{n}") for n in range(BLOCK_WORDS)]
    return (
        listed.select(_block(F.col("key"), blocks).alias("block"), *words)
        .groupBy("block")
        .agg(*(F.bit_or(f"w{n}").alias(f"w{n}") for n in range(BLOCK_WORDS)))
    )


def possible(keyed: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``keyed`` whose ``key`` may be listed: all that are, few others."""
    bits = _bits(F.col("key"))
    hit = F.lit(True)
    for n in range(BLOCK_WORDS):
        mask = _mask(bits, n)
        hit = hit & (F.col(f"w{n}").bitwiseAND(mask) == mask)
    probed = keyed.withColumn("block", _block(F.col("key"), blocks))
    # At most ``blocks`` rows of five numbers.
    found = probed.join(F.broadcast(bloom_filter(listed, blocks)), "block").where(hit)
    return found.select(*keyed.columns)


def _looked_up(seen: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``number, key`` of all strings that could be listed, for the (labels, characters of the
    path) that some listed URL has."""
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in shapes))
    key = F.transform(
        F.filter(each, lambda s: s["c"] <= F.length("path")),
        lambda s: F.concat(
            F.call_function("substring_index", F.col("host"), F.lit("."), -s["n"]),
            F.substring(F.col("path"), F.lit(1), s["c"]),
        ),
    )
    # A host with fewer labels than a shape stands for itself again.
    return seen.select("number", F.explode(F.array_distinct(key)).alias("key"))


def _exact(hits: DataFrame, listed: DataFrame, rules: int, broadcast_rules: int) -> DataFrame:
    """Hits with the rule of their key; those without one are gone."""
    if rules <= broadcast_rules:
        return hits.join(F.broadcast(listed), "key")
    hits = saved(hits)
    counts = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = hits.agg(F.count(F.lit(1))).scalar()
    # Fewer keys than HOT_PARTS can be this frequent, so what is sent to all tasks is bounded.
    hot = saved(counts.where(F.col("n") > F.ceil(total / HOT_PARTS)).select("key"))
    frequent = F.broadcast(listed.join(F.broadcast(hot), "key", "left_semi"))
    rest = hits.join(F.broadcast(hot), "key", "left_anti")
    return hits.join(frequent, "key").unionByName(rest.join(listed, "key"))


def judged(
    pages: DataFrame,
    rules: DataFrame,
    keep: tuple[str, ...],
    url: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
    most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """``_row`` with the columns ``keep`` of each page, ``host, path``, the ``rule`` that decides
    (null where none fits) and its ``verdict``. ``rules`` has ``host, path, verdict``."""
    listed = saved(canonical(rules))
    host, path = host_and_path(F.col(url))
    # Written once: the numbers tie the parts of a row together.
    seen = saved(
        pages.select(
            F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"),
            host.alias("host"),
            path.alias("path"),
            F.monotonically_increasing_id().alias("number"),
        )
    )
    count = listed.count()
    # At most as many pairs as hosts have labels times paths have characters.
    shapes = sorted(tuple(r) for r in listed.select("labels", "path_length").distinct().collect())
    if not shapes:
        none = F.lit(None).cast("string")
        return seen.drop("number").withColumns({"rule": none, "verdict": F.lit(default)})
    maybe = possible(_looked_up(seen, shapes), listed, block_count(count, most_blocks))
    length = F.struct((F.col("host_length") + F.col("path_length")).alias("all"), "host_length")
    deciding = (
        _exact(maybe, listed, count, broadcast_rules)
        .groupBy("number")
        .agg(F.max_by(F.struct("key", "verdict"), length).alias("_rule"))
    )
    return seen.join(deciding, "number", "left").select(
        "_row",
        "host",
        "path",
        F.col("_rule.key").alias("rule"),
        F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"),
    )
