"""SQL for queries whose statements are long: vector codes and periodic runs."""

from __future__ import annotations


def _assignment(points: str, books: str) -> str:
    """Each part's nearest entry and squared distance, ties to the lower index, as one number."""
    return f"""
        SELECT rid, p, m % 65536 AS entry, m // 65536 AS d FROM (
          SELECT a.rid, a.p, min(list_sum(list_transform(list_zip(a.x, b.x),
                   lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 65536 + b.entry) AS m
          FROM {points} a JOIN {books} b ON a.p = b.p GROUP BY a.rid, a.p)"""


def _means(assigned: str, books: str) -> str:
    """Entries at the floored mean of their parts; those without parts as they were."""
    return f"""
        SELECT b.p, b.entry, coalesce(m.x, b.x) AS x
        FROM {books} b LEFT JOIN (
          SELECT p, entry, list(mean ORDER BY pos) AS x FROM (
            SELECT a.p, a.entry, t.pos,
                   floor(sum(a2.x[t.pos])::DOUBLE / count(*))::BIGINT AS mean
            FROM {assigned} a JOIN parts a2 ON a.rid = a2.rid AND a.p = a2.p,
                 unnest(range(1, len(a2.x) + 1)) AS t(pos)
            GROUP BY a.p, a.entry, t.pos)
          GROUP BY p, entry) m ON b.p = m.p AND b.entry = m.entry"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({_assignment('parts', f'c{n}')})")
        steps.append(f"c{n + 1} AS MATERIALIZED ({_means(f'a{n}', f'c{n}')})")
    learnt = ",\n".join(steps)
    return f"""
        WITH kept AS MATERIALIZED (
          SELECT *, row_number() OVER (ORDER BY vec_id, v) AS rid FROM (
            SELECT vec_id, label,
                   list_transform(embedding, lambda e: floor(e::DOUBLE * {scale})::BIGINT) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)),
        parts AS MATERIALIZED (
          SELECT rid, t.p, v[t.p * (len(v) // {parts}) + 1 : (t.p + 1) * (len(v) // {parts})] AS x
          FROM kept, unnest(range(0, {parts})) AS t(p)),
        c0 AS MATERIALIZED (
          SELECT p, rid - 1 AS entry, x FROM parts WHERE rid <= {entries}),
        {learnt},
        final AS MATERIALIZED ({_assignment('parts', f'c{rounds}')}),
        coded AS (
          SELECT k.vec_id, k.label, string_agg(printf('%02x', entry), '' ORDER BY p) AS code,
                 sum(d)::BIGINT AS error
          FROM final f JOIN kept k ON f.rid = k.rid GROUP BY k.rid, k.vec_id, k.label),
        books AS (
          SELECT sha256(string_agg(x[t.pos]::VARCHAR, ',' ORDER BY p, entry, t.pos)) AS h
          FROM c{rounds}, unnest(range(1, len(x) + 1)) AS t(pos))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT h FROM books) AS codebooks_sha256
        FROM coded
    """


# CRC-32 of a string of ASCII characters, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
    range(1, len({0}) + 1), lambda i: [ascii(substr({0}, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))))"""

PERIODIC_RUNS = rf"""
        WITH split AS (
          SELECT row_number() OVER () AS rid, doc_id, {_CRC32.format("doc_id::VARCHAR")} AS h,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        cut AS (
          SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM split),
        made AS MATERIALIZED (
          SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n),
                   lambda i: w[1 + CASE WHEN i < a THEN i
                                        ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
                 ELSE w END AS w
          FROM cut),
        words AS MATERIALIZED (
          SELECT rid, n, t.i - 1 AS i, w[t.i] AS word FROM made, unnest(range(1, n + 1)) AS t(i)),
        pairs AS (
          SELECT x.rid, y.i - x.i AS p, x.i FROM words x JOIN words y
            ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
          WHERE x.n >= 24),
        stretches AS (
          SELECT rid, p, min(i) AS start, count(*) + p AS length FROM (
            SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS island FROM pairs)
          GROUP BY rid, p, island HAVING count(*) + p >= greatest(24, 3 * p)),
        runs AS MATERIALIZED (
          SELECT rid, start, length, min(p) AS period FROM stretches GROUP BY rid, start, length),
        best AS (
          SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid
            ORDER BY length::DOUBLE / period DESC, start, period) = 1),
        listed AS (
          SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period
                 || chr(10), '' ORDER BY start, period) AS lines
          FROM runs GROUP BY rid),
        kept AS (
          SELECT rid, string_agg(word, ' ' ORDER BY i) AS txt FROM words x
          WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.rid = x.rid
                            AND x.i >= r.start + r.period AND x.i < r.start + r.length)
          GROUP BY rid)
        SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS "start", b.length AS "length",
               b.period AS period, 1000 * b.length // b.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256,
               sha256(coalesce(txt, '')) AS collapsed_sha256
        FROM made m LEFT JOIN best b ON m.rid = b.rid LEFT JOIN listed l ON m.rid = l.rid
        LEFT JOIN kept k ON m.rid = k.rid
"""

URL_FILTERS = """
        WITH cut AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0
                   THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        seen AS (
          SELECT page_id,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        ruled AS (
          SELECT *, '.' || host AS dotted FROM seen)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM (SELECT *, CASE
                WHEN suffix(dotted, '.www.example.com') AND prefix(path, '/en/')
                  THEN 'www.example.com/en/'
                WHEN suffix(dotted, '.example.com') AND prefix(path, '/en/') THEN 'example.com/en/'
                WHEN suffix(dotted, '.net') AND prefix(path, '/es/') THEN 'net/es/'
                WHEN suffix(dotted, '.net') AND prefix(path, '/fr/') THEN 'net/fr/'
                WHEN suffix(dotted, '.com') AND prefix(path, '/') THEN 'com/' END AS rule
              FROM ruled)
"""
