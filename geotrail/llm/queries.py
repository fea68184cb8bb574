"""The registered queries of the text operators, over the whole sample tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.llm import (
    ball_kmeans,
    exact_dedup,
    fingerprints,
    mixing,
    packing,
    partenum,
    periodic_runs,
    quality,
    scoring,
    surrogates,
    toxicity,
    url_filters,
    warc,
)
from geotrail.llm.labelled import Fold
from geotrail.llm.oracle import PERIODIC_RUNS, URL_FILTERS, vector_codes
from geotrail.llm.tables import SPACES, documents


SCORING_FOLD = Fold(divisor=7, held_out=2)


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.scored(documents(spark, folder), SCORING_FOLD)


def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.edited(documents(spark, folder))
    own, changed, following = (F.col(c) for c in ("sketch", "edited_sketch", "next_sketch"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(changed).alias("edited_fingerprint"),
        fingerprints.resemblance(own, changed).alias("near_edited"),
        fingerprints.resemblance(own, following).alias("near_next"),
    )


FETCH_DATE = "2024-01-01T00:00:00Z"


def op3_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses(documents(spark, folder, "pages"), FETCH_DATE))


SURROGATE_KEY = "sample tables"


def op4_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    entities = F.col("_entities")
    return surrogates.Surrogates(docs, SURROGATE_KEY).replaced().select(
        "doc_id",
        "text",
        F.size(entities).cast("bigint").alias("n_entities"),
        F.transform(entities, lambda e: e["kind"]).alias("kinds"),
        F.transform(entities, lambda e: e["surrogate"]).alias("surrogates"),
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    docs = docs.withColumn("text_sha256", digest)
    return exact_dedup.duplicates(docs, more=("text_sha256",))


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return partenum.jaccard_components(documents(spark, folder), shingle=3, percent=90)


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixture = mixing.Mixture(documents(spark, folder).select("doc_id", "text", "source"))
    taken = mixture.taken().groupBy("number").agg(F.sum("words").alias("taken"))
    return (
        mixture.sizes("number")
        .join(taken, "number", "left")
        .drop("number")
        .withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    )


QUALITY_FOLD = Fold(divisor=3, held_out=1)


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = quality.learnt(docs, documents(spark, folder, "labels"), QUALITY_FOLD)
    return quality.scored(docs.select("doc_id", "text"), found).select(
        "_row.doc_id",
        QUALITY_FOLD.is_held_out(F.col("_row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(documents(spark, folder))
    return packing.packed(cut.withColumn("ids_crc32", packing.checksum(F.col("ids"))).drop("ids"))


TOXICITY_FOLD = Fold(divisor=5, held_out=0)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    network = toxicity.learnt(docs, documents(spark, folder, "labels"), TOXICITY_FOLD)
    return toxicity.scored(docs.select("doc_id", "text"), network).select(
        "_row.doc_id",
        TOXICITY_FOLD.is_held_out(F.col("_row.doc_id")).alias("held_out"),
        "score",
        toxicity.is_toxic(F.col("score")).cast("int").alias("predicted"),
    )


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op11_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = url_filters.judged(documents(spark, folder, "pages"), rules, ("page_id",))
    return found.select("_row.page_id", "host", "path", "rule", "verdict")


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    made = ball_kmeans.Compression(documents(spark, folder, "embeddings"))
    coded = made.codes().select(
        "_row.vec_id",
        "_row.label",
        F.lower(
            F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")), "")
        ).alias("code"),
        F.aggregate("errors", F.lit(0).cast("bigint"), lambda a, e: a + e).alias("error"),
    )
    return (
        ball_kmeans.with_group_sums(coded, "label", "error", "label_error")
        .withColumn("codebooks_sha256", F.lit(made.books.sha256()))
        .drop("label")
    )


def _with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where one text of ten, by its id, ends in words that repeat."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), "")
    cut = (
        docs.select("doc_id", "text", number.alias("h"), words.alias("words"))
        .selectExpr("*", "size(words) as n", "h div 10 as g")
        .selectExpr("*", "if(n = 0, 0, cast(g % n as int)) as a")
        .selectExpr("*", "cast(1 + (n - a) div (3 + g % 8) as int) as p")
    )
    tail = (
        "slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))),"
        " 1, n - a)"
    )
    repeated = f"array_join(concat(slice(words, 1, a), {tail}), ' ')"
    return cut.selectExpr("doc_id", f"if(h % 10 = 0 and n > 0, {repeated}, text) as text")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _with_repeats(documents(spark, folder))
    best, runs = F.col("best"), F.col("runs")
    found = periodic_runs.periodic_runs(docs, ("doc_id",)).withColumn(
        "best", periodic_runs.strongest(runs)
    )
    return found.select(
        "_row.doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.call_function("div", best["length"] * 1000, best["period"]).alias("exponent_milli"),
        F.sha2(periodic_runs.as_text(runs), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_url_filters": op11_url_filters,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}


def _sql_digest(content: str) -> str:
    """SHA-1 in base 32, ten hexadecimal digits at a time."""
    part = (
        "lpad(to_base(CAST('0x' || substr(sha1({0}), {1}, 10) AS BIGINT), 32), 8, '0')"
    )
    digits = " || ".join(part.format(content, 10 * n + 1) for n in range(4))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"'sha1:' || translate({digits}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', '{letters}')"


def _sql_identifier(source: str) -> str:
    h = f"md5({source})"
    return (
        f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' ||"
        f" substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"
    )


def _sql_unescaped(text: str) -> str:
    for name, char in warc.ENTITIES.items():
        text = f"replace({text}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


_SQL_TEXT = _sql_unescaped(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,"
    f" '(?is)(?:{warc.UNREAD})', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),"
    f" '{warc.BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
)
_SQL_TITLE = _sql_unescaped("regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1)")

ORACLE = {
    "op3_warc_derivatives": rf"""
        WITH sent AS (
          SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS body,
                 chr(13) || chr(10) AS nl,
                 {_sql_identifier("'response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')")}
                   AS refers_to
          FROM pages),
        headed AS (
          SELECT *, 'Content-Type: text/html; charset=utf-8' AS h1,
                 'Content-Length: ' || strlen(body)::VARCHAR AS h2 FROM sent),
        digested AS (
          SELECT *, {_sql_digest("('HTTP/1.1 200 OK' || nl || h1 || nl || h2 || nl || nl || body)")}
                   AS source_block_digest,
                 {_sql_digest("body")} AS source_payload_digest,
                 trim(regexp_replace({_SQL_TITLE}, '[ \t\r\n\f\x0B]+', ' ', 'g')) AS title,
                 regexp_extract(body, '(?is)<html[^>]*\blang="([^"]*)"', 1) AS lang,
                 list_transform(regexp_extract_all(body, '{warc.LINK}', 1),
                                lambda x: 'outlink: ' || x || nl) AS links,
                 trim(regexp_replace(regexp_replace({_SQL_TEXT}, '[ \t\r\f\x0B]+', ' ', 'g'),
                                     ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS txt
          FROM headed),
        made AS (
          SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
                 'http-status: 200' || nl || 'http-header: ' || h1 || nl || 'http-header: ' || h2
                 || nl || 'source-block-digest: ' || source_block_digest || nl
                 || 'source-payload-digest: ' || source_payload_digest || nl
                 || CASE WHEN title <> '' THEN 'title: ' || title || nl ELSE '' END
                 || CASE WHEN lang <> '' THEN 'language: ' || lang || nl ELSE '' END
                 || coalesce(array_to_string(links, ''), '') AS block
          FROM digested
          UNION ALL
          SELECT *, 'conversion', 'text/plain; charset=utf-8', txt FROM digested)
        SELECT page_id, warc_type, {_sql_identifier("warc_type || '|' || refers_to")} AS record_id,
               refers_to, target_uri, '{FETCH_DATE}' AS "date", content_type,
               strlen(block) AS content_length, {_sql_digest("block")} AS block_digest,
               source_block_digest, source_payload_digest, block
        FROM made
    """,
    "op5_exact_dedup": r"""
        WITH hashed AS (
          SELECT doc_id,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
          FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
        FROM hashed WINDOW g AS (PARTITION BY h)
    """,
    "op11_url_filters": URL_FILTERS,
    "op12_vector_codes": vector_codes(),
    "op13_periodic_runs": PERIODIC_RUNS,
}
