"""WARC derivatives: linked metadata and plain-text conversion records for responses.

Every response gives one ``metadata`` record (application/warc-fields: what the server said, the
source's headers and digests, title, language, links) and one ``conversion`` record (text/plain:
its readable text). Both refer to the response by its identifier and carry its target URI and
date; identifiers are derived from the response's own, so a second run makes the same records.
All of it is row by row in built-in functions; nothing is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: Names of character entities that occur in plain pages. The ampersand is last.
ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "copy": "©",
    "reg": "®",
    "trade": "™",
    "middot": "·",
    "bull": "•",
    "hellip": "…",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "euro": "€",
    "amp": "&",
}
UNREAD = "|".join(rf"<{t}\b.*?</{t}[^>]*>" for t in ("script", "style", "noscript", "head"))
BREAKS = r"(?i)<(?:br|hr|/p|/div|/li|/h[1-6]|/tr|/article|/section|/ul|/ol|/table|/nav|/footer)\b[^>]*>"
# The same two, with what alternatives begin with taken out, so that most places fail on one character.
UNREAD_AT_ONCE = r"(?is)<(script|style|noscript|head)\b.*?</\1[^>]*>"
BREAKS_AT_ONCE = (
    r"(?i)<(?:br|hr|/(?:p|div|li|h[1-6]|tr|article|section|ul|ol|table|nav|footer))\b[^>]*>"
)
LINK = r'(?is)<a\s[^>]*href="([^"]*)"'


def digest(content: Column) -> Column:
    """SHA-1 in base 32, as records carry it."""
    hexadecimal = F.sha1(content.cast("binary"))
    parts = [
        F.lpad(F.conv(F.substring(hexadecimal, 10 * n + 1, 10), 16, 32), 8, "0") for n in range(4)
    ]
    digits = F.upper(F.concat(*parts))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.concat(
        F.lit("sha1:"), F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", letters)
    )


def identifier(*source: Column) -> Column:
    """A record identifier that follows from its source."""
    h = F.md5(F.concat_ws("|", *source).cast("binary"))
    pieces = [F.substring(h, 1, 8), F.substring(h, 9, 4)]
    pieces += [F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3))]
    pieces.append(F.substring(h, 21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def _from_byte(text: Column, start: Column) -> Column:
    """What begins at a byte, counted from 1: found without counting characters."""
    content = text.cast("binary")
    return F.substr(content, start, F.octet_length(text)).cast("string")


def responses(
    pages: DataFrame, date: str, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """A response record for each fetched page: ``page_id, record_id, target_uri, date, block``.
    A null page is an empty body and a null address an empty one; other columns are left out."""
    body = F.coalesce(F.col(html), F.lit(""))
    uri = F.coalesce(F.col(url), F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        _bytes(body).cast("string"),
        F.lit(CRLF * 2),
    )
    return pages.select(
        F.col(page_id).alias("page_id"),
        identifier(F.lit("response"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), uri).alias(
            "record_id"
        ),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(head, body).alias("block"),
    )


def unescaped(text: Column) -> Column:
    """Character entities as characters: numbers, and the names of ``ENTITIES``. ``text`` should
    be a column of its own, so that it is computed once."""
    pattern = r"&#(?:[0-9]{1,6}|[xX][0-9a-fA-F]{1,5});"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def character(entity: Column) -> Column:
        number = F.regexp_replace(entity, "[&#;]", "")
        code = F.when(
            F.lower(F.substring(number, 1, 1)) == "x",
            F.conv(F.substring(number, 2, 6), 16, 10).cast("int"),
        ).otherwise(number.cast("int"))
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        point = F.unhex(F.lpad(F.hex(code), 8, "0"))
        return F.when(bad, F.lit("�")).otherwise(F.decode(point, "UTF-32"))

    made = F.concat(F.transform(found, character), F.array(F.lit("")))
    gaps = F.split(text, pattern, -1)
    numbers = F.array_join(F.flatten(F.zip_with(gaps, made, lambda g, c: F.array(g, c))), "")
    out = F.when(F.contains(text, F.lit("&#")), numbers).otherwise(text)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def with_unescaped(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the character entities of its column ``name`` as characters. Each begins with an
    ampersand, so only what follows the first one is looked through for them."""
    text = F.col(name)
    df = df.withColumn("_before", F.substring_index(text, "&", 1))
    df = df.withColumn("_rest", _from_byte(text, F.octet_length("_before") + 1))
    both = F.concat("_before", unescaped(F.col("_rest")))
    return df.withColumn(name, F.when(F.col("_rest") == "", text).otherwise(both)).drop(
        "_before", "_rest"
    )


def with_plain_text(df: DataFrame, markup: str, name: str) -> DataFrame:
    """``df`` with the readable text of a page: without scripts, styles, comments and tags, a line
    for each block, white space collapsed."""
    text = F.regexp_replace(F.col(markup), UNREAD_AT_ONCE, " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, BREAKS_AT_ONCE, "\n")
    # A column of its own, so that it is computed once for all that is asked of it.
    df = with_unescaped(df.withColumn("_bare", F.regexp_replace(text, r"<[^>]*>", "")), "_bare")
    bare, uneven = F.col("_bare"), F.lit(False)
    for blank in ("  ", "\t", "\r", "\f", "\v"):
        uneven = uneven | F.contains(bare, F.lit(blank))
    # Single blanks stay as they are: most texts have no others.
    even = F.regexp_replace(bare, r"[ \t\r\f\x0B]+", " ")
    df = df.withColumn("_bare", F.when(uneven, even).otherwise(bare))
    text = F.btrim(F.regexp_replace("_bare", r" ?\n[ \n]*", "\n"), F.lit(" \n"))
    return df.withColumn(name, text).drop("_bare")


def _field(name: str, value: Column) -> Column:
    """A line of a block of fields, none for an empty value."""
    return F.when(value != "", F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response (``page_id, record_id, target_uri, date, block``):
    ``page_id, warc_type, record_id, refers_to, target_uri, date, content_type, content_length,
    block_digest, source_block_digest, source_payload_digest, block``.

    A block without an empty line is all headers and has an empty body; a null block is empty.
    Rows that repeat a response repeat its derivatives. An empty table gives an empty result.
    """
    block = F.coalesce(F.col("block"), F.lit(""))
    parts = (
        records.withColumn("block", block)
        .withColumn("_head", F.substring_index("block", CRLF * 2, 1))
        .withColumn("_body", _from_byte(F.col("block"), F.octet_length("_head") + 5))
        .withColumn("_own", digest(F.col("block")))
        .withColumn("_payload", digest(F.col("_body")))
    )
    head, body = F.col("_head"), F.col("_body")
    lines = F.split(head, CRLF)
    headers = F.transform(
        F.slice(lines, F.lit(2), F.size(lines)),
        lambda line: F.concat(F.lit("http-header: "), line, F.lit(CRLF)),
    )
    links = F.transform(
        F.regexp_extract_all(body, F.lit(LINK), F.lit(1)),
        lambda link: F.concat(F.lit("outlink: "), link, F.lit(CRLF)),
    )
    title = F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)
    named = with_unescaped(parts.withColumn("_title", title), "_title")
    title = F.btrim(F.regexp_replace("_title", r"[ \t\r\n\f\x0B]+", " "))
    fields = F.concat(
        _field("http-status", F.regexp_extract(head, r"\AHTTP/[0-9.]+ ([0-9]{3})", 1)),
        F.array_join(headers, ""),
        _field("source-block-digest", F.col("_own")),
        _field("source-payload-digest", F.col("_payload")),
        _field("title", title),
        _field("language", F.regexp_extract(body, r'(?is)<html[^>]*\blang="([^"]*)"', 1)),
        F.array_join(links, ""),
    )
    both = with_plain_text(named.withColumn("_fields", fields), "_body", "_text")

    def record(kind: str, content_type: str, content: str) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"),
            F.lit(content_type).alias("content_type"),
            F.col(content).alias("block"),
        )

    made = both.select(
        "page_id",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        F.col("_own").alias("source_block_digest"),
        F.col("_payload").alias("source_payload_digest"),
        F.explode(
            F.array(
                record("metadata", "application/warc-fields", "_fields"),
                record("conversion", "text/plain; charset=utf-8", "_text"),
            )
        ).alias("_made"),
    )
    return made.select(
        "page_id",
        "_made.warc_type",
        identifier(F.col("_made.warc_type"), F.col("refers_to")).alias("record_id"),
        "refers_to",
        "target_uri",
        "date",
        "_made.content_type",
        _bytes(F.col("_made.block")).alias("content_length"),
        digest(F.col("_made.block")).alias("block_digest"),
        "source_block_digest",
        "source_payload_digest",
        "_made.block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """``value``: each record as it stands in a file, but for the two line ends after it."""
    header = F.concat(
        F.lit(f"{VERSION}{CRLF}"),
        _field("WARC-Type", F.col("warc_type")),
        _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Target-URI", F.col("target_uri")),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Block-Digest", F.col("block_digest")),
        _field("Content-Type", F.col("content_type")),
        _field("Content-Length", F.col("content_length").cast("string")),
        F.lit(CRLF),
    )
    return records.select(F.concat(header, F.col("block")).alias("value"))


def write_files(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Files of records, one for each task, written by Spark where all executors can."""
    writer = serialised(records).write.option("lineSep", CRLF * 2)
    writer.option("compression", compression).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of such files: ``warc_type, record_id, refers_to, target_uri, date,
    content_type, content_length, block_digest, block, complete``. ``complete`` says whether the
    block is as long as its header says, which it is not where a block holds a version line."""
    lines = spark.read.option("lineSep", f"{VERSION}{CRLF}").text(path).where("value <> ''")
    at = F.instr("value", CRLF * 2)
    parts = lines.withColumn("_at", at).selectExpr(
        "substring(value, 1, _at - 1) as head",
        # Two line ends follow each record.
        "substring(value, _at + 4, length(value) - _at - 7) as block",
    )
    names = {
        "warc_type": "WARC-Type",
        "record_id": "WARC-Record-ID",
        "refers_to": "WARC-Refers-To",
        "target_uri": "WARC-Target-URI",
        "date": "WARC-Date",
        "content_type": "Content-Type",
        "content_length": "Content-Length",
        "block_digest": "WARC-Block-Digest",
    }
    fields = {
        column: F.regexp_extract("head", rf"(?:\A|\r\n){name}: ([^\r\n]*)", 1)
        for column, name in names.items()
    }
    fields["content_length"] = fields["content_length"].cast("bigint")
    return parts.select(
        *(value.alias(name) for name, value in fields.items()),
        "block",
        (_bytes(F.col("block")) == fields["content_length"]).alias("complete"),
    )
