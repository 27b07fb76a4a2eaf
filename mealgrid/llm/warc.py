"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response yields two records. Both refer to it by its record identifier
and keep its target URI and date; the metadata record carries the source's
HTTP header lines and payload digest on, the conversion record the plain text.
Both have identifiers, block digests and lengths of their own, and each names
the other through the metadata's ``derived`` line, so the three are linked.

Row by row: no shuffle, no state. Character references are decoded in Arrow
batches, the rest is built-in expressions.

Null payloads are empty, null header lines none; a response without an
identifier gets one from its target and payload, so that links hold. Repeated
responses give repeated records.
"""

import re
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mealgrid.llm.common import text_of

CRLF = "\r\n"
# Named and numeric references, decoded once; without its semicolon a reference stays, as it may be cut off.
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
# Each ends with its own end tag, or with the page; a head is looked for when they are gone, as they may name one.
HIDDEN = r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
HEAD = r"(?is)<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>"
BLOCK = r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|br|article|section|nav|header|footer|aside|blockquote|pre|form)\b[^>]*>"


def urn(*parts: Column) -> Column:
    """A name-based record identifier."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _decoded(m: re.Match) -> str:
    ref = m[0]
    if ref[1] != "#" and ref[1:] not in html5:
        return ref
    # A no-break space is a space in plain text.
    return unescape(ref).replace("\xa0", " ")


def decoded(text: Column) -> Column:
    """The text with its character references decoded."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: REFERENCE.sub(_decoded, t) if t and "&" in t else t)

    return run(text)


def plain_text(html: Column) -> Column:
    """Text of a page: hidden parts and tags gone, blocks on lines of their own."""
    out = F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), HEAD, "")
    out = F.regexp_replace(out, BLOCK, "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    out = decoded(out)
    out = F.regexp_replace(out, r"[ \t\r]+", " ")
    return F.btrim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def as_responses(pages: DataFrame) -> DataFrame:
    """The pages as response records: their identifiers, header lines and digests."""
    html = text_of(F.col("html"))
    return pages.select(
        F.col("page_id"),
        urn(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html)).alias("http"),
        html.alias("payload"),
        digest(html).alias("payload_digest"),
    )


MADE = ("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "n_bytes", "header", "block")


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response.

    ``responses`` has ``record_id``, ``target_uri``, ``date``, ``http``,
    ``payload`` and ``payload_digest``; other columns that it has stay, whatever
    they are called. One that has the name of a column made here stays as
    ``source_`` and that name, with more underscores if that is taken too.
    """
    mine = ("record_id", "target_uri", "date", "http", "payload", "payload_digest")
    rest, taken = {}, {*responses.columns, *MADE}
    for c in responses.columns:
        if c not in mine:
            name = c
            if c in MADE:
                name = f"source_{c}"
                while name in taken:
                    name += "_"
                taken.add(name)
            rest[c] = name
    body, uri = text_of(F.col("payload")), F.coalesce("target_uri", F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in rest.items()]) if rest else F.struct(F.lit(0).alias("_"))
    source = responses.select(
        kept.alias("_rest"),
        F.coalesce("record_id", urn(F.lit("response"), uri, body)).alias("_id"),
        uri.alias("_uri"),
        F.coalesce("date", F.lit("")).alias("_date"),
        F.coalesce("http", F.lit("")).alias("_http"),
        F.coalesce("payload_digest", digest(body)).alias("_digest"),
        plain_text(body).alias("_text"),
    )
    ids = {t: urn(F.lit(t), F.col("_id")) for t in ("metadata", "conversion")}
    told = F.concat(
        F.lit("source-digest: "), F.col("_digest"), F.lit(f"{CRLF}derived: "), ids["conversion"], F.lit(CRLF), F.col("_http"), F.lit(CRLF)
    )
    two = F.array(
        F.struct(F.lit("metadata").alias("t"), ids["metadata"].alias("id"), F.lit("application/warc-fields").alias("kind"), told.alias("b")),
        F.struct(F.lit("conversion").alias("t"), ids["conversion"].alias("id"), F.lit("text/plain; charset=utf-8").alias("kind"), F.col("_text").alias("b")),
    )
    records = source.select("_rest", "_id", "_uri", "_date", "_digest", F.explode(two).alias("_r"))
    block, size, block_digest = F.col("_r.b"), F.octet_length("_r.b").cast("bigint"), digest(F.col("_r.b"))
    lines = (
        ("WARC-Type: ", F.col("_r.t")),
        ("WARC-Record-ID: ", F.col("_r.id")),
        ("WARC-Refers-To: ", F.col("_id")),
        ("WARC-Target-URI: ", F.col("_uri")),
        ("WARC-Date: ", F.col("_date")),
        ("WARC-Block-Digest: ", block_digest),
        ("Content-Type: ", F.col("_r.kind")),
        ("Content-Length: ", size.cast("string")),
    )
    header = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[x for name, c in lines for x in (F.lit(name), c, F.lit(CRLF))])
    made = (F.col("_r.t"), F.col("_r.id"), F.col("_id"), F.col("_uri"), F.col("_digest"), block_digest, size, header, block)
    return records.select(*[F.col("_rest")[n].alias(n) for n in rest.values()], *[c.alias(n) for n, c in zip(MADE, made)])


def write(records: DataFrame, path: str) -> None:
    """Records as WARC text, gzip-compressed, as many files as there are tasks."""
    record = F.concat("header", F.lit(CRLF), "block", F.lit(CRLF))
    records.select(record.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)
