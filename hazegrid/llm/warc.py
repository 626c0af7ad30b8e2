"""WARC derivatives (operator 9): metadata and plain-text conversion records from response records, in DataFrame functions.

Each response gives one `metadata` record (application/warc-fields: the source's status line and headers, its digests, title,
links and sizes) and one `conversion` record (text/plain). Both name the response in WARC-Refers-To and carry its target and
date; each has a block digest, and the conversion's metadata and text are linked by the response's id.

A null body is an empty one, and still gives both records; a null url gives records without a target. Record ids are UUIDs
made from the page's id, its url (null and empty differ), the digest of its payload and the record's type, so equal rows give
equal ids, reruns replace records, and rows that differ in any of these never share one. Metadata and conversion name each
other in WARC-Concurrent-To. Bodies of any length are converted whole. An empty table gives an empty result; other columns are
left out, so clashing names do no harm.
"""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: (pattern, replacement) in order; all are understood alike by Java and RE2.
TEXT_STEPS = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<script\b.*?</script\s*>", " "),
    (r"(?is)<style\b.*?</style\s*>", " "),
    (r"(?is)<noscript\b.*?</noscript\s*>", " "),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|title|body|html|head|main|blockquote|pre|hr)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)
SPACE_STEPS = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+", ""), (r"[ \n]+$", ""))


def _decoded(text: Column) -> Column:
    """Every character reference of HTML decoded once, named ones and numeric ones alike; no-break spaces from references become spaces."""
    # all inside, so that workers need not find this module
    unescape, space = html.unescape, re.compile(r"&(?:nbsp;?|#0*160(?![0-9]);?|#[xX]0*[aA]0(?![0-9a-fA-F]);?)")

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None or "&" not in x else unescape(space.sub(" ", x)))

    return F.pandas_udf(run, "string")(text)


def plain_text(page: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block tags end lines, other tags vanish, character references are decoded."""
    for pattern, to in TEXT_STEPS:
        page = F.regexp_replace(page, pattern, to)
    page = _decoded(page)
    for pattern, to in SPACE_STEPS:
        page = F.regexp_replace(page, pattern, to)
    return page


def record_id(kind: str, *parts: Column) -> Column:
    """<urn:uuid:...> from the md5 of kind and parts; a null part is left out with its mark."""
    h = F.md5(F.concat(F.lit(kind), *[F.coalesce(F.concat(F.lit("|"), p.cast("string")), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of stored pages: page, record_id, target_uri, date, and the HTTP block of headers and body."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    return pages.select(F.col(id_col).alias("page"), record_id("response", F.col(id_col), F.col(url_col), digest(body)).alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).alias("block"))


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response (page, record_id, target_uri, date, block).

    Columns: page, warc_type, record_id, refers_to, concurrent_to, target_uri, date, content_type, source_headers, source_payload_digest,
    block_digest, content_length, block, record (the whole WARC/1.1 record as text).
    """
    gap = CRLF + CRLF
    split = F.instr("block", gap)
    parts = source.select("page", "record_id", "target_uri", "date", F.when(split > 0, F.substring_index("block", gap, 1)).otherwise(F.lit("")).alias("source_headers"), F.when(split > 0, F.col("block").substr(split + len(gap), F.length("block"))).otherwise(F.col("block")).alias("body"))
    # the text and digests are computed before the rows are doubled, so that each page is converted once
    made = parts.select("page", F.col("record_id").alias("refers_to"), "target_uri", "date", "source_headers", digest(F.col("body")).alias("source_payload_digest"), F.octet_length("body").alias("body_bytes"), F.trim(F.regexp_replace(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t\r\n]+", " ")).alias("title"), F.regexp_count("body", F.lit(r"(?i)<a\s[^>]*href")).alias("links"), plain_text(F.col("body")).alias("text"))
    fields = F.concat(*[x for name, value in (("source-status-and-headers", F.regexp_replace("source_headers", CRLF, "; ")), ("source-payload-digest", F.col("source_payload_digest")), ("title", F.col("title")), ("links", F.col("links").cast("string")), ("html-bytes", F.col("body_bytes").cast("string")), ("text-bytes", F.octet_length("text").cast("string"))) for x in (F.lit(f"{name}: "), value, F.lit(CRLF))])
    both = made.select("*", F.explode(F.array(F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")), F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")))).alias("r")).select("page", "refers_to", "target_uri", "date", "source_headers", "source_payload_digest", "r.*")
    ids = {k: record_id(k, F.col("refers_to")) for k in ("metadata", "conversion")}
    both = both.withColumns({"record_id": F.when(F.col("warc_type") == "metadata", ids["metadata"]).otherwise(ids["conversion"]), "concurrent_to": F.when(F.col("warc_type") == "metadata", ids["conversion"]).otherwise(ids["metadata"]), "block_digest": digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    lines = [("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Concurrent-To", F.col("concurrent_to")), ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string"))]
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in lines])
    record = F.concat(head, F.lit(CRLF), F.col("block"), F.lit(CRLF + CRLF))
    return both.select("page", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "source_headers", "source_payload_digest", "block_digest", "content_length", "block", record.alias("record"))


def _sql_text() -> str:
    q = lambda s: s.replace("'", "''")
    to = lambda t: "chr(10)" if t == chr(10) else f"'{t}'"
    out = "body"
    for pattern, t in TEXT_STEPS:
        out = f"regexp_replace({out}, '{q(pattern)}', {to(t)}, 'g')"
    # references by name or number, each with its semicolon, once
    out = f"array_to_string(list_transform(regexp_extract_all({out}, '&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[A-Za-z0-9]+;|&|[^&]+'), lambda x: CASE WHEN NOT starts_with(x, '&') THEN x WHEN x IN ('&nbsp;', '&#160;', '&#xa0;', '&#xA0;') THEN ' ' WHEN regexp_matches(x, '^&#[xX]') THEN chr(CAST('0x' || x[4:-2] AS INTEGER)) WHEN starts_with(x, '&#') THEN chr(CAST(x[3:-2] AS INTEGER)) ELSE coalesce(names[x[2:-1]], x) END), '')"
    for pattern, t in SPACE_STEPS:
        out = f"regexp_replace({out}, '{q(pattern)}', {to(t)}, 'g')"
    return out


def oracle() -> str:
    """The query's rows over the table pages, for DuckDB. Of character references it decodes those that end in a semicolon, as all do in these pages."""
    h = lambda parts: f"(SELECT '<urn:uuid:' || substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12) || '>' FROM (SELECT md5({parts}) AS h))"
    response = h("'response|' || page_id || coalesce('|' || url, '') || '|sha256:' || sha256(body)")
    names = ", ".join("'" + n.replace("'", "''") + "'" for n in sorted(html.entities.html5) if n.endswith(";") and n != "nbsp;")
    values = ", ".join("'" + html.entities.html5[n].replace("'", "''") + "'" for n in sorted(html.entities.html5) if n.endswith(";") and n != "nbsp;")
    nl = "chr(13) || chr(10)"
    return f"""
WITH entities AS MATERIALIZED (SELECT map([{names}], [{values}]) AS names),
p AS (SELECT page_id, url, body, {response} AS refers_to FROM (SELECT page_id, url, coalesce(html, '') AS body FROM pages)),
t AS (SELECT page_id, url, refers_to, body, {_sql_text()} AS text,
  'HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; Content-Length: ' || strlen(body) AS head,
  'sha256:' || sha256(body) AS source_payload_digest,
  trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\r\\n]+', ' ', 'g')) AS title,
  len(regexp_extract_all(body, '(?i)<a\\s[^>]*href')) AS links FROM p, entities),
m AS (SELECT page_id, url, refers_to, source_payload_digest, 'metadata' AS warc_type,
  'source-status-and-headers: ' || head || {nl} || 'source-payload-digest: ' || source_payload_digest || {nl} || 'title: ' || title || {nl} || 'links: ' || links || {nl} || 'html-bytes: ' || strlen(body) || {nl} || 'text-bytes: ' || strlen(text) || {nl} AS block FROM t
  UNION ALL SELECT page_id, url, refers_to, source_payload_digest, 'conversion', text FROM t)
SELECT page_id, warc_type, {h("warc_type || '|' || refers_to")} AS record_id, refers_to, url AS target_uri, source_payload_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block
FROM m"""
